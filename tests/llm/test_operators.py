"""The training-data operators against brute force, exact round trips and held-out accuracy; edge cases of their tables."""

import base64
import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from lumicat.llm import bpe, chat, exact_dedup, filters, media, ngram_join, packing, pii, queries, secrets, token_files, toxicity
from lumicat.llm.components import components

from ..compare import connect, difference

DOCS = "doc_id long, text string, source string, kept boolean, bucket int, key string"


def frame(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "s", None, 7, "k") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def edge():
    """Nulls, empty and blank texts, repeated rows, ties, odd characters, a long text."""
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    long = " ".join(r.choice(words) + str(r.randint(0, 500)) for _ in range(30_000))
    base = " ".join(r.choice(words) + str(r.randint(0, 30)) for _ in range(60))
    near = base.replace(" ", "  ", 3).split(" ")
    near[10] = "changed"
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, base), (7, base), (8, base.upper()), (9, " ".join(near)), (10, long), (11, long + " tail"), (12, "é ü 🙂  x"), (13, "x" * 50_000), (14, "one two three four five six"), (14, "one two three four five six"), (15, "퟿￿ \x85 \x1c a")]


def brute_components(rows, num=75, den=100):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    part = {i: i for i in sets}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        o = len(sets[a] & sets[b])
        if o and den * o >= num * (len(sets[a]) + len(sets[b]) - o):
            x, y = sorted((top(a), top(b)))
            part[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_join_matches_brute_force(spark, edge):
    got = ngram_join.ngram_jaccard_join(frame(spark, edge)).collect()
    assert len(got) == len(edge)
    want = brute_components(edge)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_join_of_edited_copies(spark):
    """Chains of edits, so that components hold pairs that don't link, and passages shared by unlike texts."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, passage = [], [r.choice(words) for _ in range(60)]
    for k in range(12):
        text = [r.choice(words) for _ in range(r.choice((8, 40, 120)))]
        for j in range(r.randint(1, 6)):
            rows.append((100 * k + j, " ".join(text)))
            text[r.randrange(len(text))] = r.choice(words)
        rows.append((100 * k + 50, " ".join(passage + text)))
    got = ngram_join.ngram_jaccard_join(frame(spark, rows)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_components(rows)


def test_join_of_null_and_repeated_ids(spark):
    """Rows without an id link like others; rows that repeat don't multiply anything."""
    r = random.Random(12)
    base = [f"w{r.randint(0, 999)}" for _ in range(60)]
    near = [*base[:59], "other"]
    rows = [(None, " ".join(base)), (5, " ".join(near)), (None, "alone"), (None, None), (7, " ".join(base[:8])), (7, " ".join(near))]
    rows += [(9, " ".join(base))] * 3000
    got = ngram_join.ngram_jaccard_join(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    seen = {(x.doc_id, x.n_shingles, x.component_id) for x in got}
    assert seen == {(None, 56, 5), (5, 56, 5), (None, 1, None), (None, 0, None), (7, 4, 7), (7, 56, 5), (9, 56, 5)}


def test_join_of_frequent_lists_in_parts_and_blocks(spark):
    """Lists of many members, with parts and blocks of a few: chains of edits, where pivots don't link to all."""
    r = random.Random(13)
    rows, i = [], 0
    for _ in range(4):
        words = [f"w{r.randint(0, 5000)}" for _ in range(30)]
        for _ in range(70):
            rows.append((i, " ".join(words)))
            i += 1
            words = list(words)
            words[r.randrange(len(words))] = f"w{r.randint(0, 5000)}"
            if r.random() < 0.2:
                words = words[: r.randint(20, 30)] + [f"w{r.randint(0, 9)}"] * r.randint(0, 8)
    shared = [f"s{k}" for k in range(7)]
    rows += [(i + k, " ".join([*shared[: r.randint(5, 7)], *r.choices(shared, k=r.randint(0, 3))])) for k in range(120)]
    want = brute_components(rows)
    for split, block in ((3, 5), (4, 30)):
        got = ngram_join.ngram_jaccard_join(frame(spark, rows), split=split, block=block).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want


def test_ranges_grow_with_the_data(spark):
    few, many = (ngram_join._ranges(spark, n) for n in (10**6, 10**13))
    assert few == 64 and 10**13 / many < 30_000_000


def test_join_of_nothing(spark):
    assert ngram_join.ngram_jaccard_join(frame(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.ngram_jaccard_join(frame(spark, [(1, None)])).collect()] == [(1, 0, 1)]


def test_divide_skip_finds_all_links():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(3, 40)).astype(np.uint64)) for _ in range(80)]
    index = ngram_join.DivideSkip(60, 100)
    for i, s in enumerate(sets):
        want = {(j, len(np.intersect1d(s, t))) for j, t in enumerate(sets[:i]) if 100 * (o := len(np.intersect1d(s, t))) >= 60 * (len(s) + len(t) - o)}
        assert set(index.search(s)) == want
        index.add(i, s)


def test_word_hashes_follow_words(edge):
    seen = {}
    for _, t in edge:
        raw = (t or "").encode("utf-8", "surrogatepass").lower()
        h = ngram_join.word_hashes(raw)
        assert len(h) == len(raw.split())
        for w, x in zip(raw.split(), h.tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_long_texts_are_hashed_in_chunks(monkeypatch):
    raw = b"some words go here and there again " * 50
    whole = ngram_join.word_hashes(raw).tolist()
    monkeypatch.setattr(ngram_join, "CHUNK", 40)
    assert ngram_join.word_hashes(raw).tolist() == whole


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def brute_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {k: (min(v)[1], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("bits", [64, 3])
def test_dedup_matches_brute_force(spark, edge, bits):
    """With keys of 3 bits nearly all collide and byte verification decides."""
    got = exact_dedup.exact_dedup(frame(spark, edge), key_bits=bits).collect()
    want = brute_dedup(edge)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert len(got) == len(edge)
    assert all((r.keep_id, r.group_size) == by_hash[r.text_sha256] for r in got)
    assert all(sum(r.kept for r in got if r.text_sha256 == h) == 1 for h in by_hash)


def test_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_dedup_takes_counts_and_rows_from_the_index(spark):
    """Groups of every kind: repeats of an id, null ids, ties of length, one huge group."""
    r = random.Random(8)
    rows = [(r.choice([None, *range(40)]), r.choice(["a b", "ab", " a  b", "c", "c ", "", None, "d" * 50])) for _ in range(600)]
    rows += [(1000 + i, "e " * (i % 3) + "e") for i in range(900)]
    for bits in (64, 2):
        got = exact_dedup.exact_dedup(frame(spark, rows), key_bits=bits).collect()
        groups = {}
        for i, t in rows:
            groups.setdefault("".join((t or "").split(" ")), []).append((-len(t or ""), i is not None, i or 0))
        want = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[2] if min(v)[1] else None, len(v)) for k, v in groups.items()}
        assert len(got) == len(rows) and all((x.keep_id, x.group_size) == want[x.text_sha256] for x in got)
        kept = [(x.text_sha256, x.doc_id) for x in got if x.kept]
        assert sorted(kept, key=str) == sorted(((h, i) for h, (i, _) in want.items()), key=str)


def test_sent_filter(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    f = filters.sent_filter(keys, 5000)
    have = np.array([x.key for x in keys.collect()], np.int64)
    assert f.may_hold(have).all() and f.may_hold(have + 1).mean() < 0.05
    assert not filters.sent_filter(keys.limit(0), 0).may_hold(have).any()
    assert filters.SentFilter.width(10**12) == 8 * filters.BLOCK_BYTES


def test_levels_fold_runs():
    r = random.Random(2)
    levels, want = exact_dedup.Levels(), {}
    for _ in range(30):
        table = exact_dedup.Memtable()
        for _ in range(20):
            k, i, p = r.randint(-50, 50), r.randint(0, 999), r.randint(0, 3)
            table.add(k, i, p)
            want.setdefault(k, []).append((-p, i))
        for _, run in table.runs(1):
            levels.add(run)
    got = {x[0]: x[1:] for run, _ in levels.runs for x in run.tolist()}
    assert got == {k: (min(i for _, i in v), len(v), -min(v)[0], min(v)[1]) for k, v in want.items()}


def test_bloom_has_no_false_negatives():
    keys = np.random.default_rng(0).integers(-(2**62), 2**62, 5000)
    b = exact_dedup.Bloom(keys)
    assert b.may_hold(keys).all()
    assert b.may_hold(keys + 1).mean() < 0.05


def test_media_round_trip(spark, edge):
    got = {r.doc_id: r for r in media.audio_features(media.media_column(frame(spark, edge))).collect()}
    for i, t in edge:
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert bytes(got[i].payload) == payload and got[i].n_bytes == len(raw)
        tensors, spans = media.from_arrow(bytes(got[i].tensors))
        assert tensors.shape[1:] == (media.FRAMES, media.MELS) and len(spans) == len(tensors)
        assert (spans[:, 1] > spans[:, 0]).all()
    assert media.media_column(frame(spark, [])).count() == 0


def test_polyphase_equals_direct_convolution():
    x = np.random.default_rng(0).normal(size=501).astype(np.float32)
    h = media.polyphase_filter(5, 8)
    flat = h[:, ::-1].T.reshape(-1)
    up = np.zeros(len(x) * 5)
    up[::5] = x
    want = np.convolve(up, flat)[64:][: len(x) * 5][::8]
    assert np.allclose(media.resample(x), want, atol=1e-5)


def test_audio_of_null_and_malformed_media(spark):
    good = media.encode_wav(b"\x80\x90" * 300)
    bad = [None, b"", b"RIFF", good[:20], good.replace(b"fmt ", b"none"), good[:34] + b"\x10\x00" + good[36:], b"x" * 500, media.encode_wav(b"")]
    rows = spark.createDataFrame([(i, 1, x) for i, x in enumerate([*bad, good])], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.audio_features(rows).collect()}
    assert all(got[i].payload is None and got[i].tensors is None and got[i].spans is None for i in range(7))
    assert bytes(got[7].payload) == b"" and got[7].tensors and bytes(got[8].payload) == b"\x80\x90" * 300
    assert media.audio_features(rows.limit(0)).count() == 0


def brute_features(payload):
    """The stored feature by plain sums: no stride tricks, no FFT, no phases."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    cut = max(media.UP, media.DOWN)
    taps = np.arange(-8 * cut, 8 * cut + 1)
    h = np.sinc(taps / cut) * np.hamming(len(taps)) * media.UP / cut
    y = []
    for i in range(-(-len(x) * media.UP // media.DOWN)):
        at = i * media.DOWN  # on the grid of ``UP`` times the rate
        y.append(sum(x[k] * h[at - k * media.UP + 8 * cut] for k in range(len(x)) if abs(at - k * media.UP) <= 8 * cut))
    rate = media.RATE * media.UP // media.DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(rate / 2) * m / (media.MELS + 1) / 2595) - 1) for m in range(media.MELS + 2)]
    frames = []
    for start in range(0, max(1, len(y) - media.WINDOW + media.HOP), media.HOP):
        part = np.array([*y[start : start + media.WINDOW], *[0.0] * media.WINDOW])[: media.WINDOW] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.WINDOW) / (media.WINDOW - 1)))
        row = []
        power = [abs(sum(part * np.exp(-2j * np.pi * k * np.arange(media.WINDOW) / media.FFT))) ** 2 for k in range(media.FFT // 2 + 1)]
        for a, b, c in zip(edges, edges[1:], edges[2:]):
            f = [k * rate / media.FFT for k in range(media.FFT // 2 + 1)]
            row.append(np.log10(sum(p * max(0, min((v - a) / (b - a), (c - v) / (c - b))) for p, v in zip(power, f)) + media.FLOOR))
        frames.append(row)
    return np.array(frames)


def test_features_equal_plain_sums():
    r = random.Random(4)
    for n in (64, 640, 1024):
        payload = bytes(r.choice(b"abc XYZ,.\x00\xff") for _ in range(n))
        want = brute_features(payload)
        stored, spans = media.features(payload, media.RATE)
        got = media.from_arrow(stored)[0].reshape(-1, media.MELS)[: len(want)] / 100
        assert np.abs(got - want).max() < 0.011
        level, active, found = want.mean(1), None, []
        for i, v in enumerate([*level, -np.inf]):  # the hysteresis one frame at a time
            if active is None and v >= media.ON:
                active = i
            elif active is not None and v < media.OFF:
                if i - active >= media.LEAST:
                    found.append((active, i))
                active = None
        hop = media.HOP / (media.RATE * media.UP // media.DOWN)
        assert spans == [(a * hop, b * hop) for a, b in found]


def test_hysteresis():
    level = np.array([0, 5, 5, 3, 3, 3, 1, 5, 1], float)
    assert media.segments(level, 4, 2, 2) == [(1, 6)]
    assert media.segments(np.array([]), 4, 2, 2) == []


def test_frames_cover_the_last_sample():
    for n in (1, media.WINDOW - 1, media.WINDOW, media.WINDOW + 1, media.WINDOW + media.HOP, 320, 1000, 1049):
        x = np.full(n, 0.1, np.float32)
        got = media.log_mel(x, 5000)
        assert len(got) == max(0, -(-(n - media.WINDOW) // media.HOP)) + 1
        # what stands near the end (a Hann window is 0 at its very edge) is in the last frame
        x[-max(1, min(n, 30)) :] = -0.9
        assert n == 1 or not np.array_equal(media.log_mel(x, 5000)[-1], got[-1])
    texts = ["a" * 480 + "b" * 32, "a" * 480 + "z" * 32]
    a, b = (media.features(t.encode(), 8000)[0] for t in texts)
    assert a != b


def brute_secrets(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def entropy(s, w=20):
    best = 0.0
    for i in range(len(s) - w + 1):
        c = [s[i : i + w].count(x) for x in set(s[i : i + w])]
        best = max(best, -sum(n / w * np.log2(n / w) for n in c))
    return best


def test_secrets_match_brute_force(spark, edge):
    from pyspark.sql import functions as F

    r = random.Random(4)
    bits = ["password", "TOKEN", " ", ":", "=", '"', "secret", "api_key", "ApiKey", "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef", "0123456789ab", "é", "\n", "x.y", "passwd"]
    rows = edge + [(100 + i, "".join(r.choice(bits) for _ in range(25))) for i in range(150)]
    got = secrets.secret_spans(frame(spark, rows)).select("doc_id", secrets.joined(F.col("base")).alias("b")).collect()
    assert sorted((x.doc_id, x.b) for x in got) == sorted((i, brute_secrets(t or "")) for i, t in rows)
    assert secrets.secret_spans(frame(spark, [])).count() == 0


def test_entropy_and_allow_list(spark):
    from pyspark.sql import functions as F

    rows = ["Zx9Kq2LmP0vR7tYw3BnC", "aaaaaaaaaaaaaaaaaaaaaaaa1", "Zx9Kq2LmP0EXAMPLE7tYw3BnC", "abcabcabcabcabcabcabc1abc", "Ab1" * 20 + "Zx9Kq2LmP0vR7tYw3BnC"]
    df = spark.createDataFrame([(x,) for x in rows], "c string")
    got = [(r.c, r.e, r.hit) for r in df.select("c", secrets.best_entropy(F.col("c"), 20).alias("e"), secrets.is_random(F.col("c")).alias("hit")).collect()]
    assert all(abs(e - entropy(c)) < 1e-9 for c, e, _ in got)
    assert [h for _, _, h in got] == [True, False, False, False, True]
    spans = secrets.secret_spans(frame(spark, [(1, f"k {rows[0]} z")])).first().added
    assert [(s.start, s.stop) for s in spans] == [(2, 22)]


def test_elias_fano():
    r = np.random.default_rng(0)
    for values in ([], [0], [5], [0, 0, 7, 7, 9], np.cumsum(r.integers(0, 5000, 3000)).tolist()):
        e = token_files.EliasFano.frombytes(token_files.EliasFano.of(np.array(values, np.int64)).tobytes())
        assert [e.select(i) for i in range(len(values))] == list(values)
        for lo, hi in ((0, len(values)), (0, 0), (1, 2), (127, 129), (128, 256), (130, 1500), (2999, 3000)):
            if hi <= len(values):
                assert e.select_range(lo, hi).tolist() == list(values[lo:hi])
    dense = token_files.EliasFano.of(np.cumsum(r.integers(0, 1000, 10_000)))
    assert len(dense.tobytes()) * 8 / 10_000 < 2 + np.log2(1000) + 1
    with pytest.raises(IndexError):
        dense.select(10_000)


def test_token_files_round_trip(spark, edge, tmp_path):
    from tokenizers import Tokenizer

    raw = queries.vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_str(raw.decode())
    t.encode_special_tokens = True
    rows = edge + [(20, "<|endoftext|> it's 12 o'clock  \n\n now")]
    files = token_files.write_token_files(frame(spark, rows), str(tmp_path / "f"), raw, 2)
    got = sorted((r.start, r.doc_id, list(np.frombuffer(r.ids, "<u4"))) for r in token_files.document_ids(files).collect())
    at = 0
    for (start, i, ids), (j, text) in zip(got, sorted(rows, key=lambda x: (x[0], x[1] or "")), strict=True):
        assert (start, i) == (at, j) and ids == [*t.encode(text or "", add_special_tokens=False).ids, 2]
        at += len(ids)
    first = files.orderBy("segment").first()
    assert list(token_files.document(files, first.segment, 0)) == got[0][2]
    with pytest.raises(KeyError):
        token_files.document(files, -5, 0)
    with pytest.raises(IndexError):
        token_files.document(files, first.segment, 10_000)
    again = token_files.write_token_files(frame(spark, rows[3:9] * 5), str(tmp_path / "h"), raw, 2, segment=40)  # many a part
    assert again.groupBy("part").count().agg({"count": "max"}).first()[0] > 1
    starts = [(r.start, len(r.ids) // 4) for r in token_files.document_ids(again).orderBy("start").collect()]
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(starts)) and len(starts) == 30
    assert token_files.document_ids(token_files.write_token_files(frame(spark, []), str(tmp_path / "g"), raw, 2)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name, edge, sf_dir):
    import pyarrow.parquet as pq
    from lumicat.llm.tokens import Encoder

    raw = queries.vocabulary(name)
    texts = [t or "" for _, t in edge] + pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist() + ["don't WE'LL ÀÉ²½ a's’ Å İ", "a  b\t\tc \n"]
    e = Encoder(raw)
    e.words.bound = 500
    assert [x.tolist() for x in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_with_colliding_hashes(name, monkeypatch):
    from lumicat.llm import tokens

    e = tokens.Encoder(queries.vocabulary(name))
    monkeypatch.setattr(tokens, "mix64", lambda x: x & np.uint64(31))
    texts = [f"word{i} and it's {'x' * (i % 7)} end" for i in range(50)]
    assert [x.tolist() for x in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_on_final_contractions(name, monkeypatch):
    """A contraction may end a text, a group of texts and a chunk of a long text."""
    from lumicat.llm import tokens

    e = tokens.Encoder(queries.vocabulary(name))
    want = lambda t: e.tokenizer.encode(t, add_special_tokens=False).ids
    ends = [f"{a}'{c}" for a in ("it", "", "1", " ", "!", "'") for c in ("s", "t", "m", "d", "re", "ve", "ll", "S", "r", "v", "l", "x", "", "'")]
    for t in ends:
        assert e.encode([t])[0].tolist() == want(t)
    assert [x.tolist() for x in e.encode(ends)] == [want(t) for t in ends]
    whole = tokens.chunks
    monkeypatch.setattr(tokens, "chunks", lambda text: whole(text, 40))
    monkeypatch.setattr(tokens, "CHUNK", 40)
    for c in ("s", "t", "m", "d", "re", "ve", "ll"):
        for n in range(30, 45):
            t = "a" * n + f"it'{c} on" + "b" * 50 + f" it'{c} so it'{c}"
            assert e.encode([t])[0].tolist() == want(t)


SPECIAL = ["a <|endoftext|> it's", "<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", "plain it's", "é – <|endoftext|>", "", "word " * 200_000 + "<|endoftext|> it's"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_untouched_library(name):
    from lumicat.llm.tokens import Encoder
    from tokenizers import Tokenizer

    raw = queries.vocabulary(name)
    t = Tokenizer.from_file(public_tokenizers.path(name))
    assert [x.tolist() for x in Encoder(raw, special=True).encode(SPECIAL)] == [t.encode(x, add_special_tokens=False).ids for x in SPECIAL]
    # tokens of the list that aren't special are found by either setting
    conf = json.loads(raw)
    for n, x in enumerate(conf["added_tokens"]):
        x |= {"special": False, "normalized": bool(n)}
    raw = json.dumps(conf).encode()
    t = Tokenizer.from_str(raw.decode())
    assert [x.tolist() for x in Encoder(raw).encode(SPECIAL)] == [t.encode(x, add_special_tokens=False).ids for x in SPECIAL]


def test_registered_queries_find_special_tokens(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = frame(spark, list(enumerate(SPECIAL)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    crc = lambda t, x, end: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, end], "<u4").tobytes())
    got = {r.doc_id: r.ids_crc32 for r in queries.op5_token_files(spark, str(tmp_path)).collect()}
    assert got == {i: crc(t, x, 2) for i, x in enumerate(SPECIAL)}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: crc(t, x, 1) for i, x in enumerate(SPECIAL[:-1])}
    for out in (queries.op7_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        assert {r.doc_id: r.ids_crc32 for r in out.collect() if r.doc_id in want} == want


def test_chat_round_trip(spark):
    r = random.Random(6)
    bits = [*chat.CONTROLS, "\\", "<", "[", "/", "INST]", " ", "\n", "ok", "é", "<\\", "|>"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", None]), r.choice([None, "", "".join(r.choice(bits) for _ in range(12))])) for c in range(40) for t in range(r.randint(1, 6))]
    rows += [(50, 1, "user", "a"), (50, 1, "user", "a"), (50, None, "system", "b")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, segments int")
    out = chat.format_chat(df)
    for x in chat.read_chat(out).collect():
        want = sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text in rows if c == x.conv_id)
        assert [(t.role, t.text) for t in x.turns] == [w[1:] for w in want]
    for x in out.collect():
        assert "".join(s.text for s in x.segments) == x.formatted
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_machine(spark):
    talks = {1: "system user assistant", 2: "user assistant user assistant", 3: "assistant user", 4: "user user assistant", 5: "user", 6: "user tool"}
    df = spark.createDataFrame([(c, i, role, "t") for c, t in talks.items() for i, role in enumerate(t.split())], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.valid, r.first_error) for r in chat.format_chat(df).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, 1), 5: (False, None), 6: (False, 1)}


def test_chat_query_reads_the_loss_mask_and_the_order(spark, tmp_path, monkeypatch):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b</s>"), (1, 2, "user", "c"), (1, 3, "assistant", "\\d"), (2, 0, "assistant", "e"), (3, 0, "user", "f"), (4, 0, "start", "x"), (4, 1, "user", "y"), (4, 2, "assistant", "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    loss = lambda: {r.conv_id: (r.loss_chars, r.loss_sha256) for r in queries.op6_chat_format(spark, str(tmp_path)).collect() if r.conv_id > 0}
    sha = lambda t: (len(t), hashlib.sha256(t.encode()).hexdigest())
    assert loss() == {1: sha("b</s>\\d"), 2: sha("e"), 3: sha(""), 4: sha("z")}
    order = queries.op6_chat_order(spark, str(tmp_path))
    assert {r.conv_id: (r.valid, r.first_error) for r in order.collect()} == {-7: (True, None), 1: (True, None), 2: (False, 0), 3: (False, None), 4: (False, 0)}
    assert difference(order, connect(str(tmp_path)), queries.ORACLE_SQL["op6_chat_order"]) == ""
    # the digests follow the mask
    monkeypatch.setitem(chat.TEMPLATE, "user", (*chat.TEMPLATE["user"][:2], True))
    assert loss() == {1: sha("ab</s>c\\d"), 2: sha("e"), 3: sha("f"), 4: sha("yz")}


def test_best_fit():
    r = random.Random(8)
    for sizes in ([], [10], [5, 5, 5], [r.randint(1, 100) for _ in range(2000)]):
        where, offset, fill = packing.best_fit(sizes, 100)
        places = {}
        for b, o, s in zip(where, offset, sizes, strict=True):
            places.setdefault(b, []).append((o, s))
        for b, items in places.items():
            at = 0
            for o, s in sorted(items):
                assert o == at
                at += s
            assert at == fill[b] <= 100
    assert len(packing.best_fit([60, 50, 50, 40], 100)[2]) == 2


def test_packing(spark, edge):
    raw = queries.vocabulary("word_bpe_49k.json")
    rows = edge + [(100 + i, "word " * (i % 97)) for i in range(400)]
    got = packing.pack_documents(frame(spark, rows).repartition(20), raw, 1, capacity=128).collect()
    from lumicat.llm.tokens import Encoder

    ids = [[*x.tolist(), 1] for x in Encoder(raw).encode([t or "" for _, t in rows])]
    want = sorted((i, p, a, len(x[a : a + 128]), zlib.crc32(np.array(x[a : a + 128], "<u4").tobytes())) for (i, _), x in zip(rows, ids, strict=True) for p, a in enumerate(range(0, len(x), 128)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 128
    assert len(bins) <= 1.05 * sum(r.length for r in got) / 128 + 2
    assert packing.pack_documents(frame(spark, []), raw, 1).count() == 0


def test_merge_tree_joins_small_bins(spark):
    bins = spark.createDataFrame([((p << 32) + b, f) for p in range(300) for b, f in ((0, 30), (1, 70), (2, 90))], "bin long, fill long")
    moved = packing.merge_tree(bins, 100).collect()
    fill = {(p << 32) + b: f for p in range(300) for b, f in ((0, 30), (1, 70), (2, 90))}
    totals = {}
    for r in moved:
        totals[r.sequence] = totals.get(r.sequence, 0) + fill[r.bin]
    assert max(totals.values()) <= 100 and len(moved) >= 2 * 300 - 4


def test_bpe_round_trip(spark, edge):
    ranks = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    e = bpe.encoding(ranks, public_tokenizers.PATTERN)
    rows = [(i, t) for i, t in edge if not t or t.encode("utf-8", "ignore").decode() == t]
    out = bpe.bpe_decode(bpe.bpe_encode(frame(spark, rows), ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN).collect()
    want = sorted((i, e.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in out) == want
    assert bpe.bpe_encode(frame(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


def brute_bpe(ranks, piece):
    """Ids of one match: pass by pass the pair of the least rank is merged, from the left."""
    tokens = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = {ranks[x]: x for x in {a + b for a, b in itertools.pairwise(tokens)} if x in ranks}
        if not pairs:
            return [ranks[x] for x in tokens]
        best, out, i = pairs[min(pairs)], [], 0
        while i < len(tokens):
            two = i + 1 < len(tokens) and tokens[i] + tokens[i + 1] == best
            out.append(best if two else tokens[i])
            i += 1 + two
        tokens = out


@pytest.fixture(scope="module")
def ranks():
    rows = (x.split() for x in queries.vocabulary("byte_bpe_multi_50k.tiktoken").splitlines())
    return {base64.b64decode(a): int(b) for a, b in rows}


def brute_encode(ranks, text, pattern=public_tokenizers.PATTERN):
    seen = {}
    return [i for m in regex.findall(pattern, text) for i in seen.setdefault(m, brute_bpe(ranks, m.encode()))]


def test_bpe_equals_brute_force(ranks, edge):
    e = bpe.encoding(queries.vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for t in [*(t for i, t in edge if t and i not in (10, 11, 13, 15)), "it's  we'll\n\n 12.5%\u3000 x", "naïve café 日本語テキスト 🙂🙂", "\u00a0\u2003 a \x1c b"]:
        assert bpe.encode(e, t).tolist() == brute_encode(ranks, t)


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, " \n" * 500_000, "a" + "\t " * 600_000 + "b c", "x \u3000" + "\n" * 1_200_000 + "\r", " " * 25_000 + "it's" + " \n" * 15_000 + " 7" + " " * 30_000], ids=range(6))
def test_bpe_of_very_long_blank_runs(ranks, text):
    e = bpe.encoding(queries.vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = bpe.encode(e, text)
    assert got.tolist() == brute_encode(ranks, text)
    assert e.decode_bytes(got.tolist()) == text.encode()


def test_bpe_of_long_runs_by_another_pattern(ranks):
    pattern = r"\s*[\r\n]+|\s+(?!\S)|\s+|\S+"
    e = bpe.encoding(queries.vocabulary("byte_bpe_multi_50k.tiktoken"), pattern)
    for t in ("ab" + " " * 30_000 + "\n" + " " * 21_000 + "cd", " " * 1_100_000):
        assert bpe.encode(e, t).tolist() == brute_encode(ranks, t, pattern)


def test_bpe_rows_of_long_blanks(spark):
    raw = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    rows = [(1, " " * 1_000_001), (2, None), (3, "\n \n" * 400_000 + "x"), (3, "\n \n" * 400_000 + "x")]
    out = bpe.bpe_decode(bpe.bpe_encode(frame(spark, rows), raw, public_tokenizers.PATTERN), raw, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id, bytes(r.decoded)) for r in out) == sorted((i, (t or "").encode()) for i, t in rows)


def test_safe_chunks():
    e = bpe.encoding(queries.vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    r = random.Random(9)
    for _ in range(200):
        t = "".join(r.choice(["a", "B1", " ", "  ", "\n", "'s", "!", "é", " x"]) for _ in range(200))
        parts = list(bpe.chunks(t, 30))
        assert "".join(parts) == t
        assert [i for p in parts for i in e.encode_ordinary(p)] == e.encode_ordinary(t)


def brute_pii(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub(r"[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


def test_pii_base_matches_brute_force(edge):
    r = random.Random(1)
    cases = ["".join(r.choice("a1@.+- ()2") for _ in range(r.randint(0, 60))) for _ in range(3000)] + [t[:2000] for _, t in edge if t]
    assert [pii.base_spans(t) for t in cases] == [brute_pii(t) for t in cases]


def test_semi_crf_on_held_out_lines():
    model = pii.trained()
    found = extra = total = 0
    for text, gold in pii.examples(200, seed=99):
        got = set(model.decode(text))
        total, found, extra = total + len(gold), found + len(got & set(gold)), extra + len(got - set(gold))
    assert found >= 0.97 * total and extra <= 0.03 * total
    assert [k for k, _, _ in pii.all_spans("call (456) 555-2186 or write to joe.b [at] host [dot] com", model)[1]] == [0, 3]
    assert pii.all_spans("version 2.0.1 of 2024-01-02, 12,345 items", model) == ([], [])


def test_semi_crf_sees_whole_texts():
    """All spans are those of the best segmentation of the whole text, wherever earlier triggers lie."""

    def total(m, text, spans):
        tokens, ends = pii.candidates(text)
        out, last = 0.0, -2
        for k, a, b in spans:
            i, j = [x for x, _ in tokens].index(a), [x for _, x in tokens].index(b)
            out += m.weights[dict(ends[j])[i]].sum(0)[k] + m.follow * (last == i - 1)
            last = j
        return out

    model = pii.trained()
    entities = ["(555) 123-4567", "john.smith [at] host [dot] com", "john.smith (at) host.com", "4111 1111 1111 1111", "10[.]1[.]22[.]33", f"{'x' * 200} [at] host [dot] com"]
    for entity in entities:
        assert model.decode(f"so {entity} so")
        for gap in range(220):
            for filler in ("word " * 50, "a . " * 60):
                text = f"on 1 {filler[:gap]} {entity} so"
                want = model.decode(text)
                assert model.find(text) == want and want[-1][2] == len(text) - 3
                base, added = pii.all_spans(text, model)
                assert set(want) <= {*base, *added}
    r = random.Random(5)
    bits = ["7", "12", "4111", "555", "(", ")", "-", ".", "+", "@", "[at]", "(at", "at", "At ", "[dot]", "com", "mail", "visa", ":", "\n", "  ", "é", "x" * 90, " " * 90, " lorem ipsum" * 12, " so . , so" * 20, "(456) 555-2186", "joe.b [at] host [dot] com", "1.2.3.4"]
    for follow in (model.follow, 1.5, -1.5):
        for weak in (0.0, 9.0):  # with 9 even a mere "at" can win
            m = pii.SemiCRF(model.weights.copy(), follow)
            m.weights[pii._INDEX["letters"]] += weak
            for _ in range(60):
                text = "".join(r.choice(bits) + r.choice(("", " ")) for _ in range(r.randint(1, 90)))
                got, want = m.find(text), m.decode(text)
                assert got == want or abs(total(m, text, got) - total(m, text, want)) < 1e-9  # a tie
    text = "call (456) 555-2186 now " * 3000
    assert len(model.find(text)) == 3000


def test_semi_crf_gradient():
    text, gold = next(x for x in pii.examples(50, seed=3) if len(x[1]) > 1)
    model = pii.SemiCRF(np.random.default_rng(0).normal(0, 0.1, pii.SemiCRF().weights.shape), 0.1)
    g, follow, base = model.gradient(text, gold)
    for i, k in ((0, 0), (1, 0), (3, 1), (0, 3)):
        model.weights[i, k] += 1e-5
        assert abs((model.gradient(text, gold)[2] - base) / 1e-5 - g[i, k]) < 1e-2
        model.weights[i, k] -= 1e-5


def test_pii_rows(spark, edge):
    rows = [*edge, (30, "a.b@c.example.com"), (31, "é +1 (456) 555-2186 x")]
    got = {r.doc_id: r for r in pii.pii_spans(frame(spark, rows)).collect()}
    assert got[30].base == ["email:0:17"] and got[31].base == ["phone:2:19"] and got[1].base == []
    clean = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    assert clean[30] == "[email]" and clean[31] == "é [phone] x" and clean[1] is None and clean[4] == "one two"
    assert pii.pii_spans(frame(spark, [])).count() == 0


def toxic_rows(n, seed):
    r = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    out = []
    for _ in range(n):
        y = r.random() < 0.2
        t = [r.choice(words) for _ in range(r.randint(3, 80))]
        for _ in range(r.randint(1, 3) if y else 0):
            t.insert(r.randrange(len(t) + 1), r.choice(["grok", "blarg", "zug" + r.choice("abc")]))
        out.append((" ".join(t), int(y)))
    return out


def test_toxicity_held_out():
    m = toxicity.train(toxic_rows(600, 1))
    test = toxic_rows(300, 2)
    right = sum((m.score(m.tag(t)[0]) >= 0.5) == bool(y) for t, y in test)
    assert right >= 0.98 * len(test)
    assert m.tag("a Grok, b")[1] == [(2, 6)]


def test_toxic_spans_follow_the_marginals_of_each_token():
    m = toxicity.ToxicCRF({"worse": 12.0, "bad": 4.5}, -3.0, np.log(np.array([[0.97, 0.03], [0.7, 0.3]])), np.zeros(4))
    text = "bad a a worse Bad a a bad"
    p, spans = m.tag(text)
    assert [x >= 0.5 for x in p] == [False, True, True, False]
    assert spans == [(8, 13), (14, 17)]
    # a capital whose small form has two characters, of which the second ends a word
    assert m.tag("\u0130x " + text)[1] == [(11, 16), (17, 20)]


def test_crf_marginals_match_enumeration():
    m = toxicity.ToxicCRF({"bad": 3.0}, -1.5, np.log(np.array([[0.8, 0.2], [0.4, 0.6]])), np.zeros(4))
    words = "a b bad c d bad e".split()
    at = [2, 5]
    emit = [np.exp([0, -1.5 + (3.0 if w == "bad" else 0)]) for w in words]
    total, hit = 0.0, np.zeros(2)
    for tags in itertools.product((0, 1), repeat=len(words)):
        p, last = 1.0, 0
        for t, e in zip(tags, emit, strict=True):
            p *= np.exp(m.move[last, t]) * e[t]
            last = t
        total += p
        hit += p * np.array([tags[i] for i in at])
    assert np.allclose(m.marginals(at, [3.0, 3.0], len(words)), hit / total)


def test_expected_transitions_match_enumeration():
    r = random.Random(21)
    for _ in range(30):
        n = r.randint(1, 8)
        at = sorted(r.sample(range(n), r.randint(0, n)))
        e = [r.uniform(-1, 3) for _ in at]
        move, bias = np.log(np.array(toxicity.MOVE)) + r.uniform(-0.5, 0.5), r.uniform(-3, 0)
        z, want = 0.0, np.zeros(3)
        for states in itertools.product((0, 1), repeat=n):
            score = sum(move[a, b] for a, b in zip((0, *states), states, strict=False)) + sum(bias for x in states if x) + sum(v for i, v in zip(at, e, strict=True) if states[i])
            path = [0, *states]
            counts = [sum(a == 0 and b == 1 for a, b in itertools.pairwise(path)), sum(a == b == 1 for a, b in itertools.pairwise(path)), sum(states)]
            z += np.exp(score)
            want += np.exp(score) * np.array(counts)
        assert np.allclose(toxicity.Expectations(move, bias).of(at, e, n), want / z)
    assert toxicity.observed([1, 2, 5, 6, 7], 1).tolist() == [2, 3, 5] and not toxicity.observed([1, 2], 0).any()


def test_toxicity_fit_is_bounded(spark, sf_dir):
    docs, labels = (queries.table(spark, sf_dir, x) for x in ("documents", "labels"))
    twice = docs.unionByName(docs)
    a, b = toxicity.fit(docs, labels), toxicity.fit(twice, labels.unionByName(labels))
    assert a.features == b.features and np.allclose(a.move, b.move)
    assert toxicity.fit(docs, labels, sample_bytes=0).features == {}
    text = docs.first().text
    assert toxicity.fit(docs.limit(0), labels).score([]) < 0.5 and isinstance(a.tag(text)[0], list)


def test_toxicity_rows(spark, edge):
    m = toxicity.train(toxic_rows(400, 1))
    got = toxicity.toxicity(frame(spark, edge), m).collect()
    assert len(got) == len(edge) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    kept = toxicity.reject_toxic(frame(spark, [(1, None), (2, "grok you"), (3, "fine")]), m).collect()
    assert [r.doc_id for r in kept] == [1, 3]
    assert toxicity.toxicity(frame(spark, []), m).count() == 0
    nothing = toxicity.train([("a", 0)])
    assert nothing.score(nothing.tag("grok")[0]) < 0.5
