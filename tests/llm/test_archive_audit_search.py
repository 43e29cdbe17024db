"""The WARC archive, the audit of sources and the ranked search against plain versions, round trips and edge cases."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicat.llm import divergence, lexical, warc, words

# ---------------------------------------------------------------- WARC

PAGES = "page_id long, url string, html string, digest string, n long, payload string, slot int"


def pages(spark, rows):
    """Pages with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, u, h, "d", 3, "p", 1) for i, u, h in rows], PAGES)


def archived(spark, rows, tmp_path, **kw):
    path = str(tmp_path / "archive")
    warc.write_archive(warc.page_records(pages(spark, rows)), path, **kw)
    return path, warc.read_archive(spark, path)


LONG = "<p>é" + "x" * 120


def test_archive_of_repeats_nulls_and_ties(spark, tmp_path):
    rows = [(5, "http://b", LONG), (3, "http://c", LONG), (9, None, LONG), (1, "http://a", "short"), (2, "http://a", "short"), (4, "u", None), (6, "u", ""), (7, "line\r\nbreak", "y" * 100), (8, "v", "y" * 100), (None, "n", "z" * 99), (10, "n", "z" * 99), (11, "t", "w" * 200), (11, "t", "w" * 200), (11, "s", "w" * 200), (None, "q", "k" * 300), (1, "q", "k" * 300)]
    path, out = archived(spark, rows, tmp_path)
    got = out.collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    assert Counter((r.id, bytes(r.payload).decode()) for r in got) == Counter((i, h or "") for i, _, h in rows)
    by = defaultdict(list)
    for r in got:
        assert bytes(r.digest) == hashlib.sha256(bytes(r.payload)).digest()
        by[bytes(r.payload)].append(r)
    for payload, same in by.items():
        responses = [r for r in same if r.record_type == "response"]
        if len(payload) < 100:
            assert len(responses) == len(same) and all(r.refers_to is None for r in same)
        else:
            lead = min((r.id is not None, r.id or 0) for r in same)
            assert len(responses) == 1 and (responses[0].id is not None, responses[0].id or 0) == lead
            assert all(r.refers_to == responses[0].id for r in same if r.record_type == "revisit")
    # each payload is stored once
    stored = [bytes(r.payload) for r in spark.read.parquet(f"{path}/payloads").collect()]
    assert len(stored) == len(set(stored)) == len(by)


def test_records_are_well_formed(spark, tmp_path):
    rows = [(1, "http://a", LONG), (2, "http://a", LONG), (3, "e\r\nWARC-Type: forged", "")]
    _, out = archived(spark, rows, tmp_path)
    got = out.select("id", "payload", "record_type", warc.original_record().alias("raw"), warc.original_record(full=True).alias("full"), warc.field("warc-type").alias("kind"), warc.field("Content-Length").alias("size"), warc.field("WARC-Refers-To").alias("refers"), warc.field("WARC-Record-ID").alias("name"), warc.field("X-No").alias("none")).collect()
    names = {r.id: r.name for r in got}
    for r in got:
        ((at, head, block, after),) = warc.split_records(bytes(r.raw))
        assert at == 0 and after == b"\r\n\r\n" and len(block) == int(r.size) and r.kind == r.record_type and r.none is None
        http, body = block.split(b"\r\n\r\n", 1)
        assert http.startswith(b"HTTP/1.1 200") and body == (b"" if r.kind == "revisit" else bytes(r.payload))
        assert head.count(b"WARC-Type") == 1 + (r.id == 3) and bytes(r.full).endswith(bytes(r.payload) + b"\r\n\r\n")
    assert [r.refers for r in sorted(got, key=lambda r: r.id)] == [None, names[1], None] and len(set(names.values())) == 3
    # all records together are one readable file
    assert len(list(warc.split_records(b"".join(bytes(r.raw) for r in got)))) == 3


def test_a_hot_payload_is_dealt_to_slots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SLOT", 10)
    rows = [(i, f"u{i}", LONG if i % 3 == 0 else f"{i} " * 40) for i in range(300)]
    path, out = archived(spark, rows, tmp_path)
    got = out.collect()
    assert {r.id: bytes(r.payload).decode() for r in got} == {i: h for i, _, h in rows} and all(r.intact for r in got)
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {0}
    per_slot = spark.read.parquet(f"{path}/headers").groupBy("digest", "slot").count().agg(F.max("count")).first()[0]
    assert per_slot < 30


def test_unlike_payloads_of_one_address_are_found(spark, tmp_path):
    def first_bits(payload):
        return F.substring(warc.sha256(payload), 1, 1)

    rows = [(i, "u", f"page {i} " * 20) for i in range(400)]
    with pytest.raises(ValueError, match="address"):
        archived(spark, rows, tmp_path, address=first_bits)


def test_damage_to_the_store_is_told(spark, tmp_path):
    path, _ = archived(spark, [(1, "a", LONG), (2, "b", "other" * 30)], tmp_path)
    stored = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.when(F.col("payload") == F.encode(F.lit(LONG), "UTF-8"), F.encode(F.lit("changed"), "UTF-8")).otherwise(F.col("payload")))
    stored.write.parquet(f"{path}-b/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-b/headers")
    assert {r.id: r.intact for r in warc.read_archive(spark, f"{path}-b").collect()} == {1: False, 2: True}
    stored.limit(0).write.parquet(f"{path}-c/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-c/headers")
    assert [(r.intact, r.payload) for r in warc.read_archive(spark, f"{path}-c").collect()] == [(False, None)] * 2


def test_empty_archive(spark, tmp_path):
    _, out = archived(spark, [], tmp_path)
    assert out.count() == 0


def test_files_come_back_byte_by_byte(spark, tmp_path):
    """Headers in any spelling, blocks with and without HTTP, compressed and plain files, and a damaged one."""
    http = b"HTTP/1.0 404 Not\r\nX: y\r\n\r\n"
    blocks = [http + b"same payload " * 20, b"plain block", http + b"same payload " * 20, b"", b"\r\n\r\nodd\x00\xff" * 9]
    records = [b"WARC/1.0\r\nwarc-type:  response\r\nWARC-Target-URI: <http://%d/>\r\nContent-length: %d\r\nx-odd:\tv\r\n\r\n" % (i, len(b)) + b + b"\r\n\r\n" for i, b in enumerate(blocks)]
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.warc").write_bytes(b"".join(records))
    (folder / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records[::-1])))
    (folder / "c.warc").write_bytes(records[0] + b"no record")
    rows = warc.read_warc(spark, str(folder)).cache()
    errors = rows.where("error is not null").collect()
    assert len(errors) == 1 and errors[0].file.endswith("c.warc") and "byte" in errors[0].error
    path = str(tmp_path / "archive")
    good = rows.where("error is null").drop("error")
    warc.write_archive(good, path, head=F.col("before"), tail=F.col("after"))
    got = warc.read_archive(spark, path).select(warc.original_record(full=True).alias("raw")).collect()
    assert Counter(bytes(r.raw) for r in got) == Counter(records + records + records[:1])
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    assert {r.uri for r in good.collect()} == {f"http://{i}/" for i in range(5)}


# ---------------------------------------------------------------- divergence

DOCS = "doc_id long, text string, lang string, source string, term string, n long, p long, item string"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "t", 1, 2, "x") for i, (lang, s, t) in enumerate(rows)], DOCS)


def brute_divergence(rows, least=10, top=10):
    rows = [(lang or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for lang, s, t in rows]
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, s, t in rows:
        groups[lang].add(s)
        df[lang].update(set(t))
        counts[lang, s].update(t)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        total = Counter()
        for s in sources:
            total.update(counts[lang, s])
        share = lambda c, kept=kept: (lambda n: {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept})(sum(c[t] for t in kept))
        p = {s: share(counts[lang, s]) for s in sources}
        q, f = share(total), lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)}
    return out


def test_divergence_matches_brute_force(spark):
    r = random.Random(4)
    vocabulary = ["the", "of", "Ünder", "ÄPFEL", "x9y", "naïve", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = []
    for _ in range(400):
        lang, s = r.choice(["en", "de", None, "lone"]), r.choice([None, "a", "b", "c", "d-e", "é"])
        rows.append((lang, "only" if lang == "lone" else s, r.choice([None, "", "!?", " ".join(r.choices(vocabulary, k=r.randint(1, 40)))])))
    rows += [("few", "a", "rare words"), ("few", "b", None), ("en", "silent", ""), ("en", "a", "THE the, The\x00the_the" * 500)]
    rows += rows[:30]
    want = brute_divergence(rows)
    for block, shard in ((400_000, 1_000_000), (40, 50)):  # many runs and shards
        got = divergence.source_divergence(docs_frame(spark, rows), block=block, shard=shard).collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_divergence_of_many_sources_in_steps(spark, monkeypatch):
    """More pairs than a step takes and more sums than a task holds."""
    monkeypatch.setattr(divergence, "PAIRS", 30)
    monkeypatch.setattr(divergence, "HELD", 50)
    r = random.Random(8)
    rows = [("xx", f"s{k}", " ".join(r.choices("abcdefgh", k=9))) for k in range(60) for _ in range(3)]
    assert {tuple(x) for x in divergence.source_divergence(docs_frame(spark, rows)).collect()} == brute_divergence(rows)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(docs_frame(spark, [])).count() == 0


def test_shares_are_exact(spark):
    r = random.Random(2)
    rows = [(c, c + r.randint(0, 10**k), r.randint(1, 10**6)) for k in range(1, 16) for c in [r.randint(0, 10**k)]]
    got = spark.createDataFrame(rows, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert all(x.p == 1 + 10**9 * (x.c + 2) // (x.n + 2 * x.v) for x in got)


def test_terms_of_long_texts_in_pieces():
    split = words.Terms(words.LETTERS)
    text = "Ab1éÇ  _xyz\n" * 50
    whole = [t for some in split.of(text) for t in some]
    for piece in (1, 7, 64):
        assert [t for some in split.of(text, piece) for t in some] == whole
    assert whole[:3] == [b"ab", "éÇ".encode(), b"xyz"] and list(split.of("")) == [[]]
    assert [t for some in split.of("x" * 100, 10) for t in some] == [b"x" * 100]


# ---------------------------------------------------------------- ranked search


def brute_search(docs, items, k=20):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    rows = [(i, Counter(tokens(t))) for i, t in docs]
    n, total = sum(1 for _, c in rows if c), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(tokens(text)), []
        for i, c in rows:
            if not c:
                continue
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def search_frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, row string, score int, n int")
    return d, spark.createDataFrame([(i, t, 5, "z") for i, t in items], "item_id long, text string, rank int, terms string")


@pytest.fixture(scope="module")
def searched():
    r = random.Random(6)
    vocabulary = ["die", "der", "und", "Straße", "42", "x1", *(f"t{i}" for i in range(60))]
    docs = [(i, " ".join(r.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=r.choice((1, 5, 30, 200))))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "-- !"), (7, docs[7][1]), (7, docs[7][1]), (None, docs[9][1]), (None, "t1 T2 t3"), (303, "42 " * 70_000)]
    shared = r.sample(vocabulary, 8)
    items = [(k, " ".join([*r.sample(shared, r.randint(2, 8)), *r.choices(vocabulary, k=r.randint(0, 9))])) for k in range(25)]
    items += [(25, None), (26, ""), (27, "nowhere"), (3, "und und UND"), (28, items[4][1]), (29, items[4][1]), (None, "der die")]
    return docs, items


def test_search_matches_brute_force(spark, searched):
    docs, items = searched
    frames = search_frames(spark, docs, items)
    for k, block in ((20, lexical.BLOCK), (3, 40)):
        got = lexical.ranked_search(*frames, k=k, block=block).collect()
        assert Counter(map(tuple, got)) == brute_search(docs, items, k)


def test_search_of_nothing(spark, searched):
    docs, items = searched
    for d, i in (([], items), (docs, []), ([], []), ([(1, None)], items)):
        assert lexical.ranked_search(*search_frames(spark, d, i)).count() == 0


def test_small_batches_and_ties(spark, searched, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 1)
    docs = [(i, "alpha beta") for i in range(900, 0, -1)]
    got = lexical.ranked_search(*search_frames(spark, docs, [(1, "alpha beta gamma"), (2, "beta")])).collect()
    assert got == []  # terms of all documents weigh nothing
    docs += [(10_000 + i, "other") for i in range(900)]
    got = lexical.ranked_search(*search_frames(spark, docs, [(1, "alpha beta gamma")])).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == list(range(1, 21))


def test_plan_is_exact_and_shares_parts():
    r = random.Random(1)
    for _ in range(20):
        core = r.sample(range(80), 12)
        items = [frozenset([*r.sample(core, r.randint(0, 12)), *r.sample(range(80), r.randint(0, 6))]) for _ in range(30)]
        plan = lexical.share_parts(items, 80)

        def leaves(p, plan=plan):
            return Counter([p]) if p < 80 else sum((leaves(x) for x in plan.nodes[p - 80]), Counter())

        ends = {i: leaves(top) for top, at in plan.tops.items() for i in at}
        assert all(set(ends[i]) == x and all(v == 1 for v in ends[i].values()) for i, x in enumerate(items))
        assert all(part < at for at, parts in enumerate(plan.nodes, 80) for part in parts)
        assert plan.edges < sum(map(len, items))
        values = {i: (np.arange(5), np.full(5, i + 1)) for i in range(80)}
        got = dict(lexical.evaluate(plan, values, 5))
        assert all(got[top].tolist() == [sum(x + 1 for x in items[at[0]])] * 5 for top, at in plan.tops.items() if items[at[0]])
