"""Audit of sources: how far the term frequencies of each source are from each other source's and from its language's.

1. Single-pass in-memory indexing: a task counts its documents' terms by (language, source) and the documents of each term
   until its block is full, then spills the block as a run sorted by language and term, written in the shared folder.
2. Runs are dealt by the hash of (language, term) to shards of bounded size; each shard heap-merges its runs into one row a
   term: documents, sources and their counts.  Terms in fewer than ``least`` documents go.
3. Frequencies are smoothed to integers a term and source.  A pair's value is the one of a term that neither source has,
   for all terms; to that come, of each term that a source has, its difference, which needs only how often each count
   occurs; and of each term that both have, a correction, streamed over the merged terms and summed in the task.  So the
   work follows the postings, not terms x sources x sources.
All values are exact 64-bit integers.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bound_batches, lean, materialise, partitions, slices
from .words import LETTERS, Terms

#: Postings of a block before it is spilled (about 60 MB).
BLOCK = 400_000
#: Postings of a shard, about.
SHARD = 1_000_000
#: Pairs of sources that a task works on at a time, and sums it holds before it hands them on.
PAIRS, HELD = 1_000_000, 500_000
#: Rows of a window of merged runs, about.
WINDOW = 100_000
#: Frequencies are parts of so many.
SCALE = 1_000_000_000

_RUN = "run long, lang string, term string, docs long, sources array<string>, counts array<long>"
_MERGED = "lang string, term string, docs long, sources array<string>, counts array<long>"


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


class Block:
    """Postings in memory: counts by (language, source) and term, and documents by language and term."""

    def __init__(self):
        self.counts: dict[str, dict[str, Counter]] = {}
        self.docs: dict[str, Counter] = {}
        self.size = 0

    def add(self, lang: str, source: str, terms: Iterator[list[bytes]]) -> None:
        """One document."""
        counts = self.counts.setdefault(lang, {}).setdefault(source, Counter())
        docs = self.docs.setdefault(lang, Counter())
        before, seen = len(counts) + len(docs), set()
        for some in terms:
            counts.update(some)
            seen.update(some)
        docs.update(seen)
        self.size += len(counts) + len(docs) - before

    def runs(self, run: int) -> Iterator[pa.RecordBatch]:
        """The block's rows in the order of (language, term)."""
        for lang in sorted(self.docs):
            docs, counts = self.docs[lang], self.counts[lang]
            terms, sources = sorted(docs), sorted(counts)
            if not terms:
                continue
            place = dict(zip(terms, range(len(terms)), strict=True))
            t = np.concatenate([np.fromiter(map(place.__getitem__, counts[s]), np.int64, len(counts[s])) for s in sources])
            s = np.repeat(np.arange(len(sources)), [len(counts[x]) for x in sources])
            n = np.concatenate([np.fromiter(counts[x].values(), np.int64, len(counts[x])) for x in sources])
            order = np.argsort(t, kind="stable")  # sources stay in order
            ends = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=len(terms)))))
            names = pa.array(sources, pa.string())
            for lo in range(0, len(terms), 20_000):
                hi = min(lo + 20_000, len(terms))
                own = order[ends[lo] : ends[hi]]
                at = ends[lo : hi + 1] - ends[lo]
                columns = [pa.array(np.full(hi - lo, run)), pa.array([lang] * (hi - lo), pa.string()), pa.array(terms[lo:hi], pa.binary()).cast(pa.string()), pa.array([docs[x] for x in terms[lo:hi]], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, _lists(at, names.take(pa.array(s[own]))), _lists(at, pa.array(n[own]))], names=["run", "lang", "term", "docs", "sources", "counts"])


def _spill(rows: DataFrame, block: int) -> DataFrame:
    """The sorted runs of (lang, source, text)."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, run = Terms(LETTERS), Block(), TaskContext.get().partitionId() << 32
        for part in (p for batch in batches for p in slices(batch)):
            for lang, source, text in zip(*(part[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                held.add(lang, source, split.of(text))
                if held.size >= block:
                    yield from held.runs(run)
                    held, run = Block(), run + 1
        yield from held.runs(run)

    return rows.mapInArrow(lean(index), _RUN)


def _key(rows: pa.RecordBatch, at: int) -> tuple[bytes, bytes]:
    return rows["lang"][at].as_py().encode(), rows["term"][at].as_py().encode()


def _windows(runs: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of sorted runs in windows of keys, in order: the rows of a key are in one window.

    A heap holds, of each run, the key some rows ahead; the smallest bounds the next window, and each run gives its rows up to
    there.
    """
    at, step = [0] * len(runs), max(1, WINDOW // max(1, len(runs)))
    ahead = lambda r, k: min(k + step, runs[r].num_rows)
    heap = [(_key(run, ahead(r, 0) - 1), r, ahead(r, 0)) for r, run in enumerate(runs) if run.num_rows]
    heapq.heapify(heap)
    while heap:
        taken, bound = 0, None
        while heap and taken < WINDOW:
            bound, r, end = heapq.heappop(heap)
            taken += step
            if end < runs[r].num_rows:
                heapq.heappush(heap, (_key(runs[r], ahead(r, end) - 1), r, ahead(r, end)))
        parts = []
        for r, run in enumerate(runs):
            lo, hi = at[r], run.num_rows
            while lo < hi:  # the first row behind the bound
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if _key(run, mid) <= bound else (lo, mid)
            if lo > at[r]:
                parts.append(run.slice(at[r], lo - at[r]))
                at[r] = lo
        if parts:
            yield pa.concat_batches(parts)


def _summed(rows: pa.RecordBatch, least: int) -> pa.RecordBatch:
    """One row a key of at least so many documents, its sources in order."""
    # a term has no zero byte, so the last one of a key ends its language
    keys = pc.binary_join_element_wise(rows["lang"], rows["term"], "\0").dictionary_encode().indices.to_numpy()
    docs = np.zeros(int(keys.max(initial=-1)) + 1, np.int64)
    np.add.at(docs, keys, rows["docs"].to_numpy())
    kept = np.flatnonzero(docs >= least)
    mine = rows.filter(pa.array(docs[keys] >= least))
    keys_kept = keys[docs[keys] >= least]
    sizes = np.diff(mine["sources"].offsets.to_numpy())
    sources = mine["sources"].flatten().dictionary_encode()
    names = sorted(enumerate(sources.dictionary.to_pylist()), key=lambda x: x[1].encode())
    place = np.zeros(len(names), np.int64)
    place[[i for i, _ in names]] = np.arange(len(names))
    width = max(1, len(names))
    cells, cell = np.unique(np.repeat(keys_kept, sizes) * width + place[sources.indices.to_numpy()], return_inverse=True)
    counts = np.zeros(len(cells), np.int64)
    np.add.at(counts, cell, mine["counts"].flatten().to_numpy())
    offsets = np.append(np.searchsorted(cells, kept * width), len(cells))
    _, first = np.unique(keys_kept, return_index=True)
    first = pa.array(first)
    ordered = pa.array([n for _, n in names], pa.string()).take(pa.array(cells % width))
    return pa.RecordBatch.from_arrays([mine["lang"].take(first), mine["term"].take(first), pa.array(docs[kept]), _lists(offsets, ordered), _lists(offsets, pa.array(counts))], names=["lang", "term", "docs", "sources", "counts"])


def _merge(runs: DataFrame, least: int, shard: int) -> DataFrame:
    """One row for each (language, term) in ``least`` documents or more."""
    postings = runs.agg(F.coalesce(F.sum(F.size("sources")), F.lit(0))).first()[0]
    shards = max(partitions(runs.sparkSession), -(-postings // shard))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[pa.RecordBatch]] = []  # sorted runs of this shard
        latest: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            run = batch["run"].to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                known = latest.get(int(run[lo]))
                if known and _key(known[-1], known[-1].num_rows - 1) <= _key(part, 0):
                    known.append(part)
                else:  # a new run, or a part that came out of order: a run of its own
                    latest[int(run[lo])] = parts = [part]
                    found.append(parts)
        for window in _windows([pa.concat_batches(parts) for parts in found]):
            yield _summed(window, least)

    dealt = runs.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    return dealt.repartitionById(shards, F.col("shard")).drop("shard").mapInArrow(lean(merge), _MERGED)


def _div(a: Column, b: Column) -> Column:
    """Whole division of 64-bit integers."""
    return F.call_function("div", a, b)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exactly: three steps of long division by a thousand, so that
    nothing overflows below 9e15 occurrences."""
    rest, by = count + 2, total + 2 * terms
    out = _div(rest, by)
    rest = rest % by
    for _ in range(3):
        out = out * 1000 + _div(rest * 1000, by)
        rest = rest * 1000 % by
    return out + 1


def spread(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _corrections(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value) of each pair of sources a < b with common terms, from rows (lang, sources, p, zero): what the
    terms that both have differ from what their own differences say, summed."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: dict[tuple[str, str], int] = {}
        names: list[tuple[str, str]] = []
        sums: dict[int, int] = {}

        def summed() -> pa.RecordBatch:
            pairs = [(names[k >> 32], names[k & 0xFFFFFFFF], v) for k, v in sums.items()]
            return pa.RecordBatch.from_arrays([pa.array([a[0] for a, _, _ in pairs], pa.string()), pa.array([a[1] for a, _, _ in pairs], pa.string()), pa.array([b[1] for _, b, _ in pairs], pa.string()), pa.array([v for *_, v in pairs], pa.int64())], names=["lang", "a", "b", "value"])

        for batch in batches:
            for part in slices(batch, 2_000_000):
                sizes = np.diff(part["sources"].offsets.to_numpy())
                ids = []
                for lang, sources in zip(part["lang"].to_pylist(), part["sources"].to_pylist(), strict=True):
                    for s in sources:
                        if (c := code.get((lang, s))) is None:
                            c = code[lang, s] = len(names)
                            names.append((lang, s))
                        ids.append(c)
                ids = np.array(ids, np.int64)
                p, zero = (part[c].flatten().to_numpy(zero_copy_only=False) for c in ("p", "zero"))
                ends = np.repeat(np.cumsum(sizes), sizes)
                later = ends - np.arange(len(ids)) - 1  # partners of each posting: those behind it
                steps = np.cumsum(later)
                lo = 0
                while lo < len(ids):
                    hi = max(lo + 1, int(np.searchsorted(steps, (steps[lo - 1] if lo else 0) + PAIRS, "right")))
                    left = np.repeat(np.arange(lo, hi), later[lo:hi])
                    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later[lo:hi]) - later[lo:hi], later[lo:hi])
                    value = f(p[left], p[right]) - f(p[left], zero[right]) - f(zero[left], p[right]) + f(zero[left], zero[right])
                    keys, at = np.unique(ids[left] << 32 | ids[right], return_inverse=True)
                    total = np.zeros(len(keys), np.int64)
                    np.add.at(total, at, value)
                    for k, v in zip(keys.tolist(), total.tolist(), strict=True):
                        sums[k] = sums.get(k, 0) + v
                    if len(sums) >= HELD:
                        yield summed()
                        sums.clear()
                    lo = hi
        if sums:
            yield summed()

    return rows.mapInArrow(lean(run), "lang string, a string, b string, value long")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 10, top: int = 10, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(lang, source, part, item, value, rank) of each source of each language.

    Terms are runs of letters and characters beyond ASCII; those in ``least`` documents of the language are kept.
    Part ``pair``: the divergence from each other source of the language; part ``term``: the ``top`` kept terms that the
    source has more of than the language.  Null texts, languages and sources are empty.  Repeated rows count each.  A
    language without kept terms has pairs of value 0; one with a single source has none; an empty table gives an empty
    one.  Ties rank by the item's bytes.  Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    word = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(word(lang_col).alias("lang"), word(source_col).alias("source"), word(text_col).alias("text"))
    runs = materialise(_spill(rows, block), "runs")
    kept = materialise(_merge(runs, least, shard), "terms")
    postings = kept.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("in_lang"), F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", "in_lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))

    # one row a group: how many occurrences of kept terms, how many such terms the language has, and the share of an absent one
    groups = rows.select("lang", "source").distinct()
    sums = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("lang_n"))
    zero = F.lit(0).cast("long")
    groups = groups.join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v"), F.coalesce("lang_n", zero).alias("lang_n"))
    groups = materialise(groups.withColumn("zero", F.when(F.col("v") > 0, share(zero, F.col("n"), F.col("v")))), "groups")

    shares = postings.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))
    terms = shares.withColumn("q", share(F.col("in_lang"), F.col("lang_n"), F.col("v"))).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), spread(F.col("p"), F.col("q")).alias("value"))

    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    absent = groups.join(other, "lang").where(F.col("source") != F.col("item")).select("lang", "source", "item", F.coalesce(F.col("v") * spread(F.col("zero"), F.col("other")), zero).alias("value"))
    often = shares.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("n"))
    own = often.join(other, "lang").where(F.col("source") != F.col("item")).groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (spread(F.col("p"), F.col("other")) - spread(F.col("zero"), F.col("other")))).alias("value"))
    own = materialise(own, "own")
    together = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "zero"))).alias("x"))  # no longer than the language has sources
    both = materialise(_corrections(together.where(F.size("x") > 1).select("lang", F.col("x.source").alias("sources"), F.col("x.p").alias("p"), F.col("x.zero").alias("zero"))), "both")
    turned = lambda df, a, b: df.select("lang", F.col(a).alias("source"), F.col(b).alias("item"), "value")
    pairs = absent
    for df, a, b in ((own, "source", "item"), (own, "item", "source"), (both, "a", "b"), (both, "b", "a")):
        pairs = pairs.unionByName(turned(df, a, b))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    out = pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", "rank")
