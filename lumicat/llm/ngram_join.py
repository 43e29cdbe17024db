"""N-gram Jaccard self-join by T-occurrence search (DivideSkip).

Documents become sets of 64-bit shingle hashes.  Two sets of sizes a and b link when den * overlap >= num * union, so a
set of size s can only link to sets with which it shares at least T(s) = ceil(num * s / den) shingles.

Distributed plan
1. Every document's set is hashed; equal sets form one class (rid).  Copies never meet in pairs.
2. Document frequencies of all shingles are counted as packed, sorted runs per hash bucket; the most frequent ones (a
   bounded table, see ``MAX_LONG``) are the *long* inverted lists.
3. In the order "short lists by hash, then long lists by frequency", T - 1 of a set's lists are set aside and the other
   s - T + 1 are posted: any linked pair meets in one of those lists.  The lists set aside are the ones DivideSkip
   leaves to probing.
4. Star round: in each list, members are searched against the list's pivot; groups of near copies collapse.  Very
   frequent lists lie in parts of bounded size, each with its pivot, and their pivots form stars as well.
5. Cross round: lists that still hold several components give the pairs not yet known to be connected, if the position
   of the shared shingle leaves enough room for the overlap; those are searched as well.  A long list is dealt into
   blocks, and a task takes two of them.
In 4 and 5 the search inside a cell of bounded size is DivideSkip: a heap merges the short lists and counts, survivors
are probed in the long lists by binary search, and documents that reach the overlap are retained.
6. Components by star contraction.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, lean, materialise, mix64, partitions, powers, release, slices, texts
from .components import components
from .filters import sent_filter

#: Long lists known to every task: at most so many (9 bytes each).  The frequency from which a list is long rises until
#: they fit; this changes only the order of the lists, not the result.
MAX_LONG = 2_000_000
#: Shingle hashes gathered before a sorted run is flushed (16 MB).
RUN = 2_000_000
#: Members of one search cell besides its pivot.
CELL = 128
#: Shingles that a cell's index holds beyond its pivot's.
INDEXED = 300_000
#: Members up to which the pairs of lists are made for many lists at once.
SHORT = 48
#: Lists that this power of two of documents share lie in parts of about so many members.
SPLIT = 16
#: Members of one block of a list in the cross round; a task holds two blocks.
BLOCK = 20_000
#: DivideSkip's coefficient for the number of long lists.
MU = 0.0085
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: A word's hash is a polynomial in an odd base over random values of its bytes, by running sums over the whole text.
_BASE = 0xE7037ED1A0B428DB
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACE)] = False
_CUT = re.compile(rb"[ \t-\r]")
#: Bytes hashed at a time, up to the next separator.
CHUNK = 1 << 18


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    out, at = [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > CHUNK and (m := _CUT.search(raw, at + CHUNK)):
            end = m.start()
        b = np.frombuffer(raw, np.uint8, end - at, at)
        word = np.zeros(len(b) + 2, bool)
        word[1:-1] = _IS_WORD[b]
        edge = np.flatnonzero(word[1:] != word[:-1])
        first, last = edge[::2], edge[1::2]
        power, inverse = powers(len(b), _BASE)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTES[b] * power[: len(b)], out=sums[1:])
        out.append(mix64((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)))
        at = end
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; the whole sequence as one where there are fewer words."""
    w = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    if not len(w):
        return w
    if len(w) < n:
        return np.array([xxhash.xxh3_64_intdigest(w.tobytes(), seed=len(w))], np.uint64)
    m = len(w) - n + 1
    acc = w[:m] * _FACTORS[0]
    for j in range(1, n):
        acc = acc * np.uint64(0xD1342543DE82EF95) + w[j : j + m] * _FACTORS[j % 5]
    acc = mix64(acc)
    acc.sort()
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))] if m > 1 else acc


def set_id(s: np.ndarray) -> int:
    """One signed 64-bit id per set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))).astype(np.int64))


def need(a: int, b: int, num: int, den: int) -> int:
    """Least overlap with which sets of sizes a and b link."""
    return -(-num * (a + b) // (num + den))


class DivideSkip:
    """Inverted index over integer sets that answers T-occurrence queries.

    ``search`` returns the (key, overlap) of every indexed set that links to the query.
    """

    def __init__(self, num: int, den: int, mu: float = MU):
        self.num, self.den, self.mu = num, den, mu
        self.lists: dict[int, list[int]] = {}
        self.sizes: list[int] = []
        self.keys: list[int] = []

    def add(self, key: int, s: np.ndarray) -> None:
        i = len(self.sizes)
        self.sizes.append(len(s))
        self.keys.append(key)
        lists = self.lists
        for x in s.tolist():
            lists.setdefault(x, []).append(i)

    def search(self, s: np.ndarray) -> list[tuple[int, int]]:
        size = len(s)
        if not size or not self.sizes:
            return []
        # a partner b has overlap >= need(size, b), and b >= num * size / den
        least = need(size, max(min(self.sizes), -(-self.num * size // self.den)), self.num, self.den)
        lists = [x for x in map(self.lists.get, s.tolist()) if x]
        if len(lists) < least:
            return []
        lists.sort(key=len, reverse=True)
        long = min(least - 1, int(least / (self.mu * log2(len(lists[0]) + 1) + 1)))
        probed, merged = lists[:long], lists[long:]
        found, out = [], []
        last, count = -1, 0
        for i in heapq.merge(*merged) if len(merged) > 1 else merged[0]:
            if i == last:
                count += 1
            else:
                if last >= 0 and count >= least - long:
                    found.append((last, count))
                last, count = i, 1
        if last >= 0 and count >= least - long:
            found.append((last, count))
        for i, count in found:
            t = need(size, self.sizes[i], self.num, self.den)
            left = len(probed)
            for x in probed:
                if count + left < t:
                    break
                left -= 1
                at = bisect_left(x, i)
                count += at < len(x) and x[at] == i
            if count >= t:
                out.append((self.keys[i], count))
        return out


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 75, den: int = 100, split: int = SPLIT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Null and empty texts, and texts of separators only, have the empty set, link to nothing and are their own component.
    Texts of fewer than ``n`` words have one shingle.  Repeated rows are kept; rows that share an id count by their own
    text each.  Null ids link like others and name a component only if it has no other id.  Other columns are ignored.
    An empty table gives an empty table.  ``split`` and ``block`` bound what a task holds and don't change the result.
    """
    docs = texts(docs, id_col, text_col)
    index = materialise(_index(docs, n), "sets")
    buckets = _ranges(docs.sparkSession, index.agg(F.sum("n_shingles")).first()[0] or 0)
    classes = materialise(index.where("n_shingles > 0").groupBy("rid", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    posted = materialise(_lists(docs, n, num, den, buckets, split), "lists")
    release(docs.sparkSession)
    wanted = materialise(posted.select("rid").distinct().join(classes, "rid").select("rid", "rep"), "wanted")
    held = materialise(_texts_of(docs, wanted, n), "texts")
    release(docs.sparkSession)
    # star round: each part of a list by its pivot, and the pivots of a list by the first of them
    parts = posted.where("split").select("hash", "pivot", "pivot_n").distinct()
    first = parts.groupBy("hash").agg(F.min(F.struct(F.xxhash64("pivot").alias("x"), F.col("pivot"), F.col("pivot_n"))).alias("f"))
    tops = parts.join(first, "hash").select(F.col("f.pivot").alias("a"), F.col("pivot").alias("b"), F.col("pivot_n").alias("n"), F.col("f.pivot_n").alias("pivot_n"))
    stars = posted.select(F.col("pivot").alias("a"), F.col("rid").alias("b"), "n", "pivot_n").unionByName(tops).where("a <> b")
    stars = stars.where(f"{den} * least(n, pivot_n) >= {num} * greatest(n, pivot_n)").select("a", "b").distinct()
    stars = materialise(stars, "pairs")
    links = materialise(_verify(stars, held, n, num, den, buckets), "links")
    label = materialise(components(links), "labels")
    # cross round
    tagged = posted.join(label.withColumnRenamed("node", "rid"), "rid", "left").select("hash", "rid", "n", "slack", F.coalesce("component", "rid").alias("component"))
    pairs = materialise(_cross(tagged, num, den, buckets, block).distinct(), "pairs")
    more = materialise(_verify(pairs, held, n, num, den, buckets), "links")
    discard(posted, held, stars, pairs)
    names = materialise(components(links.unionByName(more)), "labels")
    # a class is named after its smallest document, a component after its smallest class; no aggregate stands in the stage
    # of a join, so that hot components and classes can be split
    named = classes.join(names.withColumnRenamed("node", "rid"), "rid", "left").select("rid", "n_shingles", "rep", F.coalesce("component", "rid").alias("c"))
    named = materialise(named, "named")
    least = materialise(named.groupBy("c").agg(F.min("rep").alias("component_id")), "least")
    named = named.join(least, "c").select("rid", F.col("n_shingles").alias("size"), "component_id")
    same = (index.rid == named.rid) & (index.n_shingles == named["size"])
    return index.join(named, same, "left").select("doc_id", "n_shingles", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _ranges(spark, shingles: int) -> int:
    """Hash ranges for so many shingles: their number grows with the power two thirds, their size with one third, from
    64 of a quarter of a million to hundreds of thousands of 25 million at 10^13."""
    return max(64, partitions(spark), int(shingles ** (2 / 3) / 1000))


def _index(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [(len(s), set_id(s) if len(s) else None) for s in (shingle_set(t, n) for t in part["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([k for k, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], names=["doc_id", "n_shingles", "rid"])

    return docs.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, rid long")


def _texts_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """One text of each wanted class (rid, rep).  A filter of the representatives' ids passes few other rows; only what it
    passes is hashed again and moved."""
    keys = wanted.select(F.xxhash64("rep").alias("key"))
    ids = docs.sparkSession.sparkContext.broadcast(sent_filter(keys, wanted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            part = part.filter(pa.array(ids.value.may_hold(part["key"].to_numpy(zero_copy_only=False))))
            found = [set_id(s) if len(s := shingle_set(t, n)) else None for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), part["text"]], names=["rid", "text"])

    rows = docs.select(F.xxhash64("doc_id").alias("key"), "text").mapInArrow(lean(run), "rid long, text string")
    return rows.join(wanted.select("rid"), "rid", "left_semi").groupBy("rid").agg(F.first("text").alias("text"))


def _bucketed(rows: DataFrame, reduce, schema: str, buckets: int) -> DataFrame:
    """``rows`` (bucket, ...) dealt so that each bucket is one partition, then reduced."""
    return rows.repartitionById(buckets, F.col("bucket")).mapInArrow(lean(reduce), schema)


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted hashes pass from one bucket (a range of equal width) to the next."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)]))


def _frequent(docs: DataFrame, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The long lists: sorted hashes and the binary logarithm of their document frequency, in which equal sets that a
    task meets count once.  Runs go to the ranges with equal hashes folded: those of one document, then the others with
    their counts."""

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        # 48 bits of a hash; a collision only misplaces a shingle in the order
        h, count = np.unique(np.concatenate(parts) & _UPPER, return_counts=True)
        at = _cuts(h, buckets)
        full = np.flatnonzero(at[1:] > at[:-1])
        packed = []
        for b in full:
            x, c = h[at[b] : at[b + 1]], count[at[b] : at[b + 1]].astype("<u4")
            packed.append(int((c == 1).sum()).to_bytes(4, "little") + _pack(x[c == 1]) + _pack(x[c > 1]) + c[c > 1].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "hashes"])

    def unpack(x: bytes) -> np.ndarray:
        """Hashes in the upper 48 bits, counts (65,535 at most) in the lower 16: one sort brings them together."""
        ones = int.from_bytes(x[:4], "little")
        more = (len(x) - 4 - 6 * ones) // 10
        cut = 4 + 6 * (ones + more)
        h = _unpack(x[4:cut]) << np.uint64(16)
        h[:ones] |= np.uint64(1)
        h[ones:] |= np.minimum(np.frombuffer(x, "<u4", more, cut), 65535).astype(np.uint64)
        return h

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts, held = set(), [], 0
        for batch in batches:
            for part in slices(batch):
                for t in part["text"].to_pylist():
                    s = shingle_set(t, n)
                    if _seen(seen, s):
                        continue
                    parts.append(s)
                    if (held := held + len(s)) >= RUN:
                        yield flush(parts)
                        parts, held = [], 0
        if held:
            yield flush(parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [unpack(x) for batch in batches for x in batch["hashes"].to_pylist()]
        if not got:
            return
        h = np.concatenate(got)
        got.clear()
        h.sort()
        c, h = (h & np.uint64(65535)).astype(np.int64), h >> np.uint64(16)
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        df = np.add.reduceat(c, start)
        h, df = h[start[df >= 8]], df[df >= 8]
        level = np.floor(np.log2(df)).astype(np.int32) if len(df) else df.astype(np.int32)
        for x in np.unique(level):
            mine = h[level == x]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int32()), pa.array([len(mine)], pa.int64()), pa.array([mine.tobytes()], pa.binary())], names=["level", "n", "hashes"])

    found = materialise(_bucketed(docs.select("text").mapInArrow(lean(runs), "bucket int, hashes binary"), count, "level int, n long, hashes binary", buckets), "frequent")
    total, from_level = 0, 99
    for r in found.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():  # one row a power of two
        if (total := total + r.n) > MAX_LONG:
            break
        from_level = r.level
    rows = found.where(F.col("level") >= from_level).select("level", "hashes").collect()  # MAX_LONG hashes at most
    discard(found)
    h = np.concatenate([np.frombuffer(r.hashes, np.uint64) for r in rows] or [np.empty(0, np.uint64)])
    level = np.concatenate([np.full(len(r.hashes) // 8, r.level, np.uint8) for r in rows] or [np.empty(0, np.uint8)])
    order = np.argsort(h)
    return h[order], level[order]


def _seen(seen: set[int], s: np.ndarray) -> bool:
    """Whether the set is empty or was met before by this task; forgetting only has a copy counted or posted again."""
    if not len(s) or (rid := set_id(s)) in seen:
        return True
    if len(seen) >= 1_000_000:
        seen.clear()
    seen.add(rid)
    return False


#: The part of a hash that travels; the lower bits are free.
_UPPER = np.uint64(0xFFFFFFFFFFFF0000)


def _pack(h: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, 6 bytes each."""
    return np.ascontiguousarray((h >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _lists(docs: DataFrame, n: int, num: int, den: int, buckets: int, level: int) -> DataFrame:
    """Posted inverted lists of two members or more: (hash, rid, n, slack, pivot, pivot_n, split); slack: shingles from
    this one on in the set's order; split: the list lies in several parts, each with its own pivot, as those of more than
    2^level documents do."""
    spark = docs.sparkSession
    long = spark.sparkContext.broadcast(_frequent(docs, n, buckets))
    release(spark)
    record = np.dtype([("hash", "<u8"), ("rid", "<i8"), ("n", "<u4"), ("slack", "<u4")])  # a posting's level is in its hash's lower bits

    def pack(p: np.ndarray) -> bytes:
        """Columns, those of small numbers byte plane by byte plane: the exchange's compression then drops their zeros."""
        planes = [np.ascontiguousarray(p[c]).view(np.uint8).reshape(-1, 4).T.tobytes() for c in ("n", "slack")]
        return b"".join([len(p).to_bytes(4, "little"), _pack(np.ascontiguousarray(p["hash"])), p["rid"].tobytes(), *planes])

    def unpack(x: bytes) -> np.ndarray:
        k = int.from_bytes(x[:4], "little")
        p = np.empty(k, record)
        p["hash"], p["rid"] = _unpack(x[4 : 4 + 6 * k]), np.frombuffer(x, "<i8", k, 4 + 6 * k)
        for i, c in enumerate(("n", "slack")):
            p[c] = np.ascontiguousarray(np.frombuffer(x, np.uint8, 4 * k, 4 + 14 * k + 4 * k * i).reshape(4, k).T).view("<u4").ravel()
        return p

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        p = np.concatenate(parts)
        p = p[np.argsort(p["hash"], kind="stable")]
        rank = p["hash"] & ~_UPPER
        often = rank > level
        found = []
        for split, q in ((False, p[~often]), (True, p[often])) if often.any() else ((False, p),):
            at = _cuts(q["hash"], buckets)
            for b in np.flatnonzero(at[1:] > at[:-1]).tolist():
                x = q[at[b] : at[b + 1]]
                if not split:
                    found.append((b, False, pack(x)))
                    continue
                # the parts of a very frequent list go to the ranges after its own
                salt = (mix64(x["rid"].astype(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)) >> (np.uint64(64) - np.minimum((x["hash"] & ~_UPPER) - np.uint64(level), np.uint64(40)))).astype(np.int64)
                to = (b + salt) % buckets
                found += [(int(k), True, pack(x[to == k])) for k in np.unique(to)]
        cols = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.binary())], names=["bucket", "split", "postings"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, levels = long.value
        seen, parts, held = set(), [], 0
        for batch in batches:
            for part in slices(batch):
                for t in part["text"].to_pylist():
                    s = shingle_set(t, n)
                    if _seen(seen, s):
                        continue
                    rank = np.zeros(len(s), np.uint8)
                    if len(keys):
                        short = s >> np.uint64(16)
                        at = np.searchsorted(keys, short)
                        at[at == len(keys)] = 0
                        rank = np.where(keys[at] == short, levels[at], rank)
                    order = np.argsort(rank, kind="stable") if rank.any() else slice(None)
                    size = len(s)
                    keep = size - -(-num * size // den) + 1
                    p = np.empty(keep, record)
                    p["hash"] = s[order][:keep] & _UPPER | rank[order][:keep]
                    p["rid"], p["n"], p["slack"] = set_id(s), size, size - np.arange(keep)
                    parts.append(p)
                    if (held := held + keep) >= RUN // 3:
                        yield flush(parts)
                        parts, held = [], 0
        if held:
            yield flush(parts)

    def lists(p: np.ndarray, split: bool) -> Iterator[pa.RecordBatch]:
        if not split:  # a list of one member is of no use; one member of a part is
            h = np.sort(p["hash"])
            twice = np.unique(h[1:][h[1:] == h[:-1]])
            if not len(twice):
                return
            at = np.searchsorted(twice, p["hash"])
            at[at == len(twice)] = 0
            p = p[twice[at] == p["hash"]]
        # the member that comes first in one random order of all sets is its lists' pivot
        p = p[np.lexsort((mix64(p["rid"].astype(np.uint64)), p["hash"]))]
        p = p[np.concatenate(([True], (p["hash"][1:] != p["hash"][:-1]) | (p["rid"][1:] != p["rid"][:-1])))]
        start = np.flatnonzero(np.concatenate(([True], p["hash"][1:] != p["hash"][:-1])))
        length = np.diff(np.append(start, len(p)))
        first = np.repeat(start, length)
        keep = np.repeat(length > 1, length) | split
        p, pivot = p[keep], p[first[keep]]
        for i in range(0, len(p), 200_000):
            q, v = p[i : i + 200_000], pivot[i : i + 200_000]
            cols = [np.ascontiguousarray(q["hash"]).view(np.int64), np.ascontiguousarray(q["rid"]), q["n"].astype(np.int64), q["slack"].astype(np.int64), np.ascontiguousarray(v["rid"]), v["n"].astype(np.int64), np.full(len(q), split)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["hash", "rid", "n", "slack", "pivot", "pivot_n", "split"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[bool, list[np.ndarray]] = {}
        for batch in batches:
            for split, x in zip(batch["split"].to_pylist(), batch["postings"].to_pylist(), strict=True):
                got.setdefault(split, []).append(unpack(x))
        for split in list(got):
            yield from lists(np.concatenate(got.pop(split)), split)

    posted = docs.select("text").mapInArrow(lean(post), "bucket int, split boolean, postings binary")
    return _bucketed(posted, group, "hash long, rid long, n long, slack long, pivot long, pivot_n long, split boolean", buckets)


def _verify(pairs: DataFrame, held: DataFrame, n: int, num: int, den: int, buckets: int) -> DataFrame:
    """Links (a, b) among ``pairs``.  The b of one a are dealt over cells of about ``CELL``; in a cell each b is searched
    in an index of a and of earlier members that linked to nothing, so each given pair is decided exactly."""
    # only pivots of more than one cell are looked up, in a table of at most one row a CELL pairs that is written first:
    # no aggregate stands in the join's stage, so that a pivot of very many pairs can be split
    size = materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / CELL).alias("cells")).where("cells > 1"), "cells")
    dealt = pairs.join(size, "a", "left").select("a", F.coalesce(F.pmod(F.xxhash64("b"), "cells"), F.lit(0)).alias("cell"), "b")
    lead = dealt.select("a", "cell", F.col("a").alias("b"), F.lit(0).alias("place")).distinct()
    cells = dealt.select("a", "cell", "b", F.lit(1).alias("place")).unionByName(lead)
    rows = cells.join(held.select(F.col("rid").alias("b"), "text"), "b")
    rows = rows.repartition(buckets, "a", "cell").sortWithinPartitions("a", "cell", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, room = None, DivideSkip(num, den), 0
        for batch in batches:
            found: list[tuple[int, int]] = []
            for part in slices(batch):
                for a, cell, b, text in zip(*(part[c].to_pylist() for c in ("a", "cell", "b", "text")), strict=True):
                    if (a, cell) != at:
                        at, index, room = (a, cell), DivideSkip(num, den), INDEXED
                    s = shingle_set(text, n)
                    hits = index.search(s)
                    found += [(k, b) for k, _ in hits]
                    if b == a or not hits and len(s) <= room:
                        index.add(b, s)
                        room -= len(s) * (b != a)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.select("a", "cell", "b", "text").mapInArrow(lean(run), "a long, b long").where("a <> b")


def _cross(tagged: DataFrame, num: int, den: int, buckets: int, size: int) -> DataFrame:
    """Pairs of a list in different components for which the shared shingle can be their first one: the shingles from it
    on must suffice for the overlap.  Members are compared by classes of (size, slack), not one by one.  A list of more
    than ``size`` members is dealt into blocks; each two of them meet in one cell, and pairs leave in bounded batches."""
    multi = tagged.groupBy("hash").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / size).alias("blocks")).where("lo <> hi").select("hash", "blocks")
    rows = tagged.join(materialise(multi, "multi"), "hash").withColumn("block", F.pmod(F.xxhash64("rid"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("cell", F.xxhash64("hash", F.least("block", "other"), F.greatest("block", "other"))).withColumn("alone", F.col("block") == F.col("other"))
    rows = rows.repartition(buckets, "cell").sortWithinPartitions("cell")
    limit = 500_000

    def pairs(rid, size, slack, comp, block, alone) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        kinds, of = np.unique(np.stack((size, slack), 1), axis=0, return_inverse=True)
        of = of.ravel()
        order = np.lexsort((comp, of))
        rid, comp, of, block = rid[order], comp[order], of[order], np.where(alone[order], -1, block[order])
        edge = np.searchsorted(of, np.arange(len(kinds) + 1))
        s, k = kinds[:, 0], kinds[:, 1]
        for i in range(len(kinds)):
            t = -(-num * (s[i] + s[i:]) // (num + den))
            fits = np.flatnonzero((np.minimum(k[i], k[i:]) >= t) & (den * np.minimum(s[i], s[i:]) >= num * np.maximum(s[i], s[i:]))) + i
            for j in fits:
                x, y = np.arange(edge[i], edge[i + 1]), np.arange(edge[j], edge[j + 1])
                for c in np.unique(comp[x]):  # rows of one component against the rest: no pair inside it is made
                    mine, rest = x[comp[x] == c], y[(comp[y] > c) if i == j else (comp[y] != c)]
                    step = max(1, limit // max(len(rest), 1))
                    for lo in range(0, len(mine), step):
                        a, b = np.repeat(mine[lo : lo + step], len(rest)), np.tile(rest, len(mine[lo : lo + step]))
                        keep = (block[a] < 0) | (block[a] != block[b])
                        yield rid[a[keep]], rid[b[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(parts):
            h, *cols = (np.concatenate(x) for x in zip(*parts, strict=True))
            start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            length = np.diff(np.append(start, len(h)))
            for m in np.unique(length[length <= SHORT]):  # short lists: all of one length at once
                lists, (i, j) = start[length == m], np.triu_indices(m, 1)
                step = max(1, limit // max(len(i), 1))
                for lo in range(0, len(lists), step):
                    at = lists[lo : lo + step, None]
                    x, y = (at + i).ravel(), (at + j).ravel()
                    rid, size, slack, comp, block, alone = cols
                    t = -(-num * (size[x] + size[y]) // (num + den))
                    fits = (comp[x] != comp[y]) & (np.minimum(slack[x], slack[y]) >= t) & (den * np.minimum(size[x], size[y]) >= num * np.maximum(size[x], size[y]))
                    fits &= alone[x] | (block[x] != block[y])
                    if fits.any():
                        yield batch_of([(rid[x[fits]], rid[y[fits]])])
            start, length = start[length > SHORT], length[length > SHORT]
            out, held = [], 0
            for lo, hi in zip(start, start + length, strict=True):
                for x, y in pairs(*(c[lo:hi] for c in cols)):
                    out.append((x, y))
                    if (held := held + len(x)) > limit:
                        yield batch_of(out)
                        out, held = [], 0
            if out:
                yield batch_of(out)

        def batch_of(out):
            a, b = (np.concatenate([o[i] for o in out]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            cols = tuple(batch[c].to_numpy(zero_copy_only=False) for c in ("cell", "rid", "n", "slack", "component", "block", "alone"))
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last cell may go on in the next batch
            if cut:
                yield from emit([*kept, tuple(c[:cut] for c in cols)])
                kept = []
            kept.append(tuple(c[cut:] for c in cols))
        if kept:
            yield from emit(kept)

    return rows.select("cell", "rid", "n", "slack", "component", "block", "alone").mapInArrow(lean(run), "a long, b long")
