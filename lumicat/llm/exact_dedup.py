"""Exact dedup through a log-structured merge index of digests.

1. Each text is normalised (the bytes of ``common.SPACE`` are deleted) and hashed; rows of a few bytes go on.
2. Memtables fold the digests of a task; a full one is flushed as sorted runs, one per key range, each with a Bloom
   filter.
3. Compaction, one task per key range of bounded size: an arriving run asks the filters of the levels before it; keys
   that may be there are searched and folded (smallest identifier, count, and the longest text's identifier), the others
   become a new level; levels of like size merge.
4. Keys seen twice or more are *hits*.  Only their texts move: each is compared byte by byte with the text of the smallest
   identifier.  Where all are alike, group size and the row that stays are the index's; what differs (a collision of
   keys) is grouped by its bytes.
Copies are folded by tasks before any exchange, so a group of a third of all rows is a counter, not a list; the join that
brings its rows the leader's text is a plain equi-join, which adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, lean, materialise, mix64, partitions, release, slices, texts
from .filters import pair_key, sent_filter

#: Keys in a memtable before it is flushed (about 60 MB).
MEMTABLE = 250_000
#: Distinct keys of a key range, about: its levels are 40 bytes a key.
RANGE = 1_000_000
_RUN = np.dtype([("key", "<i8"), ("id", "<i8"), ("n", "<i8"), ("points", "<i8"), ("best", "<i8")])
#: A null id in the index: before all others.
_NULL = -(1 << 63)


def normal(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, SPACE)


def key_of(digest: bytes, bits: int = 64) -> int:
    """The index's key: the first bits of the digest."""
    return int.from_bytes(digest[:8], "big", signed=True) >> (64 - bits)


class Bloom:
    """A Bloom filter of 12 bits or more a key, 4 probes."""

    def __init__(self, keys: np.ndarray):
        self.bits = 1 << max(6, int(12 * max(len(keys), 1) - 1).bit_length())
        self.words = np.zeros(self.bits // 8, np.uint8)
        for at in self._probes(keys):
            np.bitwise_or.at(self.words, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))

    def _probes(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        h = mix64(keys.view(np.uint64) if keys.dtype == np.int64 else keys)
        step = mix64(h) | np.uint64(1)
        for i in range(4):
            yield (h + np.uint64(i) * step) & np.uint64(self.bits - 1)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._probes(keys):
            out &= (self.words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


class Levels:
    """Sorted runs without common keys, the largest first; each with its filter."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, Bloom]] = []

    def add(self, run: np.ndarray) -> None:
        for level, bloom in self.runs:
            maybe = np.flatnonzero(bloom.may_hold(np.ascontiguousarray(run["key"])))
            if not len(maybe):
                continue
            at = np.searchsorted(level["key"], run["key"][maybe])
            hit = at < len(level)
            hit[hit] = level["key"][at[hit]] == run["key"][maybe[hit]]
            at, maybe = at[hit], maybe[hit]
            old, new = level[at], run[maybe]
            old["id"] = np.minimum(old["id"], new["id"])
            old["n"] += new["n"]
            better = (new["points"] > old["points"]) | (new["points"] == old["points"]) & (new["best"] < old["best"])
            for c in ("points", "best"):
                old[c] = np.where(better, new[c], old[c])
            level[at] = old
            run = np.delete(run, maybe)
        if not len(run):
            return
        while self.runs and len(self.runs[-1][0]) <= 2 * len(run):  # compaction
            run = np.concatenate([self.runs.pop()[0], run])
            run = run[np.argsort(run["key"], kind="stable")]
        self.runs.append((run, Bloom(np.ascontiguousarray(run["key"]))))


class Memtable:
    """Digests folded by key."""

    def __init__(self):
        self.rows: dict[int, list[int]] = {}

    def add(self, key: int, i: int, points: int) -> None:
        if e := self.rows.get(key):
            e[0], e[1] = min(e[0], i), e[1] + 1
            if points > e[2] or points == e[2] and i < e[3]:
                e[2], e[3] = points, i
        else:
            self.rows[key] = [i, 1, points, i]

    def runs(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """Sorted runs by key range."""
        run = np.array([(k, *x) for k, x in self.rows.items()], _RUN)
        run = run[np.argsort(run["key"], kind="stable")]
        edges = np.array([-(1 << 63) + (i << 64) // buckets for i in range(1, buckets)], np.int64)
        at = np.concatenate(([0], np.searchsorted(run["key"], edges), [len(run)]))
        for b in np.flatnonzero(at[1:] > at[:-1]):
            yield int(b), run[at[b] : at[b + 1]]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row.

    Texts are equal when identical without separators; the row with the most code points, then the smallest id (null
    first) stays.  Null texts count as empty, and all empty ones as equal.  Rows that repeat an id and its text count
    each, and one of them is kept.  Other columns are ignored; an empty table gives an empty table.
    ``key_bits`` under 64 makes keys collide, for tests.
    """
    docs = texts(docs, id_col, text_col)
    rows = materialise(_digests(docs, key_bits), "digests")
    hits = materialise(_index(rows), "hits")
    held = materialise(_held(docs, hits, key_bits), "texts")
    on_leader = (held.key == hits.key) & (F.coalesce(held.doc_id, F.lit(_NULL)) == hits.leader)
    # the leader's text: the smallest of those with its key and id
    lead = held.where("may_lead").join(hits, on_leader).groupBy(hits.key).agg(F.min("bytes").alias("lead"), *[F.first(c).alias(c) for c in ("n", "most", "best")])
    lead = materialise(lead, "leaders")  # an aggregate in the join's own stage would keep Spark from splitting a hot key
    same = F.col("bytes") == F.col("lead")
    checked = held.join(lead, "key").select("doc_id", "row", "points", "sha", "key", "n", same.alias("same"), F.when(same, F.lit(b"")).otherwise(F.col("bytes")).alias("own"), (same & (F.col("points") == F.col("most")) & (F.coalesce("doc_id", F.lit(_NULL)) == F.col("best"))).alias("best"))
    checked = materialise(checked, "checked")
    discard(held, lead)
    release(docs.sparkSession)
    collided = materialise(checked.where("not same").select("key").distinct(), "collided")
    # keys of one text: the index's count, and the row it names (one of those that repeat)
    clear = checked.join(collided, "key", "left_anti")
    stays = clear.where("best").groupBy("key").agg(F.min(F.struct("row", "doc_id")).alias("w"))
    of_hits = clear.join(materialise(stays, "stays"), "key").select("doc_id", F.col("w.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("w.row")).alias("kept"), "sha")
    # keys of several texts: by their bytes
    mixed = checked.join(collided, "key", "left_semi")
    classes = mixed.groupBy("key", "same", "own").agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").alias("i"), F.col("row").alias("r"))).alias("w"))
    of_mixed = mixed.join(materialise(classes, "classes"), ["key", "same", "own"]).select("doc_id", F.col("w.i").alias("keep_id"), "group_size", (F.col("row") == F.col("w.r")).alias("kept"), "sha")
    alone = rows.join(hits.select("key"), "key", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return of_hits.unionByName(of_mixed).unionByName(alone).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _digests(docs: DataFrame, key_bits: int) -> DataFrame:
    """(doc_id, points, sha, key) of each row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            t = part["text"].to_pylist()
            sha = [hashlib.sha256(normal(x)).digest() for x in t]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(x) for x in t], pa.int64()), pa.array(sha, pa.binary()), pa.array([key_of(x, key_bits) for x in sha], pa.int64())], names=["doc_id", "points", "sha", "key"])

    return docs.mapInArrow(lean(digest), "doc_id long, points long, sha binary, key long")


def _index(rows: DataFrame) -> DataFrame:
    """(key, leader, n, most, best) of the keys seen twice or more: the smallest id, the rows, the most code points and
    the smallest id with so many."""
    buckets = max(64, partitions(rows.sparkSession), -(-rows.count() // RANGE))  # a row count from Parquet footers

    def flush(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            runs = list(table.runs(buckets))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in runs], pa.int32()), pa.array([r.tobytes() for _, r in runs], pa.binary())], names=["bucket", "run"])

        table = Memtable()
        for batch in batches:
            for i, k, p in zip(*(batch[c].to_pylist() for c in ("doc_id", "key", "points")), strict=True):
                table.add(k, _NULL if i is None else i, p)
                if len(table.rows) >= MEMTABLE:
                    yield out()
                    table = Memtable()
        if table.rows:
            yield out()

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels()  # a task has one key range
        for batch in batches:
            for run in batch["run"].to_pylist():
                levels.add(np.frombuffer(run, _RUN).copy())
        for run, _ in levels.runs:
            run = run[run["n"] > 1]
            for lo in range(0, len(run), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(run[c][lo : lo + 100_000])) for c in _RUN.names], names=["key", "leader", "n", "most", "best"])

    runs = rows.select("doc_id", "key", "points").mapInArrow(lean(flush), "bucket int, run binary")
    return runs.repartitionById(buckets, F.col("bucket")).mapInArrow(lean(compact), "key long, leader long, n long, most long, best long")


def _held(docs: DataFrame, hits: DataFrame, key_bits: int) -> DataFrame:
    """The normalised texts of the rows whose key may be a hit, with whether the row may be its key's leader."""
    spark, n = docs.sparkSession, hits.count()

    wanted = spark.sparkContext.broadcast(sent_filter(hits.select("key"), n))
    leaders = spark.sparkContext.broadcast(sent_filter(hits.select("key", "leader"), n))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            t = part["text"].to_pylist()
            raw = [normal(x) for x in t]
            sha = [hashlib.sha256(x).digest() for x in raw]
            key = np.array([key_of(x, key_bits) for x in sha], np.int64)
            ids = np.array([_NULL if i is None else i for i in part["doc_id"].to_pylist()], np.int64)
            keep = np.flatnonzero(wanted.value.may_hold(key))
            lead = leaders.value.may_hold(pair_key(key[keep], ids[keep]))
            at = keep.tolist()
            yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(at, pa.int64())), pa.array([len(t[i]) for i in at], pa.int64()), pa.array([sha[i] for i in at], pa.binary()), pa.array(key[keep]), pa.array([raw[i] for i in at], pa.binary()), pa.array(lead)], names=["doc_id", "points", "sha", "key", "bytes", "may_lead"])

    held = docs.mapInArrow(lean(verify), "doc_id long, points long, sha binary, key long, bytes binary, may_lead boolean")
    return held.withColumn("row", F.monotonically_increasing_id())
