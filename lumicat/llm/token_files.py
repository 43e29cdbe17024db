"""Token-id files: concatenated id arrays with Elias-Fano document boundaries.

A file is a Parquet table of segments, written by Spark's own writer so that it can lie in any store.  A segment holds up
to ``SEGMENT`` ids of documents in ascending id order: the ids as 16-bit integers (32-bit ones for larger vocabularies),
the document ids, the ids before it in its part of the table, and the documents' end offsets as an Elias-Fano sequence
with its select samples (about 2.5 + log2(ids / documents) bits a document).  Readers find offsets by select; no table of
64-bit offsets is stored or rebuilt.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, partitions, slices, texts
from .tokens import encoder

#: Ids of one segment, unless a single document has more.
SEGMENT = 2_000_000
#: Ones between two samples of the select structure.
_SAMPLE = 128
_SCHEMA = "segment long, part int, before long, width int, n_docs long, n_ids long, doc_ids array<long>, ends binary, ids binary"


class EliasFano:
    """A non-decreasing sequence of integers: low bits packed, high bits in unary.  ``samples`` holds, for every 128th
    one of the high bits, the byte it lies in and the ones before that byte, in 32 bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        byte = ones[::_SAMPLE] >> 3
        samples = np.stack((byte, np.searchsorted(ones, 8 * byte)), 1).astype("<u4")
        return cls(n, bits, np.packbits(low, bitorder="little"), np.packbits(high, bitorder="little"), samples)

    def tobytes(self) -> bytes:
        return struct.pack("<QB", self.n, self.low_bits) + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def frombytes(cls, raw: bytes) -> EliasFano:
        n, bits = struct.unpack_from("<QB", raw)
        k, low = -(-n // _SAMPLE), (n * bits + 7) // 8
        at = 9 + 8 * k
        return cls(n, bits, np.frombuffer(raw, np.uint8, low, at), np.frombuffer(raw, np.uint8, len(raw) - at - low, at + low), np.frombuffer(raw, "<u4", 2 * k, 9).reshape(k, 2))

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte, seen = (int(x) for x in self.samples[i // _SAMPLE])
        while seen + (c := int(self.high[byte]).bit_count()) <= i:
            seen, byte = seen + c, byte + 1
        word = int(self.high[byte])
        for _ in range(i - seen):
            word &= word - 1
        at = (word & -word).bit_length() - 1
        return (8 * byte + at - i) << self.low_bits | int(self._low(i, i + 1)[0])

    def select_range(self, lo: int, hi: int) -> np.ndarray:
        """The values lo to hi - 1: the samples around them bound the bytes that are read."""
        if not 0 <= lo <= hi <= self.n:
            raise IndexError((lo, hi))
        if lo == hi:
            return np.empty(0, np.int64)
        byte, seen = (int(x) for x in self.samples[lo // _SAMPLE])
        after = -(-hi // _SAMPLE)
        stop = int(self.samples[after, 0]) + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[byte:stop], bitorder="little"))[lo - seen : hi - seen]
        return (ones + 8 * byte - np.arange(lo, hi)) << self.low_bits | self._low(lo, hi)

    def _low(self, lo: int, hi: int) -> np.ndarray:
        """The low bits of the values lo to hi - 1."""
        first, last = lo * self.low_bits, hi * self.low_bits
        bits = np.unpackbits(self.low[first >> 3 : (last + 7) >> 3], bitorder="little")[first & 7 :][: last - first]
        return (bits.reshape(hi - lo, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(1)


def write_token_files(docs: DataFrame, path: str, tokenizer: bytes, end_id: int, id_col: str = "doc_id", text_col: str = "text", special: bool = False, segment: int = SEGMENT) -> DataFrame:
    """Encodes each text, appends ``end_id`` and writes the segments under ``path``; returns the files as a table.

    Null texts count as empty (one id).  Documents lie in the order of (id, text); rows that repeat an id follow one
    another.  A long text may make a segment longer than ``segment`` ids.  An empty table gives files without segments.
    ``special``: special tokens of the file are found in texts (the library's default); else they are plain text.
    """
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(tokenizer)
    # texts are dealt before they are encoded: sampling the ranges then doesn't encode anything
    dealt = texts(docs, id_col, text_col).repartitionByRange(partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(raw.value, special)
        part = TaskContext.get().partitionId()
        at, names, ids, held, before = 0, [], [], 0, 0
        end = np.array([end_id], e.dtype)

        def packed():
            row = {"segment": part << 32 | at, "part": part, "before": before, "width": e.dtype.itemsize, "n_docs": len(ids), "n_ids": held, "doc_ids": names, "ends": EliasFano.of(np.cumsum([len(x) for x in ids])).tobytes(), "ids": np.concatenate(ids).tobytes()}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for piece in slices(batch, 4_000_000):
                for i, x in zip(piece["doc_id"].to_pylist(), e.encode(piece["text"].to_pylist()), strict=True):
                    names.append(i)
                    ids.append(np.concatenate((x, end)))
                    held += len(x) + 1
                    if held >= segment:
                        yield packed()
                        at, names, ids, held, before = at + 1, [], [], 0, before + held
        if ids:
            yield packed()

    schema = pa.schema([("segment", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.binary()), ("ids", pa.binary())])
    dealt.mapInArrow(lean(pack, "tokenizers"), _SCHEMA).write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    return read_token_files(spark, path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``first``: the ids of all segments before.

    A segment knows the ids before it in its part; the parts' first ids are one row a part, and there are no more parts
    than the writing job had tasks (``spark.sql.shuffle.partitions``), so that table is sent to the segments and the ids
    stay where they are read.
    """
    rows = spark.read.schema(_SCHEMA).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(parts), "part").withColumn("first", F.col("base") + F.col("before")).drop("base")


def document_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids as little-endian 32-bit integers) of each document in ``files``, found by select."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends, ids, first = EliasFano.frombytes(row["ends"]), np.frombuffer(row["ids"], f"<u{row['width']}"), row["first"]
                at = 0
                for lo in range(0, ends.n, 2000):
                    e = ends.select_range(lo, min(lo + 2000, ends.n))
                    s = np.concatenate(([at], e[:-1]))
                    at = int(e[-1])
                    yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][lo : lo + 2000], pa.int64()), pa.array(s + first, pa.int64()), pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(s, e, strict=True)], pa.binary())], names=["doc_id", "start", "ids"])

    return files.select("first", "width", "doc_ids", "ends", "ids").mapInArrow(lean(run), "doc_id long, start long, ids binary")


def document(files: DataFrame, segment: int, i: int) -> np.ndarray:
    """The ids of the i-th document of a segment, found by two selects; there must be such a segment (KeyError) and such
    a document (IndexError)."""
    row = files.where(F.col("segment") == segment).first()
    if row is None:
        raise KeyError(segment)
    ends = EliasFano.frombytes(bytes(row.ends))
    return np.frombuffer(bytes(row.ids), f"<u{row.width}")[ends.select(i - 1) if i > 0 else 0 : ends.select(i)]
