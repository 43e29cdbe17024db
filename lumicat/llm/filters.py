"""A membership filter of fixed size at most, sent to all tasks before something large is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix64, partitions

#: So many blocks, of at most so many bytes each: 16 MB in all at any size of the data.  With very many keys the filter
#: lets more through; the join that follows decides either way.
BLOCKS, BLOCK_BYTES = 256, 1 << 16


class SentFilter:
    """A Bloom filter in blocks by the upper bits of a scrambled key: blocks are built by different tasks, and all of them
    together have a fixed size at most."""

    def __init__(self, bits: int, blocks: dict[int, np.ndarray]):
        self.bits = bits  # of one block, a power of two
        self.words = np.zeros((BLOCKS, bits // 8), np.uint8)
        for b, x in blocks.items():
            self.words[b] = x

    @staticmethod
    def width(keys: int) -> int:
        return min(8 * BLOCK_BYTES, 1 << max(9, int(16 * keys / BLOCKS).bit_length()))

    @staticmethod
    def place(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, scrambled key) of each key."""
        h = mix64(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0xA0761D6478BD642F))
        return (h >> np.uint64(56)).astype(np.int64), h

    @staticmethod
    def probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        step = mix64(h) | np.uint64(1)
        for i in range(4):
            yield ((h + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64)

    @classmethod
    def block(cls, h: np.ndarray, bits: int) -> np.ndarray:
        out = np.zeros(bits, np.uint8)
        for at in cls.probes(h, bits):
            out[at] = 1
        return np.packbits(out, bitorder="little")

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        block, h = self.place(keys)
        out = np.ones(len(keys), bool)
        for at in self.probes(h, self.bits):
            out &= (self.words[block, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def sent_filter(keys: DataFrame, n: int) -> SentFilter:
    """The filter of about ``n`` keys, each block built by one task: a column of 64-bit integers, or two for ``pair_key`` (in
    the same function, since each one of a stage takes a worker of its own beside the others)."""
    bits = SentFilter.width(n)

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            block, h = SentFilter.place(pair_key(*cols) if len(cols) > 1 else cols[0])
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(h.view(np.int64))], names=["block", "h"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            block, h = (batch[c].to_numpy(zero_copy_only=False) for c in ("block", "h"))
            for b in np.unique(block).tolist():
                x = SentFilter.block(np.ascontiguousarray(h[block == b]).view(np.uint64), bits)
                made[b] = made[b] | x if b in made else x
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([x.tobytes() for x in made.values()], pa.binary())], names=["block", "bits"])

    dealt = keys.mapInArrow(lean(by_block), "block int, h long").repartitionById(min(BLOCKS, partitions(keys.sparkSession)), F.pmod("block", F.lit(min(BLOCKS, partitions(keys.sparkSession)))))
    rows = dealt.mapInArrow(lean(build), "block int, bits binary").collect()  # BLOCKS rows of BLOCK_BYTES at most
    return SentFilter(bits, {r.block: np.frombuffer(r.bits, np.uint8) for r in rows})


def pair_key(key: np.ndarray, i: np.ndarray) -> np.ndarray:
    """One number for a key and an id."""
    return (key.view(np.uint64) ^ mix64(i.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
