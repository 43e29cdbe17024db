"""Best-fit packing of token sequences with hierarchical residuals.

1. Each task cuts its documents into pieces and packs them best-fit, longest first.  Bins that are nearly full are final.
2. Underfull bins rise in a tree as items: a node packs the bins of ``FAN`` children best-fit again.  After best-fit at
   most one bin of a node is no more than half full, so a parent has at most ``FAN`` bins that can be placed anywhere;
   of the fuller ones the ``HOSTS`` with the most room rise with it and can host as many.  A node thus handles a bounded
   number of bins however many there are below it, and the others are final where they are.
3. A table of moved bins (bin, sequence, offset) is joined back to the pieces.
Only lengths, checksums and bin numbers move, not ids.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, slices, texts
from .tokens import encoder

#: Children of a tree node.
FAN = 16
#: Bins over half full that rise from a node; at least FAN, so that each small bin of the parent can find a host.
HOSTS = 64
#: Pieces packed together in a task.
BATCH = 200_000


def best_fit(lengths: Iterable[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit, longest first: (bin of each item, offset of each item in its bin, fill of each bin)."""
    lengths = list(lengths)
    where, offset, fill = [0] * len(lengths), [0] * len(lengths), []
    open_bins: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted, one entry for each room size with open bins
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        size = lengths[i]
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
        else:
            b, room = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += size
        if left := room - size:
            if left not in open_bins:
                open_bins[left] = []
                insort(rooms, left)
            open_bins[left].append(b)
    return where, offset, fill


def pack_documents(docs: DataFrame, tokenizer: bytes, end_id: int, capacity: int = 4096, full: float = 0.995, id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece.

    Documents of more than ``capacity`` ids are cut into full pieces and a rest; no other is.  Null texts count as empty
    and have the end id alone.  Rows that repeat are packed each.  Bins filled to ``full`` of the capacity are final at
    once.  An empty table gives an empty table.
    ``special``: special tokens of the file are found in texts (the library's default); else they are plain text.
    """
    raw = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(raw.value, special)
        first = TaskContext.get().partitionId() << 32
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", "fill"]
        kept: list[list] = [[], [], [], [], []]

        def packed():
            nonlocal first
            where, offset, fill = best_fit(kept[3], capacity)
            out = pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(kept, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)), pa.array([first + b for b in where], pa.int64()), pa.array(offset, pa.int64()), pa.array([fill[b] for b in where], pa.int64())], names=names)
            first += len(fill)
            for c in kept:
                c.clear()
            return out

        for batch in batches:
            for part in slices(batch, 4_000_000):
                for i, x in zip(part["doc_id"].to_pylist(), e.encode(part["text"].to_pylist()), strict=True):
                    ids = np.append(x.astype("<u4"), np.uint32(end_id))
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        piece = ids[at : at + capacity]
                        for c, v in zip(kept, (i, k, at, len(piece), zlib.crc32(piece.tobytes())), strict=True):
                            c.append(v)
                if len(kept[0]) >= BATCH:
                    yield packed()
        if kept[0]:
            yield packed()

    pieces = texts(docs, id_col, text_col).mapInArrow(lean(local, "tokenizers"), "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, fill long")
    pieces = materialise(pieces, "pieces")
    moved = merge_tree(pieces.where(F.col("fill") < int(full * capacity)).groupBy("bin").agg(F.max("fill").alias("fill")), capacity)
    return pieces.join(moved, "bin", "left").select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("base", F.lit(0))).alias("offset"))


def merge_tree(bins: DataFrame, capacity: int) -> DataFrame:
    """(bin, fill) of underfull bins -> (bin, sequence, base) of those that share a sequence with others."""

    def node(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        where, offset, fill = best_fit([r["fill"] for r in rows], capacity)
        out: list[dict] = [{"node": key[0].as_py(), "fill": f, "members": []} for f in fill]
        for r, b, base in sorted(zip(rows, where, offset, strict=True), key=lambda x: x[2]):
            out[b]["members"] += [{"bin": m["bin"], "base": m["base"] + base} for m in r["members"]]
        rising = sorted(range(len(out)), key=lambda b: fill[b])[: HOSTS + 1]
        keep = set(rising)
        return pa.Table.from_pylist([{**o, "open": i in keep} for i, o in enumerate(out)], schema=schema)

    schema = pa.schema([("node", pa.int64()), ("fill", pa.int64()), ("members", pa.list_(pa.struct([("bin", pa.int64()), ("base", pa.int64())]))), ("open", pa.bool_())])
    kind = "node long, fill long, members array<struct<bin: long, base: long>>, open boolean"
    # the leaves: a task's bins, of which again only the emptiest rise
    leaf = F.shiftright("bin", 32)
    level = bins.select(leaf.alias("node"), "fill", F.array(F.struct("bin", F.lit(0).cast("long").alias("base"))).alias("members"))
    level = materialise(_emptiest(level), "bins")
    done = None
    while True:
        top = level.agg(F.max("node")).first()[0]
        if top is None:
            break
        packed = materialise(level.withColumn("node", F.expr(f"node div {FAN}")).groupBy("node").applyInArrow(node, kind), "bins")
        final = packed.where(~F.col("open") if top >= FAN else F.lit(True)).where(F.size("members") > 1).select("members")
        done = final if done is None else done.unionByName(final)
        if top < FAN:
            break
        level = packed.where("open").select("node", "fill", "members")
    if done is None:
        done = level.where("false").select("members")
    one = done.select(F.col("members")[0]["bin"].alias("sequence"), F.explode("members").alias("m"))
    return one.select(F.col("m.bin").alias("bin"), "sequence", F.col("m.base").alias("base"))


def _emptiest(level: DataFrame) -> DataFrame:
    """The HOSTS + 1 emptiest bins of each leaf, folded per task before anything moves."""
    best = level.groupBy("node").agg(F.expr(f"slice(array_sort(collect_list(struct(fill, members))), 1, {HOSTS + 1})").alias("b"))
    return best.select("node", F.explode("b").alias("b")).select("node", F.col("b.fill").alias("fill"), F.col("b.members").alias("members"))
