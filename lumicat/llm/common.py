"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and tab to carriage return.
SPACE = b" \t\n\x0b\x0c\r"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a fresh temporary one only in local mode."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="lumicat-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared scratch folder and read back: later reads don't recompute it, and a
    lost executor costs no lineage."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = (weakref.ref(out), path)
    return out


_WRITTEN: dict[int, tuple[weakref.ref, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` wrote, once what was made of them is written itself."""
    for df in tables:
        ref, path = _WRITTEN.pop(id(df), (lambda: None, ""))
        if ref() is df:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of finished phases now instead of at its next periodic collection: they
    would add up over the phases of an operator."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, not only by rows: ten thousand long texts must not meet in one batch.  A setting of
    the session that is already lower stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so that other columns of any name can't clash; null text is empty."""
    bound_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


#: What a process holds from task to task, by name: how to drop it.
HELD: dict[str, Callable[[], None]] = {}


def forget(but: str = "") -> None:
    """Drops what this process holds, but for what is held as ``but``; it is made again where it is needed."""
    for name, drop in HELD.items():
        if name != but:
            drop()


def lean(run: Callable, keep: str = "") -> Callable:
    """A function over Arrow batches that gives its task's memory back to the system at the end: workers live on, and
    what their allocators keep would add up over the stages of a session.  What earlier tasks left in the worker is dropped
    first, but for what is held as ``keep``: Spark hands a stage's tasks to all workers in turn, so that each would keep its
    tokenizer through all stages that follow."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keep)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def slices(batch: pa.RecordBatch, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most about ``limit`` bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * limit / max(batch.nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
HELD["powers"] = _POWERS.clear


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd base modulo 2^64, and of its inverse."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        n = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[base] = tuple(out)
    return _POWERS[base]
