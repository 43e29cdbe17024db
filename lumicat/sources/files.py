"""Scans and sinks: folders, images, metadata, configuration files, the batch queue."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import photo
from . import codecs

IMAGES = ("png", "ppm", "pgm", "tif", "tiff", "jpg", "jpeg")


def list_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = IMAGES, depth: int | None = None, hidden: bool = False) -> DataFrame:
    """(path, length, mtime) of the files under ``path``; contents aren't read.  ``depth``: folders below it at most."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("mtime"))
    below = F.substring_index("path", path.rstrip("/") + "/", -1)
    keep = photo.file_type("path").isin(*extensions)
    if depth is not None:
        keep = keep & (F.size(F.split(below, "/")) - 1 <= depth)
    if not hidden:
        keep = keep & ~F.rlike(below, F.lit(r"(^|/)\."))
    return files.where(keep)


def read_pixels(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, skip: int = 1) -> DataFrame:
    """(path, y, x, r, g, b, error): pixels of all images under ``path``, a row each; a file that can't be read gives one
    row with ``error``.  ``window`` (x, y, width, height) and ``skip`` are applied while decoding, so other pixels never
    become rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(photo.file_type("path").isin(*IMAGES)).select("path", "content")
    names = ["path", "y", "x", "r", "g", "b", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                try:
                    px = codecs.decode(raw.as_py(), name.rpartition(".")[2])
                except Exception as e:  # noqa: BLE001  whatever a damaged file does to its decoder
                    yield pa.RecordBatch.from_arrays([pa.array([name]), *[pa.array([None], pa.int32())] * 2, *[pa.array([None], pa.float32())] * 3, pa.array([f"{type(e).__name__}: {e}"])], names=names)
                    continue
                x0, y0 = (window[0], window[1]) if window else (0, 0)
                if window:
                    px = px[y0 : y0 + window[3], x0 : x0 + window[2]]
                px = px[::skip, ::skip]
                h, w, _ = px.shape
                rows = max(1, 500_000 // max(w, 1))
                for at in range(0, h, rows):
                    part = px[at : at + rows]
                    n = part.shape[0] * w
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.repeat(np.arange(at, at + part.shape[0], dtype=np.int32), w)), pa.array(np.tile(np.arange(w, dtype=np.int32), part.shape[0])), *[pa.array(part[..., c].ravel().astype(np.float32)) for c in range(3)], pa.nulls(n, pa.string())], names=names)

    return files.mapInArrow(run, "path string, y int, x int, r float, g float, b float, error string")


def read_formats(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, bits, samples, is_float) from headers, without decoding."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(photo.file_type("path").isin("png", "tif", "tiff"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, raw in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                try:
                    f = (codecs.png_format if name.lower().endswith("png") else codecs.tiff_format)(raw.as_py())
                except Exception:  # noqa: BLE001
                    f = {}
                out.append({"path": name, **{k: f.get(k) for k in ("width", "height", "bits", "samples")}, "is_float": f.get("float", False)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("bits", pa.int32()), ("samples", pa.int32()), ("is_float", pa.bool_())]))

    return files.select("path", "content").mapInArrow(run, "path string, width int, height int, bits int, samples int, is_float boolean")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The shots table from the files' metadata directories; missing fields are null."""
    fields = [("make", "string"), ("model", "string"), ("lens", "string"), ("iso", "int"), ("fnumber", "double"), ("shutter", "double"), ("focal", "double"), ("focal35", "double"), ("focus_dist", "double"), ("expcomp", "double"), ("rating", "int"), ("orientation", "int"), ("taken", "string")]
    kinds = {"string": (pa.string(), str), "int": (pa.int32(), int), "double": (pa.float64(), float)}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~photo.file_type("path").isin("png", "ppm", "pgm")).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cast(v, f):
            try:
                return None if v is None else f(v[0] if isinstance(v, tuple) else v)
            except (TypeError, ValueError):
                return None

        for batch in batches:
            got = [codecs.exif(raw.as_py()) for raw in batch["content"]]
            yield pa.RecordBatch.from_arrays([batch["path"], *[pa.array([cast(g.get(n), kinds[k][1]) for g in got], kinds[k][0]) for n, k in fields], pa.array([bool(g) for g in got])], names=["path", *[n for n, _ in fields], "exif_valid"])

    rows = files.mapInArrow(run, "path string, " + ", ".join(f"{n} {k}" for n, k in fields) + ", exif_valid boolean")
    return rows.withColumn("taken", F.try_to_timestamp("taken", F.lit("yyyy:MM:dd HH:mm:ss")))


def encode_images(px: DataFrame, kind: str = "png", bits: int = 8, frame: str = "frame") -> DataFrame:
    """(frame, content): each frame's pixels (y, x, r, g, b on the 0..65535 scale) as one file.

    A frame is gathered in one task: an image file is one array.
    """
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        out = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 3), np.float64)
        for c, name in enumerate("rgb"):
            out[y, x, c] = table[name].to_numpy()
        if bits == 32:
            image = (out / 65535).astype(np.float32)
        else:
            image = np.clip(np.rint(out / (257 if bits == 8 else 1)), 0, 255 if bits == 8 else 65535).astype(np.uint8 if bits == 8 else np.uint16)
        return pa.table({frame: pa.array([key[0].as_py()], pa.int64()), "content": pa.array([codecs.ENCODERS[kind](image)], pa.binary())})

    rows = px.select(F.col(frame).cast("long").alias(frame), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(c).cast("double").alias(c) for c in "rgb"])
    return rows.groupBy(frame).applyInArrow(run, f"{frame} long, content binary")


def write_images(px: DataFrame, path: str, kind: str = "png", bits: int = 8, frame: str = "frame") -> DataFrame:
    """Writes each frame as ``path/<frame>.<kind>`` on any file system that Arrow reaches; returns (frame, bytes).  A task writes
    the files it encodes; nothing is written before an action."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for i, body in zip(batch[frame].to_pylist(), batch["content"], strict=True):
                with store.open_output_stream(f"{root}/{i}.{kind}") as out:
                    out.write(body.as_buffer())
            yield pa.RecordBatch.from_arrays([batch[frame], pa.array([len(b.as_buffer()) for b in batch["content"]], pa.int64())], names=[frame, "bytes"])

    return encode_images(px, kind, bits, frame).mapInArrow(run, f"{frame} long, bytes long")


# ---- configuration


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """The batch queue's text file: fields separated by bars, a header, defaults for missing fields at the end."""
    schema = "file string, params_file string, out_file string, format string, jpeg_quality int, jpeg_subsampling int, png_bits int, tiff_bits int, tiff_float int, tiff_uncompressed int, save_params int, force_format int, fast int, big_tiff int"
    rows = spark.read.schema(schema).option("sep", "|").option("header", "true").option("mode", "PERMISSIVE").option("enforceSchema", "true").csv(path)
    defaults = {"format": "", "jpeg_quality": 92, "jpeg_subsampling": 3, "png_bits": 8, "tiff_bits": 16, "tiff_float": 0, "tiff_uncompressed": 0, "save_params": 1, "force_format": 0, "fast": 0, "big_tiff": 0}
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def write_queue(queue: DataFrame, path: str) -> None:
    queue.write.mode("overwrite").option("sep", "|").option("header", "true").csv(path)


def read_bad_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(camera, x, y) from text files named after their camera: a pair a line; a single number on the first line is added
    to both coordinates of all pairs of the file."""
    lines = spark.read.text(path, wholetext=True).select(photo.base_name(F.input_file_name()).alias("f"), F.split("value", r"\r?\n").alias("l"))
    numbers = lines.select(photo.without_extension("f").alias("camera"), F.transform("l", lambda s: F.regexp_extract_all(s, F.lit(r"(-?\d+)"), F.lit(1))).alias("l"))
    first = F.get("l", 0)
    offset = F.when(F.size(first) == 1, F.get(first, 0).cast("int")).otherwise(0)
    pairs = F.filter("l", lambda a: F.size(a) == 2)
    return numbers.select("camera", offset.alias("o"), F.explode(pairs).alias("p")).select("camera", (F.get("p", 0).cast("int") + F.col("o")).alias("x"), (F.get("p", 1).cast("int") + F.col("o")).alias("y"))


def read_camera_constants(spark: SparkSession, path: str) -> DataFrame:
    """(camera, level_iso, white, black) of a JSON file with ``camera_constants``: entries may name several cameras, and
    levels several sensitivities."""
    level = "array<struct<iso: array<int>, levels: array<int>>>"
    schema = f"camera_constants array<struct<make_model: array<string>, ranges: struct<white: {level}, black: {level}>>>"
    entry = spark.read.schema(schema).option("multiLine", "true").option("allowComments", "true").json(path).select(F.explode("camera_constants").alias("e"))
    rows = entry.select(F.explode("e.make_model").alias("camera"), F.explode(F.col("e.ranges.white")).alias("w"), F.get(F.get(F.col("e.ranges.black"), 0)["levels"], 0).alias("black"))
    return rows.select(F.upper("camera").alias("camera"), F.explode("w.iso").alias("level_iso"), F.get(F.col("w.levels"), 0).alias("white"), F.coalesce("black", F.lit(0)).alias("black"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Profile rules of a JSON-lines file, with open ranges filled in."""
    schema = "serial int, iso_min int, iso_max int, fnumber_min double, fnumber_max double, focal_min double, focal_max double, shutter_min double, shutter_max double, camera_enabled boolean, camera_value string, lens_enabled boolean, lens_value string, profile string"
    rows = spark.read.schema(schema).json(path)
    fill = {f"{c}_{end}": v for c, top in (("iso", 512000), ("fnumber", 1e9), ("focal", 1e9), ("shutter", 1e9)) for end, v in (("min", 0), ("max", top))}
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()} | {f"{c}_enabled": F.coalesce(f"{c}_enabled", F.lit(False)) for c in ("camera", "lens")})


def write_rules(rules: DataFrame, path: str) -> None:
    rules.write.mode("overwrite").json(path)


def read_lens_frames(spark: SparkSession, path: str, row_tag: str = "frame") -> DataFrame:
    """(lens, focal, focus, k1, k2, k3) frames of XML lens profiles."""
    schema = "lens string, focal double, focus double, k1 double, k2 double, k3 double"
    return spark.read.schema(schema).option("rowTag", row_tag).xml(path)


def read_lookup_table(spark: SparkSession, path: str) -> DataFrame:
    """A three-dimensional table from a square image: (ri, gi, bi, r, g, b), its level being the cube root of the side."""
    px = read_pixels(spark, path).where(F.col("error").isNull())
    side = px.agg((F.max("x") + 1).alias("side"))
    rows = px.crossJoin(F.broadcast(side)).withColumn("n", F.round(F.pow(F.col("side").cast("double"), 2 / 3)).cast("int"))  # one row
    at = F.col("y").cast("long") * F.col("side") + F.col("x")
    return rows.select((at % F.col("n")).alias("ri"), (F.floor(at / F.col("n")) % F.col("n")).alias("gi"), F.floor(at / (F.col("n") * F.col("n"))).alias("bi"), "r", "g", "b")


def upsert(table: DataFrame, fresh: DataFrame, key: str | list[str]) -> DataFrame:
    """Records of ``fresh`` in place of those with the same key, of one column or several."""
    return table.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def xmp_text(tags: DataFrame, key: str = "file") -> DataFrame:
    """(file, xmp): a sidecar document from a map column ``tags``, keys in order."""
    escape = lambda v: F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    items = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(F.lit("  <rdf:li name=\""), escape(e["key"]), F.lit("\">"), escape(e["value"]), F.lit("</rdf:li>")))
    return tags.select(key, F.concat(F.lit("<x:xmpmeta xmlns:x=\"adobe:ns:meta/\"><rdf:Bag>\n"), F.array_join(items, "\n"), F.lit("\n</rdf:Bag></x:xmpmeta>")).alias("xmp"))


def newest(files: DataFrame, per: str, k: int) -> DataFrame:
    """The k newest files of each group."""
    return files.withColumn("_r", F.row_number().over(W.partitionBy(per).orderBy(F.desc("mtime"), "path"))).where(F.col("_r") <= k).drop("_r")
