"""Camera raw files: the pixels, levels and crops of DNG files as a Spark data source.

``spark.read.format("dng")`` deals each file to tasks by bytes: a task decodes the strips or tiles that begin in its share,
and the driver only lists names and sizes.  A schema without pixel columns reads directories alone (a row an image), and
comparisons of ``y`` and ``x`` with constants leave out strips and tiles before they are read.  Samples may be packed (any
number of bits to 16) or in lossless JPEG (ITU-T T.81, process 14).

Lossless JPEG is decoded in bulk: the length of the code that would begin at *every* bit is looked up at once, a short loop
hops from code to code, and differences and predictions are array operations.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .codecs import Unsupported

Read = Callable[[int, int], bytes]

#: Sizes and codes of directory entries by type.
_ENTRY = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I"}
#: Kinds of images that hold sensor samples.
_MOSAIC, _LINEAR = 32803, 34892
#: Samples that are decoded at a time where rows allow it.
BAND = 1 << 20

_DIRECTORY = "path string, image int, frame long, width int, height int, bits int, samples int, cfa string, crop_x double, crop_y double, crop_width double, crop_height double, white double"
_PIXEL = "y int, x int, c int, v int, black double"
SCHEMA = f"{_DIRECTORY}, {_PIXEL}, error string"


class Damaged(ValueError):
    """A file that ends early or holds what can't be decoded."""


# ---------------------------------------------------------------- directories


def directory(read: Read, order: str, at: int) -> tuple[dict[int, tuple], int]:
    """The tags of a directory, each as a tuple (text as bytes), and where the next one is (0: none)."""
    (n,) = struct.unpack(order + "H", _exactly(read, at, 2))
    body = _exactly(read, at + 2, 12 * n + 4)
    out: dict[int, tuple] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", body, 12 * i)
        code = _ENTRY.get(kind)
        if not code:
            continue
        size = struct.calcsize("=" + code) * count
        raw = body[12 * i + 8 : 12 * i + 8 + size] if size <= 4 else _exactly(read, *struct.unpack_from(order + "I", body, 12 * i + 8), size)
        if kind == 2:
            out[tag] = (raw.split(b"\0")[0],)
        elif kind in (5, 10):
            v = struct.unpack(order + code[0] * 2 * count, raw)
            out[tag] = tuple(a / b if b else 0.0 for a, b in zip(v[::2], v[1::2], strict=True))
        else:
            out[tag] = struct.unpack(order + code * count, raw)
    return out, struct.unpack_from(order + "I", body, 12 * n)[0]


def _exactly(read: Read, at: int, n: int) -> bytes:
    raw = read(at, n)
    if len(raw) != n:
        raise Damaged(f"{n} bytes at {at} are beyond the end")
    return raw


@dataclass(frozen=True)
class Chunk:
    """Part of an image: its place, and its bytes."""

    y: int
    x: int
    height: int
    width: int
    at: int
    size: int


@dataclass
class Raw:
    """One image of sensor samples.  Places count from the corner of the active area."""

    image: int
    order: str
    bits: int
    samples: int
    packed: bool
    active: tuple[int, int, int, int]  # top, left, bottom, right
    pattern: np.ndarray  # colours of a period; empty for images of whole pixels
    black: np.ndarray  # rows, columns, samples of a period
    black_x: np.ndarray
    black_y: np.ndarray
    white: tuple[float, ...]
    crop: tuple[float, float, float, float]
    table: np.ndarray
    chunks: list[Chunk] = field(default_factory=list)

    @property
    def height(self) -> int:
        return self.active[2] - self.active[0]

    @property
    def width(self) -> int:
        return self.active[3] - self.active[1]


def read_images(read: Read) -> list[Raw]:
    """All images of sensor samples in a file, in the order of its directories."""
    head = _exactly(read, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if not order or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise Unsupported("not a DNG file")
    todo, seen, out = [struct.unpack(order + "I", head[4:])[0]], set(), []
    while todo:
        at = todo.pop(0)
        if not at or at in seen:
            continue
        seen.add(at)
        tags, following = directory(read, order, at)
        todo += [*tags.get(330, ()), following]
        if tags.get(262, (0,))[0] in (_MOSAIC, _LINEAR) and not tags.get(254, (0,))[0] & 1:
            out.append(_image(tags, order, len(out)))
    return out


def _image(tags: dict[int, tuple], order: str, number: int) -> Raw:
    one = lambda tag, other: tags.get(tag, (other,))[0]
    width, height, bits, samples, kind = one(256, 0), one(257, 0), one(258, 16), one(277, 1), one(259, 1)
    if kind not in (1, 7) or not 1 <= bits <= 16:
        raise Unsupported(f"compression {kind} of {bits} bits")
    active = tags.get(50829) or (0, 0, height, width)
    rows, columns = tags.get(50713) or (1, 1)
    black = tags.get(50714) or (0.0,)
    black = np.resize(np.array(black, float), rows * columns * samples).reshape(rows, columns, samples)
    pattern = np.array(tags.get(33422, ()), int)
    if one(262, 0) == _MOSAIC:
        pattern = pattern.reshape(tags.get(33421) or (2, 2))
    origin, size = tags.get(50719) or (0.0, 0.0), tags.get(50720) or (active[3] - active[1], active[2] - active[0])
    out = Raw(number, order, bits, samples, kind == 1, tuple(active), pattern, black, np.array(tags.get(50715, ()), float), np.array(tags.get(50716, ()), float), tuple(map(float, tags.get(50717) or (2.0**bits - 1,))), (float(origin[0]), float(origin[1]), float(size[0]), float(size[1])), np.array(tags.get(50712, ()), int))
    if 324 in tags:
        w, h, places, sizes = one(322, width), one(323, height), tags[324], tags[325]
    else:
        w, h, places, sizes = width, min(one(278, height), height), tags.get(273, ()), tags.get(279, ())
    across = -(-width // w)
    for i, (at, n) in enumerate(zip(places, sizes, strict=True)):
        whole = Chunk(i // across * h, i % across * w, h if 324 in tags else min(h, height - i // across * h), w, at, n)
        out.chunks += _bands(whole, out) if out.packed else [whole]
    return out


def _bands(c: Chunk, raw: Raw) -> list[Chunk]:
    """Rows of packed samples lie at known places: a large strip becomes several chunks."""
    line = -(-c.width * raw.samples * raw.bits // 8)
    rows = max(1, BAND // max(1, c.width * raw.samples))
    return [replace(c, y=c.y + lo, height=min(rows, c.height - lo), at=c.at + lo * line, size=min(rows, c.height - lo) * line) for lo in range(0, c.height, rows)]


# ---------------------------------------------------------------- samples


def unpack_bits(body: bytes, height: int, width: int, bits: int, order: str = "<") -> np.ndarray:
    """Rows of samples packed from the highest bit on, each row from a new byte; 16 bits in the file's byte order."""
    line = -(-width * bits // 8)
    rows = np.frombuffer(body, np.uint8)
    if len(rows) < height * line:
        raise Damaged("too few samples")
    rows = rows[: height * line].reshape(height, line)
    if bits == 8:
        return rows.astype(np.uint16)
    if bits == 16:
        return rows.view(order + "u2").astype(np.uint16)
    out = np.empty((height, width), np.uint16)
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.uint16)
    step = max(1, BAND // max(1, width))
    for lo in range(0, height, step):
        single = np.unpackbits(rows[lo : lo + step], axis=1)[:, : width * bits]
        out[lo : lo + step] = single.reshape(-1, width, bits) @ weights
    return out


class Code:
    """A Huffman code by what stands at the next 16 bits: the code's length and the category of the difference."""

    def __init__(self, counts: Sequence[int], categories: Sequence[int]):
        lengths = np.repeat(np.arange(1, 17), counts)
        spans = 1 << (16 - lengths)
        if len(lengths) != len(categories) or spans.sum() > 1 << 16:
            raise Damaged("a code table")
        unused = (1 << 16) - int(spans.sum())
        self.length = np.concatenate((np.repeat(lengths, spans), np.zeros(unused))).astype(np.uint8)
        self.category = np.concatenate((np.repeat(np.array(categories, int), spans), np.zeros(unused))).astype(np.uint8)
        extra = np.where(self.category == 16, 0, self.category)
        self.step = np.where(self.length > 0, self.length + extra, 0).astype(np.uint8)


def _differences(body: bytes, codes: list[Code], n: int) -> np.ndarray:
    """``n`` differences coded in turn by ``codes``."""
    b = np.frombuffer(body + bytes(8), np.uint8).astype(np.int64)
    steps: dict[int, bytes] = {}
    for code in {id(c): c for c in codes}.values():
        made = []
        for lo in range(0, len(b) - 8, 1 << 16):
            part = b[lo : min(lo + (1 << 16), len(b) - 8) + 2]
            word = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
            made.append(code.step[(word[:, None] >> np.arange(8, 0, -1)) & 0xFFFF].tobytes())
        steps[id(code)] = b"".join(made)
    turn = [steps[id(c)] for c in codes]
    at, p = [0] * n, 0
    try:
        if len(steps) == 1:
            step = turn[0]
            for k in range(n):
                at[k] = p
                p += step[p]
        else:
            for k in range(n):
                at[k] = p
                p += turn[k % len(turn)][p]
    except IndexError:
        raise Damaged("the coded samples end early") from None
    at = np.array(at, np.int64)
    length, category = np.empty(n, np.int64), np.empty(n, np.int64)
    word = _bits(b, at, 16)
    for k, code in enumerate(codes):
        length[k :: len(codes)] = code.length[word[k :: len(codes)]]
        category[k :: len(codes)] = code.category[word[k :: len(codes)]]
    if n and not length.all():
        raise Damaged("a code that isn't in the table")
    size = np.where(category == 16, 0, category)
    if n and int(at[-1] + length[-1] + size[-1]) > 8 * len(body):
        raise Damaged("the coded samples end early")
    extra = _bits(b, at + length, 16) >> (16 - size)
    out = np.where(extra < (1 << np.maximum(size - 1, 0)), extra - (1 << size) + 1, extra)
    return np.where(category == 16, 32768, np.where(size == 0, 0, out))


def _bits(b: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` <= 16 bits from each place on."""
    byte = at >> 3
    word = b[byte] << 16 | b[byte + 1] << 8 | b[byte + 2]
    return (word >> (24 - n - (at & 7))) & ((1 << n) - 1)


def undo_prediction(d: np.ndarray, predictor: int, first: int) -> np.ndarray:
    """Samples of one component from their differences, modulo 2^16.  The first row is predicted from the left, the first
    column from above."""
    d = d.astype(np.int64)
    d[0, 0] += first
    if predictor == 1:
        d[:, 0] = np.cumsum(d[:, 0])
        return np.cumsum(d, axis=1) & 0xFFFF
    d[0] = np.cumsum(d[0])
    if predictor == 2:
        return np.cumsum(d, axis=0) & 0xFFFF
    if predictor == 4:  # left + above - corner: steps along a row add up down the rows
        d[0, 1:] = np.diff(d[0])
        d[:, 1:] = np.cumsum(d[:, 1:], axis=0)
        d[:, 0] = np.cumsum(d[:, 0])
        return np.cumsum(d, axis=1) & 0xFFFF
    out = d & 0xFFFF
    for y in range(1, len(d)):
        above, row = out[y - 1].tolist(), d[y].tolist()
        row[0] = (row[0] + above[0]) & 0xFFFF
        for x in range(1, len(row)):
            left, up, corner = row[x - 1], above[x], above[x - 1]
            guess = corner if predictor == 3 else left + ((up - corner) >> 1) if predictor == 5 else up + ((left - corner) >> 1) if predictor == 6 else (left + up) >> 1
            row[x] = (row[x] + guess) & 0xFFFF
        out[y] = row
    return out


_SCAN_END = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]")
_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")


def decode_lossless(raw: bytes) -> np.ndarray:
    """(lines, columns, components) of a lossless JPEG stream with Huffman codes and whole components."""
    at, tables, every, frame = 2, {}, 0, None
    if raw[:2] != b"\xff\xd8":
        raise Damaged("no JPEG stream")
    try:
        while True:
            while raw[at + 1] == 0xFF:
                at += 1
            mark, (n,) = raw[at + 1], struct.unpack_from(">H", raw, at + 2)
            body, at = raw[at + 4 : at + 2 + n], at + 2 + n
            if mark == 0xC4:
                while body:
                    counts = body[1:17]
                    tables[body[0] & 15] = Code(list(counts), list(body[17 : 17 + sum(counts)]))
                    body = body[17 + sum(counts) :]
            elif mark == 0xDD:
                (every,) = struct.unpack(">H", body)
            elif mark == 0xC3:
                bits, lines, columns, components = struct.unpack_from(">BHHB", body)
                frame = bits, lines, columns, [body[6 + 3 * i] for i in range(components)], [body[7 + 3 * i] for i in range(components)]
            elif 0xC0 <= mark <= 0xCF and mark != 0xCC:
                raise Unsupported("a JPEG stream that isn't lossless with Huffman codes")
            elif mark == 0xDA:
                break
        bits, lines, columns, names, sampling = frame
        if any(s != 0x11 for s in sampling) or body[0] != len(names):
            raise Unsupported("subsampled or separate components")
        chosen = {body[1 + 2 * i]: tables[body[2 + 2 * i] >> 4] for i in range(body[0])}
        codes = [chosen[i] for i in names]
        predictor, shift = body[1 + 2 * len(names)], body[3 + 2 * len(names)] & 15
    except (IndexError, struct.error, KeyError, TypeError) as e:
        raise Damaged(f"a JPEG header ({e})") from None
    end = _SCAN_END.search(raw, at)
    parts = _RESTART.split(raw[at : end.start() if end else len(raw)])
    rows = every // columns if every else lines
    if every and every % columns or not 1 <= predictor <= 7:
        raise Unsupported("restarts within a line or another predictor")
    out = []
    for lo, part in zip(range(0, lines, max(rows, 1)), parts, strict=False):
        h = min(rows, lines - lo)
        d = _differences(part.replace(b"\xff\x00", b"\xff"), codes, h * columns * len(codes)).reshape(h, columns, len(codes))
        out.append(np.stack([undo_prediction(d[..., c], predictor, 1 << (bits - shift - 1)) for c in range(len(codes))], axis=2))
    out = np.concatenate(out) if out else np.zeros((0, columns, len(codes)), np.int64)
    if len(out) != lines:
        raise Damaged("restart intervals are missing")
    return (out << shift).astype(np.uint16)


def decode_chunk(body: bytes, c: Chunk, raw: Raw) -> np.ndarray:
    """(rows, columns, samples) of a chunk."""
    if raw.packed:
        flat = unpack_bits(body, c.height, c.width * raw.samples, raw.bits, raw.order)
    else:
        flat = decode_lossless(body)
        if flat[..., 0].size * flat.shape[2] < c.width * raw.samples * flat.shape[0]:
            raise Damaged("a tile that is too small")
        flat = flat.reshape(flat.shape[0], -1)[: c.height, : c.width * raw.samples]
    out = flat.reshape(len(flat), c.width, raw.samples)
    return raw.table[np.minimum(out, len(raw.table) - 1)] if len(raw.table) else out


# ---------------------------------------------------------------- the source


class Share(InputPartition):
    """The chunks of a file that begin in [start, stop)."""

    def __init__(self, path: str, start: int, stop: int):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


class RawReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = schema.names
        self.schema = pa.schema([(f.name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[f.dataType.simpleString()]) for f in schema.fields])
        self.path, self.share = options["path"], int(options.get("shareBytes", 32 << 20))
        self.window = {"y": [-math.inf, math.inf], "x": [-math.inf, math.inf]}

    @property
    def pixels(self) -> bool:
        return bool({"y", "x", "c", "v", "black"} & set(self.names))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of y and x choose chunks; Spark still applies every filter to the rows."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in self.window and isinstance(getattr(f, "value", None), (int, float)):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.window[name][0] = max(self.window[name][0], f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.window[name][1] = min(self.window[name][1], f.value)
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        start = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        out = []
        for f in files:
            if f.type == fs.FileType.File and f.path.lower().endswith(".dng"):
                step = self.share if self.pixels else max(f.size, 1)
                out += [Share(start + f.path, lo, lo + step) for lo in range(0, max(f.size, 1), step)]
        return out or [Share("", 0, 0)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, place = fs.FileSystem.from_uri(partition.path)
        with store.open_input_file(place) as file:
            read = lambda at, n: file.read_at(n, at)
            try:
                images = read_images(read)
            except (Damaged, Unsupported, struct.error) as e:
                if partition.start == 0:
                    yield self._batch({"path": partition.path, "error": f"{type(e).__name__}: {e}"}, 1)
                return
            for raw in images:
                known = self._known(partition.path, raw)
                if not self.pixels:
                    yield self._batch(known, 1)
                    continue
                for c in raw.chunks:
                    if partition.start <= c.at < partition.stop and self._wanted(c, raw):
                        try:
                            yield from self._rows(known, c, raw, decode_chunk(_exactly(read, c.at, c.size), c, raw))
                        except (Damaged, Unsupported) as e:
                            yield self._batch(known | {"error": f"{type(e).__name__}: {e}"}, 1)

    def _known(self, path: str, raw: Raw) -> dict[str, object]:
        frame = int.from_bytes(hashlib.sha256(f"{raw.image} {path}".encode()).digest()[:8], "big") >> 1
        return {"path": path, "image": raw.image, "frame": frame, "width": raw.width, "height": raw.height, "bits": raw.bits, "samples": raw.samples, "cfa": "".join(map(str, raw.pattern.ravel())) or None, "crop_x": raw.crop[0], "crop_y": raw.crop[1], "crop_width": raw.crop[2], "crop_height": raw.crop[3], "white": raw.white[0]}

    def _wanted(self, c: Chunk, raw: Raw) -> bool:
        y, x = c.y - raw.active[0], c.x - raw.active[1]
        (y0, y1), (x0, x1) = self.window["y"], self.window["x"]
        return y <= y1 and y + c.height > y0 and x <= x1 and x + c.width > x0 and y < raw.height and x < raw.width and y + c.height > 0 and x + c.width > 0

    def _rows(self, known: dict[str, object], c: Chunk, raw: Raw, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, 200_000 // max(1, v.shape[1] * raw.samples))
        for lo in range(0, len(v), step):
            part = v[lo : lo + step]
            y, x, s = (a.ravel() for a in np.meshgrid(np.arange(len(part)) + c.y + lo - raw.active[0], np.arange(v.shape[1]) + c.x - raw.active[1], np.arange(raw.samples), indexing="ij"))
            keep = (y >= 0) & (y < raw.height) & (x >= 0) & (x < raw.width)
            y, x, s, value = y[keep], x[keep], s[keep], part.ravel()[keep]
            if not len(y):
                continue
            rows, columns = raw.black.shape[:2]
            black = raw.black[y % rows, x % columns, s]
            black = black + (raw.black_y[y] if len(raw.black_y) else 0) + (raw.black_x[x] if len(raw.black_x) else 0)
            color = raw.pattern[y % raw.pattern.shape[0], x % raw.pattern.shape[1]] if raw.pattern.ndim == 2 else s
            white = np.array(raw.white)[np.minimum(s, len(raw.white) - 1)]
            yield self._batch(known | {"y": y, "x": x, "c": color, "v": value, "black": black, "white": white}, len(y))

    def _batch(self, columns: dict[str, object], n: int) -> pa.RecordBatch:
        """``n`` rows of the schema: arrays as they are, single values repeated, others null."""
        made = []
        for f in self.schema:
            value = columns.get(f.name)
            made.append(pa.nulls(n, f.type) if value is None else pa.array(value.astype(f.type.to_pandas_dtype())) if isinstance(value, np.ndarray) else pa.repeat(pa.scalar(value, f.type), n))
        return pa.RecordBatch.from_arrays(made, schema=self.schema)


class RawSource(DataSource):
    """Options: ``path`` (a file or folder on any file system that Arrow reads), ``shareBytes`` (bytes of a task, 32 MB)."""

    @classmethod
    def name(cls) -> str:
        return "dng"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RawReader(schema, dict(self.options))


def read_raw(spark: SparkSession, path: str, share_bytes: int = 32 << 20) -> DataFrame:
    """A row a sample: (path, image, frame, ..., y, x, c, v, black, white, error).

    Places count from the active area; ``c`` is the colour of the place in the mosaic, or the number of the sample in images
    of whole pixels; levels are as stored (``normalised`` applies them).  What can't be read gives a row with ``error``; an
    empty folder gives no row.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawSource)
    return spark.read.format("dng").option("shareBytes", share_bytes).load(path)


def read_raw_directory(spark: SparkSession, path: str) -> DataFrame:
    """A row an image, from the files' directories alone: size, bits, mosaic, crop and white level."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawSource)
    return spark.read.format("dng").schema(f"{_DIRECTORY}, error string").load(path)


def cropped(px: DataFrame) -> DataFrame:
    """The pixels of the recommended crop, counted from its corner."""
    y, x = F.col("y") - F.col("crop_y"), F.col("x") - F.col("crop_x")
    return px.where((y >= 0) & (x >= 0) & (y < F.col("crop_height")) & (x < F.col("crop_width"))).withColumns({"y": y.cast("int"), "x": x.cast("int")})


def normalised(px: DataFrame, top: float = 65535.0) -> DataFrame:
    """``v`` between its black level (0) and the white level (``top``), as the operators on mosaics take it."""
    return px.withColumn("v", F.greatest(F.lit(0.0), (F.col("v") - F.col("black")) / (F.col("white") - F.col("black"))) * top)


# ---------------------------------------------------------------- the sink

#: Code lengths of the categories 0 to 16 in files written here: a complete prefix of short codes, longer ones behind.
_LENGTHS = [3] * 6 + list(range(4, 15))


def _predicted(v: np.ndarray, predictor: int, first: int) -> np.ndarray:
    """What a reader would predict each sample of one component from."""
    left, above, corner = (np.roll(v, by, (0, 1)) for by in ((0, 1), (1, 0), (1, 1)))
    out = {1: left, 2: above, 3: corner, 4: left + above - corner, 5: left + ((above - corner) >> 1), 6: above + ((left - corner) >> 1), 7: (left + above) >> 1}[predictor].copy()
    out[0] = left[0]
    out[:, 0] = above[:, 0]
    out[0, 0] = first
    return out


def encode_lossless(v: np.ndarray, bits: int, predictor: int = 1, restart: int = 0) -> bytes:
    """A lossless JPEG stream of (lines, columns, components); ``restart``: lines between restarts, 0 for none."""
    lines, columns, parts = v.shape
    counts = bytes(np.bincount(_LENGTHS, minlength=17)[1:].tolist())
    head = struct.pack(">BHHB", bits, lines, columns, parts) + b"".join(bytes((i, 0x11, 0)) for i in range(parts))
    marks = [(0xC4, b"\0" + counts + bytes(range(17))), (0xC3, head)]
    if restart:
        marks.append((0xDD, struct.pack(">H", restart * columns)))
    marks.append((0xDA, bytes((parts,)) + b"".join(bytes((i, 0)) for i in range(parts)) + bytes((predictor, 0, 0))))
    out = b"\xff\xd8" + b"".join(b"\xff" + bytes((m,)) + struct.pack(">H", len(body) + 2) + body for m, body in marks)
    codes, code = [], 0
    for k, n in enumerate(_LENGTHS):
        code = (code + 1) << (n - _LENGTHS[k - 1]) if k else 0
        codes.append(code)
    for number, lo in enumerate(range(0, lines, restart or lines)):
        band = v[lo : lo + (restart or lines)].astype(np.int64)
        d = np.stack([band[..., c] - _predicted(band[..., c], predictor, 1 << (bits - 1)) for c in range(parts)], axis=2).ravel() & 0xFFFF
        d = np.where(d > 32768, d - 65536, d)
        category = np.ceil(np.log2(np.abs(d) + 1)).astype(int)
        size = np.where(category == 16, 0, category)
        extra = np.where(d < 0, d + (1 << category) - 1, d) & ((1 << size) - 1)
        word, n = np.array(codes)[category] << size | extra, np.array(_LENGTHS)[category] + size
        ends = np.cumsum(n)
        place = np.arange(ends[-1]) - np.repeat(ends - n, n)
        stream = (np.repeat(word, n) >> (np.repeat(n, n) - 1 - place)) & 1
        stream = np.concatenate((stream, np.ones(-len(stream) % 8, int))).astype(np.uint8)
        out += (b"\xff" + bytes((0xD0 + (number - 1) % 8,)) if number else b"") + np.packbits(stream).tobytes().replace(b"\xff", b"\xff\x00")
    return out + b"\xff\xd9"


def pack_bits(v: np.ndarray, bits: int, order: str = "<") -> bytes:
    """Rows of samples packed as ``unpack_bits`` reads them."""
    if bits == 16:
        return v.astype(order + "u2").tobytes()
    single = (v[..., None].astype(np.int64) >> np.arange(bits - 1, -1, -1)) & 1
    return np.packbits(single.reshape(len(v), -1).astype(np.uint8), axis=1).tobytes()


def encode_dng(v: np.ndarray, bits: int = 14, tile: tuple[int, int] | None = None, lossless: bool = True, predictor: int = 1, restart: int = 0, pattern: Sequence[int] = (0, 1, 1, 2), black: Sequence[float] = (0,), white: int | None = None, active: Sequence[int] = (), crop: Sequence[float] = (), order: str = "<", strip: int | None = None) -> bytes:
    """A DNG file of one image (rows, columns, samples): tiles, or strips of ``strip`` rows."""
    height, width, samples = v.shape
    h, w = tile or (strip or height, width)
    parts = []
    for y in range(0, height, h):
        for x in range(0, width, w):
            part = v[y : y + h, x : x + w]
            if tile:
                part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)), mode="edge")
            halves = 2 if samples == 1 and part.shape[1] % 2 == 0 else samples
            parts.append(encode_lossless(part.reshape(len(part), -1, halves), bits, predictor, restart) if lossless else pack_bits(part.reshape(len(part), -1), bits, order))
    mosaic = samples == 1
    side = math.isqrt(len(black) // samples)
    # tag, type, values: short 3, long 4, rational 5
    entries = [(254, 4, [0]), (256, 4, [width]), (257, 4, [height]), (258, 3, [bits] * samples), (259, 3, [7 if lossless else 1]), (262, 3, [_MOSAIC if mosaic else _LINEAR]), (277, 3, [samples])]
    entries += [(322, 4, [w]), (323, 4, [h])] if tile else [(278, 4, [h])]
    entries += [(33421, 3, [math.isqrt(len(pattern))] * 2), (33422, 1, list(pattern))] if mosaic else []
    entries += [(50706, 1, [1, 4, 0, 0]), (50713, 3, [side, side]), (50714, 5, list(black)), (50717, 4, [white if white is not None else (1 << bits) - 1])]
    entries += [(50719, 5, list(crop[:2])), (50720, 5, list(crop[2:]))] if crop else []
    entries += [(50829, 4, list(active))] if active else []
    entries += [(324 if tile else 273, 4, [0] * len(parts)), (325 if tile else 279, 4, [len(p) for p in parts])]
    entries.sort()
    at = 8 + 2 + 12 * len(entries) + 4
    bodies = {}
    for tag, kind, values in entries:
        bodies[tag] = b"".join(struct.pack(order + "II", round(x * 1000), 1000) for x in values) if kind == 5 else struct.pack(order + {1: "B", 3: "H", 4: "I"}[kind] * len(values), *values)
    data = at + sum(len(b) for b in bodies.values() if len(b) > 4)
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])).astype(int) + data
    bodies[324 if tile else 273] = struct.pack(f"{order}{len(parts)}I", *starts)
    out, behind = struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(entries)), b""
    for tag, kind, values in entries:
        body = bodies[tag]
        out += struct.pack(order + "HHI", tag, kind, len(values)) + (body.ljust(4, b"\0") if len(body) <= 4 else struct.pack(order + "I", at + len(behind)))
        behind += body if len(body) > 4 else b""
    return (b"II" if order == "<" else b"MM") + out + struct.pack(order + "I", 0) + behind + b"".join(parts)


def write_raw(px: DataFrame, path: str, lossless: bool = True, bits: int = 14, tile: tuple[int, int] = (256, 256)) -> DataFrame:
    """Writes each frame of a mosaic (frame, y, x, v as integers; red, green, green, blue) as ``path/<frame>.dng``; returns
    (frame, bytes).  A frame is gathered in one task: a file is one array.  Nothing is written before an action."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        v = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 1), np.int64)
        v[y, x, 0] = rows["v"].to_numpy()
        body = encode_dng(v, bits, tile if lossless else None, lossless, strip=64)
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{key[0].as_py()}.dng") as out:
            out.write(body)
        return pa.table({"frame": pa.array([key[0].as_py()], pa.int64()), "bytes": pa.array([len(body)], pa.int64())})

    rows = px.select(*[F.col(c).cast("long").alias(c) for c in ("frame", "y", "x", "v")])
    return rows.groupBy("frame").applyInArrow(run, "frame long, bytes long")
