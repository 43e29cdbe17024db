"""Camera raw files: planted files come back, chunks are left out, damage is told."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicat.sources import raw as R


def mosaic(h, w, bits, seed=0):
    """Smooth areas, noise and extremes."""
    r = np.random.default_rng(seed)
    v = (np.add.outer(np.arange(h) * 37, np.arange(w) * 11) + r.integers(0, 200, (h, w))) % (1 << bits)
    v[: h // 8, : w // 8] = r.integers(0, 1 << bits, (h // 8, w // 8))
    v[-1, -1], v[-1, 0] = (1 << bits) - 1, 0
    return v[..., None]


@pytest.mark.parametrize("predictor", range(1, 8))
def test_lossless_jpeg_round_trip(predictor):
    for parts, bits, restart in ((1, 16, 0), (2, 14, 0), (3, 12, 4), (4, 10, 5)):
        v = np.concatenate([mosaic(23, 19, bits, seed) for seed in range(parts)], axis=2)
        assert (R.decode_lossless(R.encode_lossless(v, bits, predictor, restart)) == v).all()


def test_lossless_jpeg_takes_each_component_s_own_code():
    """Two tables, and a stream written bit by bit by hand."""
    # component 0: category 0 as 0, 2 as 10; component 1: category 0 as 1 0, 1 as 0
    dht = lambda i, counts, cats: b"\xff\xc4" + struct.pack(">H", 19 + len(cats)) + bytes((i,)) + bytes(counts + [0] * (16 - len(counts))) + bytes(cats)
    head = b"\xff\xd8" + dht(0, [1, 1], [0, 2]) + dht(1, [1, 1], [1, 0])
    head += b"\xff\xc3" + struct.pack(">HBHHB", 14, 8, 1, 2, 2) + bytes((1, 0x11, 0, 2, 0x11, 0)) + b"\xff\xda" + struct.pack(">HB", 10, 2) + bytes((1, 0x00, 2, 0x10, 1, 0, 0))
    # (+3, -1), (0, 0): 10 11, 0 0, 0, 10 and ones behind
    body = np.packbits([1, 0, 1, 1, 0, 0, 0, 1, 0, 1, 1, 1, 1, 1, 1, 1]).tobytes()
    got = R.decode_lossless(head + body.replace(b"\xff", b"\xff\x00") + b"\xff\xd9")
    assert got.tolist() == [[[131, 127], [131, 127]]]


def test_a_difference_of_half_the_range():
    v = np.array([[0, 32768, 0, 65535, 0]])[..., None]
    assert (R.decode_lossless(R.encode_lossless(v, 16)) == v).all()


def test_packed_bits_match_the_definition():
    r = random.Random(1)
    for bits in (8, 10, 12, 14, 16):
        v = np.array([[r.randrange(1 << bits) for _ in range(7)] for _ in range(5)])
        body = R.pack_bits(v, bits, ">")
        line = "".join(f"{x:0{bits}b}" for x in v[0])
        assert "".join(f"{b:08b}" for b in body[: -(-7 * bits // 8)]).startswith(line)
        assert (R.unpack_bits(body, 5, 7, bits, ">") == v).all()


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raws")
    (folder / "deep").mkdir()
    made = {}
    for name, h, w, kw in (
        ("tiles.dng", 70, 90, {"bits": 14, "tile": (32, 48), "predictor": 6, "active": (4, 6, 68, 88), "crop": (2, 3, 60, 50), "black": (512, 513.5, 514, 515), "white": 16000}),
        ("strip12.DNG", 40, 33, {"bits": 12, "lossless": False, "strip": 7, "order": ">"}),
        ("deep/strip10.dng", 21, 50, {"bits": 10, "lossless": False, "pattern": (2, 1, 1, 0)}),
        ("restart.dng", 24, 30, {"bits": 16, "restart": 6, "strip": 24}),
    ):
        made[name] = mosaic(h, w, kw["bits"], len(name)), kw
        (folder / name).write_bytes(R.encode_dng(made[name][0], **kw))
    made["linear.dng"] = np.concatenate([mosaic(16, 20, 12, s) for s in range(3)], axis=2), {"bits": 12, "black": (1, 2, 3), "tile": (8, 16)}
    (folder / "linear.dng").write_bytes(R.encode_dng(made["linear.dng"][0], **made["linear.dng"][1]))
    (folder / "notes.txt").write_text("no image")
    return folder, made


def test_planted_files_come_back(spark, planted):
    folder, made = planted
    for share in (32 << 20, 500):
        got = {}
        for r in R.read_raw(spark, str(folder), share).collect():
            assert r.error is None
            got.setdefault(r.path.split("raws", 1)[1].split("/", 1)[1], []).append(r)
        assert set(got) == set(made)
        for name, (v, kw) in made.items():
            top, left, bottom, right = kw.get("active") or (0, 0, *v.shape[:2])
            want = v[top:bottom, left:right]
            colors = np.array(kw.get("pattern", (0, 1, 1, 2)))
            assert len(got[name]) == want.size
            for r in got[name]:
                c = r.c if v.shape[2] == 3 else 0
                assert r.v == want[r.y, r.x, c] and (v.shape[2] == 3 or r.c == colors[r.y % 2 * 2 + r.x % 2])
                if name == "tiles.dng":
                    assert r.black == kw["black"][r.y % 2 * 2 + r.x % 2] and r.white == 16000
                if name == "linear.dng":
                    assert r.black == c + 1


def test_crop_and_levels(spark, planted):
    folder, made = planted
    v, kw = made["tiles.dng"]
    rows = R.normalised(R.cropped(R.read_raw(spark, str(folder / "tiles.dng")))).collect()
    assert len(rows) == 60 * 50
    for r in rows:
        y, x = r.y + 3, r.x + 2
        black = kw["black"][y % 2 * 2 + x % 2]
        assert r.v == pytest.approx(max(0, (int(v[y + 4, x + 6, 0]) - black) / (16000 - black)) * 65535)


def test_directories_decode_nothing(spark, planted, tmp_path):
    folder, made = planted
    rows = {r.path.rsplit("/", 1)[1]: r for r in R.read_raw_directory(spark, str(folder)).collect()}
    r = rows["tiles.dng"]
    assert (r.width, r.height, r.bits, r.cfa, r.crop_x, r.crop_y, r.crop_width, r.crop_height, r.white) == (82, 64, 14, "0112", 2, 3, 60, 50, 16000)
    assert len(rows) == len(made) and rows["linear.dng"].cfa is None and rows["linear.dng"].samples == 3
    # without any samples behind them directories read as well
    body = (folder / "tiles.dng").read_bytes()
    start = min(c.at for c in R.read_images(lambda at, n: body[at : at + n])[0].chunks)
    (tmp_path / "cut.dng").write_bytes(body[:start])
    assert R.read_raw_directory(spark, str(tmp_path)).first().width == 82
    errors = R.read_raw(spark, str(tmp_path)).collect()
    assert errors and all(e.error and e.v is None for e in errors)


def test_windows_leave_out_tiles(spark, tmp_path):
    """Tiles outside the window are damaged: they would be told if they were read."""
    v = mosaic(96, 96, 12)
    body = bytearray(R.encode_dng(v, 12, (32, 32)))
    chunks = R.read_images(lambda at, n: bytes(body[at : at + n]))[0].chunks
    for c in chunks:
        if (c.y, c.x) != (32, 64):
            body[c.at : c.at + c.size] = bytes(c.size)
    (tmp_path / "w.dng").write_bytes(body)
    rows = R.read_raw(spark, str(tmp_path)).where("y >= 32 and y < 64 and x > 63 and x <= 95").collect()
    assert len(rows) == 32 * 32 and all(r.v == v[r.y, r.x, 0] for r in rows)
    assert R.read_raw(spark, str(tmp_path)).where("error is not null").count() == 8


def test_damage_and_foreign_files_are_told(spark, tmp_path):
    good = R.encode_dng(mosaic(16, 16, 12), 12, (16, 16))
    (tmp_path / "a.dng").write_bytes(b"")
    (tmp_path / "b.dng").write_bytes(b"MM\0\x2b" + bytes(20))
    (tmp_path / "c.dng").write_bytes(good[: len(good) // 2])
    (tmp_path / "d.dng").write_bytes(good)
    rows = R.read_raw(spark, str(tmp_path)).collect()
    bad = {r.path[-5]: r.error for r in rows if r.error}
    assert sorted(bad) == ["a", "b", "c"] and sum(not r.error for r in rows) == 256
    for cut in range(0, len(good), 97):
        try:
            for raw in R.read_images(lambda at, n, cut=cut: good[:cut][at : at + n]):
                for c in raw.chunks:
                    R.decode_chunk(good[:cut][c.at : c.at + c.size], c, raw)
        except (R.Damaged, R.Unsupported):
            pass
    (tmp_path / "none").mkdir()
    assert R.read_raw(spark, str(tmp_path / "none")).count() == 0


def test_linearisation_and_deltas():
    raw = R.Raw(0, "<", 8, 1, True, (0, 0, 2, 3), np.array([[0]]), np.zeros((1, 1, 1)), np.zeros(0), np.zeros(0), (255.0,), (0, 0, 3, 2), np.array([0, 10, 1000]))
    assert R.decode_chunk(bytes([0, 1, 2, 3, 200, 0]), R.Chunk(0, 0, 2, 3, 0, 6), raw)[..., 0].tolist() == [[0, 10, 1000], [1000, 1000, 0]]


def test_written_frames_come_back(spark, tmp_path):
    px = spark.range(3 * 40 * 30).select((F.col("id") / 1200).cast("long").alias("frame"), (F.col("id") % 1200 / 30).cast("int").alias("y"), (F.col("id") % 30).cast("int").alias("x"), (F.col("id") * 7919 % 16384).alias("v"))
    for lossless in (True, False):
        path = str(tmp_path / str(lossless))
        assert R.write_raw(px, path, lossless, tile=(16, 16)).where("bytes > 0").count() == 3
        back = R.read_raw(spark, path).select(F.regexp_extract("path", r"(\d+)\.dng$", 1).cast("long").alias("frame"), "y", "x", F.col("v").cast("long").alias("v"))
        assert back.exceptAll(px).count() == 0 and back.count() == 3600
