"""Image containers as bytes: PNG, portable pixmaps, TIFF, and the metadata directory of TIFF and JPEG files.

Decoders give (height, width, channels) arrays; encoders take them.  Only the standard library and numpy are used.
JPEG is in ``jpeg``, camera raw files in ``raw``; what needs another codec (JPEG XL) raises ``Unsupported``.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .jpeg import decode_jpeg, encode_jpeg


class Unsupported(ValueError):
    """A container or a variant that no decoder here reads."""


# ---- PNG

_PNG = b"\x89PNG\r\n\x1a\n"
_SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


def _png_chunks(raw: bytes):
    if raw[:8] != _PNG:
        raise Unsupported("not a PNG file")
    at = 8
    while at + 8 <= len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        yield kind, raw[at + 8 : at + 8 + n]
        at += 12 + n


def png_format(raw: bytes) -> dict:
    """Width, height, bits and samples from the header alone."""
    kind, body = next(_png_chunks(raw))
    w, h, bits, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
    return {"width": w, "height": h, "bits": bits, "samples": _SAMPLES.get(color, 1), "color": color, "interlace": interlace}


def decode_png(raw: bytes) -> np.ndarray:
    """8 or 16 bits, grey or colour; transparency is dropped and grey expanded to three channels."""
    f = png_format(raw)
    if f["bits"] not in (8, 16) or f["color"] == 3 or f["interlace"]:
        raise Unsupported("palettes, fewer than 8 bits and interlacing")
    data = zlib.decompress(b"".join(b for k, b in _png_chunks(raw) if k == b"IDAT"))
    unit = f["samples"] * f["bits"] // 8
    stride = f["width"] * unit
    rows = np.frombuffer(data, np.uint8).reshape(f["height"], stride + 1)
    out = np.zeros((f["height"], stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y, row in enumerate(rows):
        out[y] = above = _unfilter(int(row[0]), row[1:], above, unit)
    px = out.view(">u2") if f["bits"] == 16 else out
    px = px.reshape(f["height"], f["width"], f["samples"]).astype(np.uint16 if f["bits"] == 16 else np.uint8)
    px = px[..., : 3 if f["samples"] > 2 else 1]
    return np.repeat(px, 3, axis=2) if px.shape[2] == 1 else px


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, unit: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, unit), axis=0, dtype=np.uint8).ravel()
    out, up = row.astype(int).tolist(), above.tolist()
    for i in range(len(out)):
        a = out[i - unit] if i >= unit else 0
        b = up[i]
        if kind == 3:
            p = (a + b) // 2
        else:
            c = up[i - unit] if i >= unit else 0
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            p = a if pa <= pb and pa <= pc else b if pb <= pc else c
        out[i] = (out[i] + p) & 255
    return np.array(out, np.uint8)


def encode_png(px: np.ndarray, level: int = 6) -> bytes:
    """Grey or colour of 8 or 16 bits by the array's type."""
    h, w, s = px.shape
    bits = 16 if px.dtype == np.uint16 else 8
    body = px.astype(">u2" if bits == 16 else np.uint8).reshape(h, -1).view(np.uint8)
    lines = np.concatenate((np.full((h, 1), 2, np.uint8), np.diff(body, axis=0, prepend=np.zeros((1, body.shape[1]), np.uint8))), axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, bits, {1: 0, 3: 2}[s], 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


# ---- portable pixmaps


def decode_pnm(raw: bytes) -> np.ndarray:
    """Binary grey (P5) and colour (P6) maps of 8 or 16 bits."""
    fields, at = [], 0
    while len(fields) < 4:
        while at < len(raw) and raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        fields.append(raw[at:end])
        at = end
    if fields[0] not in (b"P5", b"P6"):
        raise Unsupported("not a binary pixmap")
    w, h, top = map(int, fields[1:])
    return decode_samples(raw[at + 1 :], w, h, 3 if fields[0] == b"P6" else 1, 16 if top > 255 else 8)


def decode_samples(raw: bytes, width: int, height: int, samples: int = 3, bits: int = 8, swap: bool = False) -> np.ndarray:
    """A bare buffer of interleaved samples; 16-bit ones are big-endian unless swapped."""
    kind = np.dtype(np.uint8 if bits == 8 else "<u2" if swap else ">u2")
    px = np.frombuffer(raw, kind, width * height * samples).reshape(height, width, samples)
    px = px.astype(np.uint8 if bits == 8 else np.uint16)
    return np.repeat(px, 3, axis=2) if samples == 1 else px


def encode_pnm(px: np.ndarray) -> bytes:
    h, w, s = px.shape
    wide = px.dtype == np.uint16
    return f"P{6 if s == 3 else 5}\n{w} {h}\n{65535 if wide else 255}\n".encode() + px.astype(">u2" if wide else np.uint8).tobytes()


# ---- TIFF

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def tiff_directory(raw: bytes, base: int = 0, at: int | None = None) -> dict[int, object]:
    """Tags of one directory: numbers, tuples, text or bytes; rationals become floats.  Damaged entries are left out."""
    order = {b"II": "<", b"MM": ">"}.get(raw[base : base + 2])
    if not order or struct.unpack_from(order + "H", raw, base + 2)[0] != 42:
        raise Unsupported("not a TIFF directory")
    at = base + struct.unpack_from(order + "I", raw, base + 4)[0] if at is None else at
    out: dict[int, object] = {}
    for i in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
        size = _SIZES.get(kind, 1) * n
        place = at + 2 + 12 * i + 8
        if size > 4:
            place = base + struct.unpack_from(order + "I", raw, place)[0]
        if place + size > len(raw):
            continue
        if kind == 2:
            out[tag] = raw[place : place + n].split(b"\0")[0].decode("utf-8", "replace").strip()
        elif kind in (5, 10):
            v = struct.unpack_from(order + ("Ii"[kind == 10]) * 2 * n, raw, place)
            v = tuple(a / b if b else 0.0 for a, b in zip(v[::2], v[1::2], strict=True))
            out[tag] = v[0] if n == 1 else v
        elif kind in _CODES:
            v = struct.unpack_from(order + _CODES[kind] * n, raw, place)
            out[tag] = v[0] if n == 1 else v
        else:
            out[tag] = raw[place : place + n]
    return out


def preview(raw: bytes) -> bytes:
    """The JPEG preview that a TIFF-based or JPEG file carries; empty without one.  Only directories are read."""
    base = raw.find(b"Exif\0\0", 0, 65536) + 6 if raw[:2] == b"\xff\xd8" else 0
    try:
        order = {b"II": "<", b"MM": ">"}[raw[base : base + 2]]
        at, seen = base + struct.unpack_from(order + "I", raw, base + 4)[0], set()
        while at > base and at not in seen:
            seen.add(at)
            t = tiff_directory(raw, base, at)
            if isinstance(o := t.get(513), int) and isinstance(n := t.get(514), int):
                return raw[base + o : base + o + n]
            entries = struct.unpack_from(order + "H", raw, at)[0]
            at = base + struct.unpack_from(order + "I", raw, at + 2 + 12 * entries)[0]
    except (KeyError, struct.error, Unsupported):
        pass
    return b""


def camera_profile(raw: bytes) -> dict[str, object]:
    """A camera profile's fields: names, illuminants, colour and forward matrices, tone curve, table sizes.

    Fixed values: the tag numbers.  Such files carry their own magic number after the byte order.
    """
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if not order:
        raise Unsupported("not a profile")
    t = tiff_directory(raw[:2] + struct.pack(order + "H", 42) + raw[4:])
    names = {50708: "camera", 50936: "name", 50778: "illuminant_1", 50779: "illuminant_2", 50721: "color_matrix_1", 50722: "color_matrix_2", 50964: "forward_matrix_1", 50965: "forward_matrix_2", 50940: "tone_curve", 50937: "hue_sat_dims", 50938: "hue_sat_1", 50939: "hue_sat_2", 50981: "look_dims", 50982: "look", 51109: "baseline_exposure"}
    return {name: t[tag] for tag, name in names.items() if tag in t}


def gain_map(raw: bytes) -> dict[str, object]:
    """A gain map of an opcode list: area, pitches, grid size, spacing, origin and the gains by row; always big-endian."""
    head = struct.unpack_from(">8I", raw)
    v, h = struct.unpack_from(">2I", raw, 32)
    spacing = struct.unpack_from(">4d", raw, 40)
    planes = struct.unpack_from(">I", raw, 72)[0]
    gains = struct.unpack_from(f">{v * h * planes}f", raw, 76)
    keys = ("top", "left", "bottom", "right", "plane", "planes", "row_pitch", "col_pitch")
    return {**dict(zip(keys, head, strict=True)), "points_y": v, "points_x": h, "spacing": spacing[:2], "origin": spacing[2:], "map_planes": planes, "gains": gains}


def tiff_format(raw: bytes) -> dict:
    t = tiff_directory(raw)
    bits = t.get(258, 1)
    first = lambda v: v[0] if isinstance(v, tuple) else v
    return {"width": t.get(256), "height": t.get(257), "bits": first(bits), "samples": t.get(277, 1), "float": first(t.get(339, 1)) == 3, "planar": t.get(284, 1) == 2, "compression": t.get(259, 1)}


def decode_tiff(raw: bytes) -> np.ndarray:
    """Uncompressed or deflated strips of 8 or 16-bit integers or 32-bit floats, chunky or planar."""
    f, t = tiff_format(raw), tiff_directory(raw)
    if f["compression"] not in (1, 8, 32946) or (f["bits"], f["float"]) not in ((8, False), (16, False), (32, True)) or t.get(317, 1) != 1:
        raise Unsupported("this TIFF variant")
    order = "<" if raw[:2] == b"II" else ">"
    offsets, counts = ((v if isinstance(v, tuple) else (v,)) for v in (t[273], t[279]))
    data = b"".join(zlib.decompress(raw[o : o + n]) if f["compression"] != 1 else raw[o : o + n] for o, n in zip(offsets, counts, strict=True))
    kind = np.dtype({8: "u1", 16: order + "u2", 32: order + "f4"}[f["bits"]])
    px = np.frombuffer(data, kind, f["width"] * f["height"] * f["samples"])
    px = px.reshape(f["samples"], f["height"], f["width"]).transpose(1, 2, 0) if f["planar"] else px.reshape(f["height"], f["width"], f["samples"])
    px = px.astype(kind.newbyteorder("="))[..., : 3 if f["samples"] > 2 else 1]
    return np.repeat(px, 3, axis=2) if px.shape[2] == 1 else px


def encode_tiff(px: np.ndarray, compressed: bool = False) -> bytes:
    """One strip of 8 or 16-bit integers or 32-bit floats by the array's type."""
    h, w, s = px.shape
    bits = px.dtype.itemsize * 8
    data = np.ascontiguousarray(px.astype(px.dtype.newbyteorder("<"))).tobytes()
    data = zlib.compress(data) if compressed else data
    extra = 8 + 2 + 12 * 11 + 4
    entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, s, extra), (259, 3, 1, 8 if compressed else 1), (262, 3, 1, 2 if s == 3 else 1), (273, 4, 1, extra + 4 * s), (277, 3, 1, s), (278, 4, 1, h), (279, 4, 1, len(data)), (284, 3, 1, 1), (339, 3, s, extra + 2 * s)]
    sample = 3 if px.dtype.kind == "f" else 1
    out = b"II*\0" + struct.pack("<IH", 8, len(entries))
    for tag, kind, n, value in entries:
        if n == 1 and tag in (258, 339):
            value = bits if tag == 258 else sample
        out += struct.pack("<HHII", tag, kind, n, value)
    return out + struct.pack("<I", 0) + struct.pack(f"<{s}H", *[bits] * s) + struct.pack(f"<{s}H", *[sample] * s) + data


# ---- metadata

#: The tags that the catalog keeps.
_MAIN = {271: "make", 272: "model", 274: "orientation", 306: "modified", 18246: "rating"}
_EXIF = {33434: "shutter", 33437: "fnumber", 34855: "iso", 36867: "taken", 37380: "expcomp", 37386: "focal", 41989: "focal35", 37382: "focus_dist", 42036: "lens"}


def exif(raw: bytes) -> dict[str, object]:
    """The catalog's fields from a TIFF-based or JPEG file; empty where there are none."""
    base = 0
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] != 0xDA:
            n = struct.unpack_from(">H", raw, at + 2)[0]
            if raw[at + 1] == 0xE1 and raw[at + 4 : at + 10] == b"Exif\0\0":
                base = at + 10
                break
            at += 2 + n
        if not base:
            return {}
    try:
        main = tiff_directory(raw, base)
    except (Unsupported, struct.error):
        return {}
    out = {name: main[tag] for tag, name in _MAIN.items() if tag in main}
    if isinstance(at := main.get(34665), int):
        try:
            sub = tiff_directory(raw, base, base + at)
        except (Unsupported, struct.error):
            sub = {}
        out |= {name: sub[tag] for tag, name in _EXIF.items() if tag in sub}
    return out


DECODERS = {"jpg": decode_jpeg, "jpeg": decode_jpeg, "png": decode_png, "ppm": decode_pnm, "pgm": decode_pnm, "tif": decode_tiff, "tiff": decode_tiff}
ENCODERS = {"jpg": encode_jpeg, "jpeg": encode_jpeg, "png": encode_png, "ppm": encode_pnm, "pgm": encode_pnm, "tif": encode_tiff, "tiff": encode_tiff}


def decode(raw: bytes, extension: str) -> np.ndarray:
    """By extension; unknown ones raise."""
    if extension.lower() not in DECODERS:
        raise Unsupported(extension)
    return DECODERS[extension.lower()](raw)
