"""Progressive JPEG files, planted by a plain encoder of their scans, equal their sequential twins."""

import struct
from collections import Counter

import numpy as np
import pytest

from lumicat.sources import codecs, jpeg


def picture(h, w, seed=0):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    px = np.stack((120 + 80 * np.sin(x / 7), 100 + 60 * np.cos(y / 5 + x / 11), 128 + 0 * x + 100 * (x > w // 2)), 2) + r.normal(0, 12, (h, w, 3))
    return np.clip(px, 0, 255).astype(np.uint8)


class Writer:
    """Symbols and bits of a scan; codes are made when all are known."""

    def __init__(self):
        self.items, self.counts = [], {}

    def symbol(self, table, s):
        self.items.append((table, s))
        self.counts.setdefault(table, Counter())[s] += 1

    def bits(self, v, n):
        self.items.append((None, f"{v:0{n}b}" if n else ""))

    def restart(self):
        self.items.append((None, None))

    def done(self):
        """Tables as markers, and the coded bytes."""
        heads, codes = b"", {}
        for table, counts in sorted(self.counts.items()):
            made = jpeg._huffman(counts)
            codes[table] = {s: f"{c:0{n}b}" for (n, c), s in jpeg._codes(*made).items()}
            heads += marker(0xC4, bytes([table]) + made[0] + made[1])
        out, text, n = b"", "", 0
        for table, v in [*self.items, (None, None)]:
            if v is None:
                text += "1" * (-len(text) % 8)
                out += int(text or "0", 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0") + bytes((0xFF, 0xD0 + n % 8))
                text, n = "", n + 1
            else:
                text += codes[table][v] if table is not None else v
        return heads, out[:-2]


def marker(kind, body):
    return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body


def size(v):
    return abs(v).bit_length()


def extra(v, n):
    return v if v > 0 else v + (1 << n) - 1


def progressive(raw, restart=0, runs=True):
    """The same coefficients in scans: DC in two steps, AC in two bands, bits in three steps."""
    frame, planes, quant = jpeg.coefficients(raw)
    h, w, parts = frame
    out = b"\xff\xd8" + b"".join(marker(0xDB, bytes([k]) + t.astype(np.uint8).tobytes()) for k, t in quant.items())
    out += marker(0xC2, struct.pack(">BHHB", 8, h, w, len(parts)) + b"".join(bytes([n, hs << 4 | vs, q]) for n, hs, vs, q in parts))
    if restart:
        out += marker(0xDD, struct.pack(">H", restart))

    def scan(chosen, first, last, high, low, write):
        nonlocal out
        across, total, units = jpeg._grid(frame, [(n, 0, 16) for n in chosen])
        wr, state = Writer(), {}
        for mcu in range(total):
            if restart and mcu and mcu % restart == 0:
                flush(wr, state)
                wr.restart()
                state.clear()
            for n, bx, by, hs, vs, *_ in units:
                write(wr, state, n, planes[n][mcu // across * vs + by, mcu % across * hs + bx][jpeg.ZIGZAG].tolist(), first, last, low)
        flush(wr, state)
        heads, body = wr.done()
        out += heads + marker(0xDA, bytes([len(chosen)]) + b"".join(bytes([n, 0]) for n in chosen) + bytes((first, last, high << 4 | low))) + body

    def flush(wr, state):
        if n := state.get("empty", 0):
            k = n.bit_length() - 1
            wr.symbol(16, k << 4)
            wr.bits(n - (1 << k), k)
            for b in state.pop("later", []):
                wr.bits(b, 1)
            state["empty"] = 0

    def dc_first(wr, state, n, z, first, last, low):
        v = z[0] >> low
        d = v - state.get(n, 0)
        state[n] = v
        wr.symbol(0, size(d))
        wr.bits(extra(d, size(d)) if d else 0, size(d))

    def dc_next(wr, state, n, z, first, last, low):
        wr.bits(z[0] >> low & 1, 1)

    def cut(v, low):
        return (abs(v) >> low) * (1 if v > 0 else -1)

    def ac_first(wr, state, n, z, first, last, low):
        run = 0
        for k in range(first, last + 1):
            v = cut(z[k], low)
            if not v:
                run += 1
                continue
            flush(wr, state)
            while run > 15:
                wr.symbol(16, 0xF0)
                run -= 16
            wr.symbol(16, run << 4 | size(v))
            wr.bits(extra(v, size(v)), size(v))
            run = 0
        if run:
            state["empty"] = state.get("empty", 0) + 1
            if not runs or state["empty"] == 0x7FFF:
                flush(wr, state)

    def ac_next(wr, state, n, z, first, last, low):
        end = max((k for k in range(first, last + 1) if abs(z[k]) >> low == 1), default=0)
        run, later = 0, []
        for k in range(first, last + 1):
            a = abs(z[k]) >> low
            if not a:
                run += 1
                continue
            while run > 15 and k <= end:
                flush(wr, state)
                wr.symbol(16, 0xF0)
                for b in later:
                    wr.bits(b, 1)
                run, later = run - 16, []
            if a > 1:
                later.append(a & 1)
                continue
            flush(wr, state)
            wr.symbol(16, run << 4 | 1)
            wr.bits(int(z[k] > 0), 1)
            for b in later:
                wr.bits(b, 1)
            run, later = 0, []
        if run or later:
            state["empty"] = state.get("empty", 0) + 1
            state.setdefault("later", []).extend(later)
            if not runs or len(state["later"]) > 900:
                flush(wr, state)

    names = [p[0] for p in parts]
    scan(names, 0, 0, 0, 1, dc_first)
    for n in names:
        scan([n], 1, 5, 0, 2, ac_first)
        scan([n], 6, 63, 0, 2, ac_first)
        scan([n], 1, 63, 2, 1, ac_next)
    scan(names, 0, 0, 1, 0, dc_next)
    for n in names[::-1]:
        scan([n], 1, 63, 1, 0, ac_next)
    return out + b"\xff\xd9"


@pytest.mark.parametrize(("h", "w", "subsample", "restart", "runs"), ((40, 56, False, 0, True), (43, 61, True, 0, True), (33, 20, True, 3, True), (16, 16, False, 0, False), (9, 70, True, 2, False)))
def test_progressive_files_equal_their_twins(h, w, subsample, restart, runs):
    for px, quality in ((picture(h, w), 90), (picture(h, w, 1), 40), (picture(h, w)[..., :1], 75)):
        twin = codecs.encode_jpeg(px, quality, subsample)
        made = progressive(twin, restart, runs)
        assert made != twin and (codecs.decode_jpeg(made) == codecs.decode_jpeg(twin)).all()
        assert jpeg.coefficients(made)[0] == jpeg.coefficients(twin)[0]


def test_components_in_scans_of_their_own():
    """A sequential file whose components come one by one."""
    twin = codecs.encode_jpeg(picture(30, 45), 80, True)
    frame, planes, quant = jpeg.coefficients(twin)
    h, w, parts = frame
    out = b"\xff\xd8" + b"".join(marker(0xDB, bytes([k]) + t.astype(np.uint8).tobytes()) for k, t in quant.items())
    out += marker(0xC0, struct.pack(">BHHB", 8, h, w, len(parts)) + b"".join(bytes([n, hs << 4 | vs, q]) for n, hs, vs, q in parts))
    for n, *_ in parts:
        across, total, _ = jpeg._grid(frame, [(n, 0, 16)])
        wr, before = Writer(), 0
        for i in range(total):
            z = planes[n][i // across, i % across][jpeg.ZIGZAG].tolist()
            wr.symbol(0, size(z[0] - before))
            wr.bits(extra(z[0] - before, size(z[0] - before)) if z[0] != before else 0, size(z[0] - before))
            before, run = z[0], 0
            for v in z[1:]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    wr.symbol(16, 0xF0)
                    run -= 16
                wr.symbol(16, run << 4 | size(v))
                wr.bits(extra(v, size(v)), size(v))
                run = 0
            if run:
                wr.symbol(16, 0)
        heads, body = wr.done()
        out += heads + marker(0xDA, bytes((1, n, 0, 0, 63, 0))) + body
    assert (codecs.decode_jpeg(out + b"\xff\xd9") == codecs.decode_jpeg(twin)).all()


def test_cut_files_give_less_or_raise():
    made = progressive(codecs.encode_jpeg(picture(24, 24), 80))
    for n in range(2, len(made), 37):
        try:
            assert codecs.decode_jpeg(made[:n]).shape == (24, 24, 3)
        except jpeg.UnsupportedJpeg:
            pass
    with pytest.raises(jpeg.UnsupportedJpeg, match="arithmetic|progressive"):
        codecs.decode_jpeg(made.replace(b"\xff\xc2", b"\xff\xca", 1))
