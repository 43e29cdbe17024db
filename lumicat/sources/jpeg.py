"""JPEG: Huffman coding of 8-bit samples, grey or YCbCr, with or without subsampled chroma.

The decoder reads sequential and progressive files, of one scan or many; arithmetic, lossless and 12-bit files raise.  The
encoder writes sequential files; it makes its own Huffman tables from the picture's symbols and quantisation tables from a
rule.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter

import numpy as np


class UnsupportedJpeg(ValueError):
    pass


def _zigzag() -> np.ndarray:
    """Positions of an 8 x 8 block along its diagonals, alternating in direction."""
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * y + x for y, x in order])


ZIGZAG = _zigzag()
_K = np.arange(8)
_DCT = np.cos(np.pi * (2 * _K[None, :] + 1) * _K[:, None] / 16) * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5)


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[(length, code)] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lookup(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """For each 16-bit prefix the symbol and the length of its code."""
    symbol, length = np.full(65536, -1, np.int32), np.zeros(65536, np.int32)
    for (n, code), s in _codes(counts, symbols).items():
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return symbol.tolist(), length.tolist()


def decode_jpeg(raw: bytes) -> np.ndarray:
    """(height, width, 3) samples; grey is repeated.  Damaged and unsupported files raise ``UnsupportedJpeg``."""
    try:
        return _render(*coefficients(raw))
    except UnsupportedJpeg:
        raise
    except (ValueError, IndexError, KeyError, TypeError, struct.error) as e:
        raise UnsupportedJpeg("damaged file") from e


Frame = tuple[int, int, list[tuple[int, int, int, int]]]


def coefficients(raw: bytes) -> tuple[Frame, dict[int, np.ndarray], dict[int, np.ndarray]]:
    """((height, width, components), blocks of 64 coefficients by component, quantisation tables): all scans of a file, in
    which each component may come by itself and, in progressive files, in parts of its spectrum and bit by bit."""
    if raw[:2] != b"\xff\xd8":
        raise UnsupportedJpeg("not a JPEG file")
    at, quant, tables, frame, restart, progressive, scans = 2, {}, {}, None, 0, False, 0
    planes: dict[int, np.ndarray] = {}
    while True:
        if raw[at : at + 2] == b"\xff\xd9" or at + 4 > len(raw) and scans:
            break
        if at + 4 > len(raw) or raw[at] != 0xFF:
            raise UnsupportedJpeg("damaged file")
        if raw[at + 1] == 0xFF:
            at += 1
            continue
        kind, n = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        body = raw[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xDB:
            k = 0
            while k < len(body):
                wide, name = body[k] >> 4, body[k] & 15
                quant[name] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int32)
                k += 1 + 64 * (1 + wide)
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                size = sum(counts)
                tables[body[k]] = _lookup(counts, body[k + 17 : k + 17 + size])
                k += 17 + size
        elif kind in (0xC0, 0xC1, 0xC2):
            bits, h, w, parts = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise UnsupportedJpeg("only 8 bits")
            progressive = kind == 0xC2
            frame = (h, w, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)])
            hmax, vmax = (max(p[k] for p in frame[2]) for k in (1, 2))
            planes = {name: np.zeros((-(-h // (8 * vmax)) * vs, -(-w // (8 * hmax)) * hs, 64), np.int32) for name, hs, vs, _ in frame[2]}
        elif 0xC3 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise UnsupportedJpeg("only baseline and progressive files")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xDA:
            chosen = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, 16 + (body[2 + 2 * i] & 15)) for i in range(body[0])]
            first, last, bits = body[1 + 2 * body[0] :]
            segments, at = _segments(raw, at)
            grid = _grid(frame, chosen)
            if progressive:
                _progressive(segments, grid, planes, tables, restart, first, last, bits >> 4, bits & 15)
            else:
                _sequential(segments, grid, planes, tables, restart)
            scans += 1
    if not scans:
        raise UnsupportedJpeg("no picture")
    return frame, planes, quant


def _segments(raw: bytes, at: int) -> tuple[list[bytes], int]:
    """The coded bytes between restart markers, and where the next other marker is."""
    segments, start, k = [], at, at
    while k < len(raw) - 1:
        k = raw.find(b"\xff", k)
        if k < 0 or k + 1 >= len(raw):
            k = len(raw)
            break
        if raw[k + 1] == 0:
            k += 2
        elif 0xD0 <= raw[k + 1] <= 0xD7:
            segments.append(raw[start:k])
            k += 2
            start = k
        else:
            break
    segments.append(raw[start:k])
    return [s.replace(b"\xff\x00", b"\xff") + b"\0" * 8 for s in segments], k


def _grid(frame: Frame, chosen: list[tuple[int, int, int]]) -> tuple[int, int, list[tuple[int, int, int, int, int, int, int]]]:
    """Units across, units in all, and the blocks of a unit: (component, x, y, blocks across, blocks down, tables).  A scan of one
    component goes block by block over the blocks that hold samples."""
    h, w, parts = frame
    size = {name: (hs, vs) for name, hs, vs, _ in parts}
    hmax, vmax = (max(p[k] for p in parts) for k in (1, 2))
    if len(chosen) == 1:
        name, dc, ac = chosen[0]
        hs, vs = size[name]
        across, down = -(-(-(-w * hs // hmax)) // 8), -(-(-(-h * vs // vmax)) // 8)
        return across, across * down, [(name, 0, 0, 1, 1, dc, ac)]
    across, down = -(-w // (8 * hmax)), -(-h // (8 * vmax))
    return across, across * down, [(name, x, y, *size[name], dc, ac) for name, dc, ac in chosen for y in range(size[name][1]) for x in range(size[name][0])]


def _sequential(segments: list[bytes], grid, planes: dict[int, np.ndarray], tables, restart: int) -> None:
    across, total, units = grid
    mcu = 0
    for data in segments:
        bits, acc, pos = 0, 0, 0
        last = dict.fromkeys(planes, 0)
        for _ in range(min(restart or total, total - mcu)):
            row, col = divmod(mcu, across)
            for name, bx, by, hs, vs, dc, ac in units:
                block = planes[name][row * vs + by, col * hs + bx]
                k = 0
                while k < 64:
                    while bits < 32 and pos < len(data):
                        acc = (acc << 8 | data[pos]) & 0xFFFFFFFFFFFF
                        pos, bits = pos + 1, bits + 8
                    peek = acc >> (bits - 16) & 0xFFFF
                    table = tables[dc if k == 0 else ac]
                    s = table[0][peek]
                    if s < 0 or bits < 16:
                        raise UnsupportedJpeg("damaged data")
                    bits -= table[1][peek]
                    size = s & 15
                    if k:
                        if s == 0:
                            break
                        k += s >> 4
                        if size == 0:
                            k += 1
                            continue
                        if k > 63:
                            break
                    v = 0
                    if size:
                        v = acc >> (bits - size) & ((1 << size) - 1)
                        bits -= size
                        if v < 1 << (size - 1):
                            v -= (1 << size) - 1
                    if k == 0:
                        last[name] = v = last[name] + v
                    block[ZIGZAG[k]] = v
                    k += 1
            mcu += 1


class _Bits:
    """Bits of a segment, from the highest on."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def take(self, n: int) -> int:
        if self.at + n > self.end:
            raise UnsupportedJpeg("damaged data")
        byte = self.at >> 3
        word = int.from_bytes(self.data[byte : byte + 4].ljust(4, b"\0"), "big")
        out = word >> (32 - n - (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        return out

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        byte = self.at >> 3
        word = int.from_bytes(self.data[byte : byte + 3].ljust(3, b"\0"), "big") >> (8 - (self.at & 7)) & 0xFFFF
        if table[0][word] < 0 or self.at + table[1][word] > self.end:
            raise UnsupportedJpeg("damaged data")
        self.at += table[1][word]
        return table[0][word]

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v - (1 << n) + 1 if n and v < 1 << (n - 1) else v


def _progressive(segments: list[bytes], grid, planes: dict[int, np.ndarray], tables, restart: int, first: int, last: int, high: int, low: int) -> None:
    """A scan of the coefficients ``first`` to ``last``: their bits from ``low`` on, or (``high`` not 0) one more bit of each."""
    if first and len(grid[2]) > 1 or last > 63 or first > last:
        raise UnsupportedJpeg("damaged file")
    across, total, units = grid
    mcu = 0
    for data in segments:
        bits, before, empty = _Bits(data), dict.fromkeys(planes, 0), 0
        for _ in range(min(restart or total, total - mcu)):
            row, col = divmod(mcu, across)
            for name, bx, by, hs, vs, dc, ac in units:
                block = planes[name][row * vs + by, col * hs + bx]
                if not first and not high:
                    before[name] += bits.signed(bits.symbol(tables[dc]))
                    block[0] = before[name] << low
                elif not first:
                    block[0] |= bits.take(1) << low
                elif empty and not high:
                    empty -= 1
                elif not high:
                    empty = _first_bits(bits, block, tables[ac], first, last, low)
                else:
                    empty = _next_bit(bits, block, tables[ac], first, last, low, empty)
            mcu += 1


def _first_bits(bits: _Bits, block: np.ndarray, table, first: int, last: int, low: int) -> int:
    """The first bits of a block's coefficients; how many blocks after it have none."""
    k = first
    while k <= last:
        run, size = divmod(bits.symbol(table), 16)
        if size:
            k += run
            if k > last:
                raise UnsupportedJpeg("damaged data")
            block[ZIGZAG[k]] = bits.signed(size) * (1 << low)
        elif run < 15:
            return (1 << run) + bits.take(run) - 1 if run else 0
        else:
            k += 15
        k += 1
    return 0


def _next_bit(bits: _Bits, block: np.ndarray, table, first: int, last: int, low: int, empty: int) -> int:
    """One more bit of the coefficients that aren't 0, and those that become 1 or -1 at this bit; how many blocks after this one
    have none of the latter."""
    unit, k = 1 << low, first

    def refine(at: int) -> bool:
        """Reads the bit of a coefficient that isn't 0; false for one that is."""
        v = block[at]
        if v and bits.take(1):
            block[at] += unit if v > 0 else -unit
        return bool(v)

    while not empty and k <= last:
        run, size = divmod(bits.symbol(table), 16)
        if not size and run < 15:
            empty = (1 << run) + (bits.take(run) if run else 0)
            break
        value = (unit if bits.take(1) else -unit) if size else 0
        while k <= last:  # to the place behind ``run`` coefficients that are and stay 0
            at = ZIGZAG[k]
            k += 1
            if not refine(at):
                if not run:
                    block[at] = value
                    break
                run -= 1
    if empty:
        for at in ZIGZAG[k : last + 1]:
            refine(at)
        return empty - 1
    return 0


def _render(frame: Frame, planes: dict[int, np.ndarray], quant: dict[int, np.ndarray]) -> np.ndarray:
    h, w, parts = frame
    hmax, vmax = (max(p[k] for p in parts) for k in (1, 2))
    out = []
    for name, hs, vs, q in parts:
        table = np.zeros(64, np.int32)
        table[ZIGZAG] = quant[q]
        b = (planes[name] * table).reshape(*planes[name].shape[:2], 8, 8).astype(np.float64)
        px = np.einsum("ki,yxkl,lj->yxij", _DCT, b, _DCT) + 128
        px = px.transpose(0, 2, 1, 3).reshape(b.shape[0] * 8, b.shape[1] * 8)
        out.append(np.repeat(np.repeat(px, vmax // vs, 0), hmax // hs, 1)[:h, :w])
    if len(out) == 1:
        px = np.stack([out[0]] * 3, 2)
    else:
        y, cb, cr = out[0], out[1] - 128, out[2] - 128
        px = np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), 2)
    return np.clip(np.rint(px), 0, 255).astype(np.uint8)


def _quantisation(quality: int, chroma: bool) -> np.ndarray:
    """Steps that grow along the diagonals, faster for chroma; quality as usual from 1 to 100."""
    y, x = np.indices((8, 8))
    base = (17 if chroma else 12) + (9 if chroma else 6) * (y + x)
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip((base * scale + 50) // 100, 1, 255).astype(np.int32).ravel()


def _huffman(counts: Counter) -> tuple[bytes, bytes]:
    """Code lengths of at most 16 bits: (codes of each length, symbols in the order of their codes).  A symbol that never
    occurs takes the longest code, so that no code is all ones."""
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items()))] + [(0, -1, [-1])]
    heapq.heapify(heap)
    depth: Counter = Counter()
    serial = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], serial, a[2] + b[2]))
        serial += 1
    number = [0] * 64
    for s in [*counts, -1]:
        number[max(depth[s], 1)] += 1
    for n in range(63, 16, -1):  # too long codes in pairs: one moves up to its parent, one pairs with a shorter code
        while number[n] > 0:
            j = n - 2
            while number[j] == 0:
                j -= 1
            number[n] -= 2
            number[n - 1] += 1
            number[j + 1] += 2
            number[j] -= 1
    longest = max(n for n in range(64) if number[n])
    number[longest] -= 1
    order = sorted(counts, key=lambda s: (depth[s], s))
    return bytes(number[1:17]), bytes(order)


def encode_jpeg(px: np.ndarray, quality: int = 92, subsample: bool = False) -> bytes:
    """8-bit colour or grey; ``subsample`` halves chroma in both directions."""
    h, w, s = px.shape
    f = px.astype(np.float64)
    if s == 1:
        planes = [(f[..., 0], 1, False)]
    else:
        r, g, b = f[..., 0], f[..., 1], f[..., 2]
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [(y, 2 if subsample else 1, False), ((b - y) / 1.772 + 128, 1, True), ((r - y) / 1.402 + 128, 1, True)]
    top = max(k for _, k, _ in planes)
    across, down = -(-w // (8 * top)), -(-h // (8 * top))
    blocks = []
    for plane, k, chroma in planes:
        full = np.pad(plane, ((0, down * 8 * top - h), (0, across * 8 * top - w)), mode="edge")
        if k < top:
            full = full.reshape(full.shape[0] // 2, 2, full.shape[1] // 2, 2).mean((1, 3))
        b = (full - 128).reshape(down * k, 8, across * k, 8).transpose(0, 2, 1, 3)
        c = np.einsum("ki,yxij,lj->yxkl", _DCT, b, _DCT).reshape(down * k, across * k, 64)
        blocks.append(np.rint(c / _quantisation(quality, chroma)).astype(int)[..., ZIGZAG])
    streams: list[tuple[int, int, int, int]] = []  # (table, symbol, extra bits, their number)

    def number(v: int) -> tuple[int, int]:
        n = abs(v).bit_length()
        return n, (v if v > 0 else v + (1 << n) - 1) if n else 0

    last = [0] * len(planes)
    for row in range(down):
        for col in range(across):
            for i, (_, k, chroma) in enumerate(planes):
                for by in range(k):
                    for bx in range(k):
                        z = blocks[i][row * k + by, col * k + bx].tolist()
                        n, extra = number(z[0] - last[i])
                        last[i] = z[0]
                        streams.append((chroma, n, extra, n))
                        run = 0
                        end = max((j for j in range(1, 64) if z[j]), default=0)
                        for j in range(1, end + 1):
                            if z[j] == 0:
                                run += 1
                                continue
                            while run > 15:
                                streams.append((16 + chroma, 0xF0, 0, 0))
                                run -= 16
                            n, extra = number(z[j])
                            streams.append((16 + chroma, run << 4 | n, extra, n))
                            run = 0
                        if end < 63:
                            streams.append((16 + chroma, 0, 0, 0))
    made, codes = {}, {}
    for t in sorted({x[0] for x in streams}):
        made[t] = _huffman(Counter(x[1] for x in streams if x[0] == t))
        codes[t] = {s: (n, c) for (n, c), s in _codes(*made[t]).items()}
    acc, bits, data = 0, 0, bytearray()
    for t, symbol, extra, n in streams:
        size, code = codes[t][symbol]
        acc, bits = (acc << (size + n)) | (code << n) | extra, bits + size + n
        while bits >= 8:
            byte = acc >> (bits - 8) & 255
            data.append(byte)
            if byte == 255:
                data.append(0)
            bits -= 8
            acc &= (1 << bits) - 1
    if bits:
        byte = (acc << (8 - bits) | (1 << (8 - bits)) - 1) & 255
        data.append(byte)
        if byte == 255:
            data.append(0)

    def marker(kind: int, body: bytes) -> bytes:
        return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body

    out = b"\xff\xd8" + marker(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for chroma in sorted({c for _, _, c in planes}):
        out += marker(0xDB, bytes([chroma]) + _quantisation(quality, chroma)[ZIGZAG].astype(np.uint8).tobytes())
    out += marker(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([i + 1, k << 4 | k, c]) for i, (_, k, c) in enumerate(planes)))
    for t, (counts, symbols) in made.items():
        out += marker(0xC4, bytes([t]) + counts + symbols)
    out += marker(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, c << 4 | c]) for i, (_, _, c) in enumerate(planes)) + b"\0\x3f\0")
    return out + bytes(data) + b"\xff\xd9"
