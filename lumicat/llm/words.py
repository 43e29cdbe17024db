"""Terms of whole texts: runs of characters that are no separators, with A-Z in lower case."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are split at a time.
PIECE = 1 << 20


class Terms:
    """Splits UTF-8 texts at given ASCII characters.  Bytes from 0x80 on always belong to terms, so characters stay whole."""

    def __init__(self, kept: bytes):
        """``kept``: the ASCII characters of terms in lower case."""
        keep = set(kept)
        self.table = bytes(b if b >= 0x80 or b in keep else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

    def of(self, text: str, piece: int = PIECE) -> Iterator[list[bytes]]:
        """The terms in order, in lists of pieces cut at separators: a very long text never becomes one list."""
        raw = text.encode("utf-8", "surrogatepass").translate(self.table)
        at = 0
        while len(raw) - at > piece:
            end = raw.find(b" ", at + piece)
            if end < 0:
                break
            yield raw[at:end].split()
            at = end
        yield raw[at:].split()


LETTERS = b"abcdefghijklmnopqrstuvwxyz"
DIGITS = b"0123456789"
