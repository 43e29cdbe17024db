"""Encoding with tokenizer files; the files' bytes are broadcast, so executors need no path."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from .common import HELD, mix64, powers

#: Characters for which all Unicode versions and regex engines agree on classes, case and normal forms.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]")
#: Classes of the plain characters by Latin-1 code: white space, letter, number, other; 4 is the end of a text.
_SPACE, _LETTER, _NUMBER, _OTHER, _END = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[[c for c in range(256) if chr(c).isalpha()]] = _LETTER
_CLASS[[*range(48, 58), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMBER
_CLASS[0] = _END
_BASE = 0xD1342543DE82EF95
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
#: Characters of a text worked on together.
CHUNK = 1 << 19
#: Characters of short texts worked on together, and new pre-tokens given to the library together: its encodings take some
#: hundred bytes a token.
TOGETHER, NEW = 1 << 18, 4096
#: A single white-space character between two letters or digits: every match of a split pattern of this family begins
#: anew there, and no look-ahead reaches over it.
_SAFE = re.compile(r"(?<=[0-9A-Za-z])[ \n](?=[0-9A-Za-z])")
_READY: dict[tuple, object] = {}
HELD["tokenizers"] = _READY.clear


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """``text`` in pieces that encode to the same ids as the whole; without a boundary it stays in one piece."""
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def together(texts: list[str], size: int) -> Iterator[slice]:
    """``texts`` in runs of at most ``size`` characters, an end mark for each included (one text at least)."""
    lo = n = 0
    for i, t in enumerate(texts):
        if i > lo and n + len(t) + 1 > size:
            yield slice(lo, i)
            lo, n = i, 0
        n += len(t) + 1
    if lo < len(texts):
        yield slice(lo, len(texts))


def ready(raw: bytes, make: Callable[[bytes], object], kind: str) -> object:
    """One tokenizer a process, file and kind."""
    k = (hash(raw), len(raw), kind)
    if k not in _READY:
        _READY[k] = make(raw)
    return _READY[k]


#: The split patterns that the fast path knows.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def split_points(b: np.ndarray, words_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of plain texts that are joined by zero bytes (which end the last one too).

    A pre-token begins where the class changes.  By ``BYTE_LEVEL`` the last space before other characters belongs to
    them and the rest of its run stands alone; by ``WORD_LEVEL`` (``words_only``) white space is dropped and digits stand
    alone.  In both an apostrophe that begins a pre-token takes the letters of a contraction with it.
    """
    cls = _CLASS[b]
    start = np.empty(len(b), bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    start |= cls == _END
    if words_only:
        start |= cls == _NUMBER
    else:
        after = np.flatnonzero((cls[1:] != _SPACE) & (cls[:-1] == _SPACE) & (cls[1:] != _END)) + 1
        start[after - 1] = True
        start[after[b[after - 1] == 32]] = False
    quote = np.flatnonzero((b == 39) & start)
    if len(quote):
        quote = quote[quote + 2 < len(b)]  # with two left the second is the zero byte, which no long contraction has
        one, two = b[quote + 1], b[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, n in ((quote[short], 2), (quote[long], 3)):
            start[hit + 1] = False
            start[hit + n] = True
    at = np.flatnonzero(start)
    end = np.append(at[1:], len(b))
    keep = cls[at] != _END
    if words_only:
        keep &= cls[at] != _SPACE
    return at[keep], end[keep]


class WordTable:
    """Pre-token -> its ids, as an open-addressing table of arrays by a 64-bit hash: whole batches are looked up at once,
    and what is found is compared with the pre-token byte by byte.  The table grows with its entries, at most half full."""

    def __init__(self, bound: int = 500_000, dtype: np.dtype = np.uint16):
        self.bound = bound
        self.slots = 1 << 12
        self.hashes, self.counts, self.pool = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, dtype)
        self.sizes, self.text = np.empty(0, np.int64), np.empty(0, np.uint8)
        self._index()

    def _index(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.entry = np.full(self.slots, -1, np.int32)
        self.offsets = np.concatenate(([0], np.cumsum(self.counts)))
        self.places = np.concatenate(([0], np.cumsum(self.sizes)))
        self._place(self.hashes, np.arange(len(self.hashes), dtype=np.int32))

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        at = (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(h):
            free = self.entry[at] < 0
            spot, first = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[spot], self.entry[spot] = h[chosen], entry[chosen]
            left = np.ones(len(h), bool)
            left[chosen] = False
            h, entry, at = h[left], entry[left], (at[left] + 1) & (self.slots - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        at = (h & np.uint64(self.slots - 1)).astype(np.int64)
        out = self.entry[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        while len(todo):
            at[todo] = (at[todo] + 1) & (self.slots - 1)
            out[todo] = self.entry[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[at[todo]] != h[todo])]
        return out

    def learn(self, h: np.ndarray, words: list[bytes], ids: list[list[int]]) -> None:
        """Adds distinct new hashes.  Beyond the bound the later half is forgotten first: words met early are frequent."""
        if len(self.hashes) + len(h) > self.bound:
            k = min(self.bound // 2, len(self.hashes))
            self.pool, self.text = self.pool[: self.offsets[k]], self.text[: self.places[k]]
            self.hashes, self.counts, self.sizes = self.hashes[:k], self.counts[:k], self.sizes[:k]
            self._index()
        first = len(self.hashes)
        grown = 2 * (first + len(h)) > self.slots
        counts, sizes = (np.array([len(x) for x in group], np.int64) for group in (ids, words))
        self.pool = np.concatenate((self.pool, np.array(list(chain.from_iterable(ids)), self.pool.dtype)))
        self.text = np.concatenate((self.text, np.frombuffer(b"".join(words), np.uint8)))
        self.hashes, self.counts, self.sizes = np.concatenate((self.hashes, h)), np.concatenate((self.counts, counts)), np.concatenate((self.sizes, sizes))
        if grown:
            self.slots = 1 << (2 * len(self.hashes)).bit_length()
            self._index()
            return
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(counts)))
        self.places = np.concatenate((self.places, self.places[-1] + np.cumsum(sizes)))
        self._place(h, np.arange(first, first + len(h), dtype=np.int32))

    def alike(self, entries: np.ndarray, b: np.ndarray, at: np.ndarray, end: np.ndarray) -> bool:
        """Whether each entry holds the bytes ``b[at:end]`` of its pre-token."""
        sizes = end - at
        if not np.array_equal(self.sizes[entries], sizes):
            return False
        whole = sizes.sum()
        steps = np.arange(whole) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.array_equal(b[np.repeat(at, sizes) + steps], self.text[np.repeat(self.places[entries], sizes) + steps])

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all entries in order, running count of ids before each entry and in all)."""
        n = self.counts[entries]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(self.offsets[entries] - ends[:-1], n) + np.arange(ends[-1])
        return self.pool[at], ends


class Encoder:
    """ids of texts as ``tokenizer.encode`` gives them, in 16 bits, or in 32 for files of more than 65,536 ids.

    The merges of a pre-token don't depend on what stands around it.  Texts of plain characters are split by arrays and
    their pre-tokens looked up; new ones, texts with a pre-token whose hash another one has, and all other texts as a
    whole go to the tokenizers library.
    ``special``: the file's special tokens are found in texts, as is the library's default; else they are plain text.
    """

    def __init__(self, raw: bytes, special: bool = False):
        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.encode_special_tokens = not special
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        conf = json.loads(raw)
        before, kinds = conf["pre_tokenizer"] or {}, [x["type"] for x in (conf["normalizer"] or {}).get("normalizers", [])]
        # texts that may hold a token of the file's own list aren't split by arrays: as it stands, or before normalisation
        # in any case and spacing
        added = [x for x in conf.get("added_tokens") or () if special or not x["special"]]
        self.exact = [x["content"] for x in added if not x["normalized"]]
        loose = [r"\s+".join(map(re.escape, re.split(r"\s+", x["content"]))) for x in added if x["normalized"]]
        self.loose = re.compile("|".join(loose), re.I) if loose else None
        self.words = None
        if before.get("type") == "ByteLevel" and not conf["normalizer"] and before["use_regex"] and not before["add_prefix_space"]:
            self.words, self.words_only = WordTable(dtype=self.dtype), False
        elif before.get("type") == "Sequence" and kinds == ["NFC", "Replace", "Lowercase"]:
            first, *rest = before["pretokenizers"]
            if first["type"] == "Split" and first["pattern"].get("Regex") == WORD_LEVEL and first["behavior"] == "Removed" and first["invert"] and [(x["type"], x["use_regex"], x["add_prefix_space"]) for x in rest] == [("ByteLevel", False, False)]:
                self.words, self.words_only = WordTable(dtype=self.dtype), True
        if self.words:  # for single pre-tokens: they need no splitting; both tokenizers share one model
            self.single = Tokenizer(self.tokenizer.model)
            self.single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.words and not _PLAIN.search(t) and not self._listed(t)]
        for i in plain:
            if len(texts[i]) > CHUNK:  # a long text in pieces
                out[i] = np.concatenate([self._plain([x])[0] for x in chunks(texts[i])])
        plain = [i for i in plain if out[i] is None]
        some = [texts[i] for i in plain]
        for run in together(some, TOGETHER):
            for i, x in zip(plain[run], self._plain(some[run]), strict=True):
                out[i] = x
        whole = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(whole, self._library([texts[i] for i in whole]), strict=True):
            out[i] = x
        return out

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for run in together(texts, TOGETHER) for x in self.tokenizer.encode_batch_fast(texts[run], add_special_tokens=False)]

    def _listed(self, text: str) -> bool:
        return any(x in text for x in self.exact) or self.loose is not None and self.loose.search(text) is not None

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        raw = b"".join((t.lower() if self.words_only else t).encode("latin-1") + b"\0" for t in texts)
        b = np.frombuffer(raw, np.uint8)
        at, end = split_points(b, self.words_only)
        power, inverse = powers(len(b), _BASE)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTES[b] * power[: len(b)], out=sums[1:])
        h = mix64((sums[end] - sums[at]) * inverse[at] + (end - at).astype(np.uint64))
        # so few at a time that what is looked up together fits in the table
        step = max(1, self.words.bound // 4)
        parts = []
        for k in range(0, len(h), step):
            if (found := self._ids(h[k : k + step], at[k : k + step], end[k : k + step], raw, b)) is None:
                return self._library(texts)
            parts.append(found)
        ids = np.concatenate([x for x, _ in parts]) if parts else np.empty(0, self.dtype)
        counts = np.concatenate([np.diff(e) for _, e in parts]) if parts else np.empty(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(counts)))
        cuts = ends[np.searchsorted(at, np.flatnonzero(b == 0))]
        return [ids[a:z] for a, z in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]

    def _ids(self, h: np.ndarray, at: np.ndarray, end: np.ndarray, raw: bytes, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of pre-tokens and their running count; unknown ones are learned.  None where hashes collide."""
        entries = self.words.find(h)
        while (entries < 0).any():
            missing = np.flatnonzero(entries < 0)
            new, first = np.unique(h[missing], return_index=True)
            order = np.argsort(first)  # in the order of the texts: what comes early is kept longest
            new, first = new[order], missing[first[order]]
            words = [raw[a:z] for a, z in zip(at[first].tolist(), end[first].tolist(), strict=True)]
            ids = [x.ids for k in range(0, len(words), NEW) for x in self.single.encode_batch_fast([w.decode("latin-1") for w in words[k : k + NEW]], add_special_tokens=False)]
            self.words.learn(new, words, ids)
            entries = self.words.find(h)
        return self.words.ids(entries) if self.words.alike(entries, b, at, end) else None


def encoder(raw: bytes, special: bool = False) -> Encoder:
    return ready(raw, lambda x: Encoder(x, special), f"tokenizers {special}")
