"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, texts
from .tokens import BYTE_LEVEL, chunks, ready

#: Texts of more characters are cut at safe boundaries into chunks of about this size.
CHUNK = 50_000
#: Longer runs of white space are matched here: the library's matcher keeps a state a character and gives up at a million.
RUN = 20_000
#: White space as the library's matcher has it.
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RUNS = re.compile(f"{_BLANK}{{{RUN},}}")


def encoding(raw: bytes, pattern: str) -> tiktoken.Encoding:
    def make(data: bytes) -> tiktoken.Encoding:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return ready(raw, make, pattern)


def parts(text: str, pattern: str) -> Iterator[tuple[str, bool]]:
    """``text`` in parts that encode to the same ids as the whole, each with whether it is one match of ``pattern``.

    By ``tokens.BYTE_LEVEL`` a match begins where a run of white space begins, and takes all of it but the last character
    (all of it at the text's end): long runs are cut out so.  A text with such a run is matched by the ``regex`` library
    if the pattern is another.
    """
    runs = list(_RUNS.finditer(text)) if len(text) >= RUN else []
    if runs and pattern != BYTE_LEVEL:
        yield from ((m[0], True) for m in regex.finditer(pattern, text) if m[0])
        return
    at = 0
    for m in runs:
        end = m.end() - (m.end() < len(text))
        if m.start() > at:
            yield from ((x, False) for x in chunks(text[at : m.start()], CHUNK))
        yield text[m.start() : end], True
        at = end
    if at < len(text):
        yield from ((x, False) for x in chunks(text[at:], CHUNK))


def encode(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of ``text``; lone surrogates count as the replacement character."""
    text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if not text.isascii() else text
    if len(text) < RUN:
        return np.array(enc.encode_ordinary(text), "<u4")
    ids = [enc._encode_single_piece(x) if whole else enc.encode_ordinary(x) for x, whole in parts(text, enc._pat_str)]
    return np.concatenate([np.array(x, "<u4") for x in ids])


def bpe_encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian 32-bit integers.  Null texts count as empty (no ids); rows that
    repeat are encoded each; an empty table gives an empty table."""
    raw = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(raw.value, pattern)
        for batch in batches:
            for part in slices(batch, 4_000_000):
                ids = [encode(enc, t) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(lean(run, "tokenizers"), "doc_id long, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Adds ``decoded``: the raw bytes of the ids, whether or not they are valid UTF-8."""
    raw = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(raw.value, pattern)
        for batch in batches:
            for part in slices(batch, 4_000_000):
                out = [enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in part["ids"].to_pylist()]
                yield part.append_column("decoded", pa.array(out, pa.binary()))

    return encoded.select("doc_id", "n_tokens", F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(lean(run, "tokenizers"), "doc_id long, n_tokens long, ids binary, decoded binary")
