"""Media columns: audio containers and audio features.

A media column holds a WAV container (8-bit mono samples).  Features are computed from the samples read back from it:
polyphase resampling, overlapped log-mel filterbanks and a segmentation of the frame energies with hysteresis.  Features
are stored as an Arrow stream with one record batch: fixed-shape tensors of ``FRAMES`` x ``MELS`` with their time spans.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, slices, texts

RATE, UP, DOWN = 16_000, 5, 8
WINDOW, HOP, FFT, MELS = 250, 100, 256, 40
#: Frames of a tensor; the last of a recording is padded with the floor.
FRAMES = 64
#: Log energies at which a segment begins and ends (hysteresis), and its least number of frames.
ON, OFF, LEAST = -1.5, -2.5, 3
FLOOR = 1e-6
#: Samples or frames worked on at a time.
BLOCK = 1 << 18


def encode_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM; the payload's bytes are the samples."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n + n % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + payload + b"\0" * (n % 2)


def decode_wav(raw: bytes) -> tuple[bytes, int]:
    """The samples and the rate of an 8-bit mono container; other chunks are passed over."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV container")
    at, rate = 12, 0
    while at + 8 <= len(raw):
        kind, n = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", raw, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM")
        elif kind == b"data":
            if rate * UP < DOWN:
                raise ValueError("no format or rate before the samples")
            return raw[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("no samples")


def read_wav(raw: bytes | None) -> tuple[bytes, int] | None:
    """As ``decode_wav``; None for null media and what is no such container."""
    try:
        return None if raw is None else decode_wav(raw)
    except (ValueError, struct.error):
        return None


@lru_cache(maxsize=8)
def polyphase_filter(up: int, down: int, half: int = 8) -> np.ndarray:
    """A Hamming-windowed sinc in ``up`` phases."""
    cut = max(up, down)
    k = np.arange(-half * cut, half * cut + 1)
    h = np.sinc(k / cut) * np.hamming(len(k)) * up / cut
    taps = -(-len(h) // up)
    h = np.concatenate((h, np.zeros(taps * up - len(h))))
    return h.reshape(taps, up).T[:, ::-1].astype(np.float32).copy()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling: output i is the filter's phase (i * down) mod up over the samples around i * down / up."""
    h = polyphase_filter(up, down)
    taps = h.shape[1]
    lead = (8 * max(up, down)) // up  # samples the filter's centre lies after its start
    rest = (8 * max(up, down)) % up
    n = -(-len(x) * up // down)
    pad = np.concatenate((np.zeros(taps, np.float32), x, np.zeros(taps + lead + down, np.float32)))
    out = np.empty(n, np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(pad, taps)
    for first in range(up):
        t = np.arange(first, n, up, dtype=np.int64) * down + rest
        phase = int(t[0] % up) if len(t) else 0
        at = t // up + lead + 1
        for lo in range(0, len(at), BLOCK):
            step = windows[at[lo] : at[min(lo + BLOCK, len(at)) - 1] + 1 : down]
            out[first + lo * up : first + (lo + len(step)) * up : up] = step @ h[phase]
    return out


@lru_cache(maxsize=8)
def mel_filters(rate: int, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangles that are even on the mel scale, fft bins x mels."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1) * rate / fft
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f[:, None] - low) / (mid - low), (high - f[:, None]) / (high - mid))).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> np.ndarray:
    """Log-mel energies of overlapped Hann windows, one frame at least.  The last is filled up with zeros, so that each
    sample is in a frame."""
    n = max(0, -(-(len(x) - WINDOW) // HOP)) * HOP + WINDOW
    x = np.concatenate((x, np.zeros(n - len(x), np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    window, mel = np.hanning(WINDOW).astype(np.float32), mel_filters(rate)
    out = np.empty((len(frames), MELS), np.float32)
    for lo in range(0, len(frames), 4096):
        s = np.fft.rfft(frames[lo : lo + 4096] * window, FFT)
        out[lo : lo + 4096] = np.log10((s.real**2 + s.imag**2).astype(np.float32) @ mel + FLOOR)
    return out


def segments(level: np.ndarray, on: float = ON, off: float = OFF, least: int = LEAST) -> list[tuple[int, int]]:
    """Frame ranges that begin at ``on`` or more and last until the level falls under ``off``."""
    mark = np.where(level >= on, 1, np.where(level < off, 0, -1))
    known = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    active = np.concatenate(([0], np.where(known >= 0, mark[known], 0), [0]))
    edge = np.flatnonzero(np.diff(active))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= least]


def to_arrow(mel: np.ndarray, hop_s: float) -> bytes:
    """An Arrow stream: tensors of FRAMES x MELS as 16-bit hundredths with start and end in seconds."""
    n = -(-len(mel) // FRAMES)
    q = np.full((n * FRAMES, MELS), round(100 * np.log10(FLOOR)), np.int16)
    q[: len(mel)] = np.rint(100 * mel)
    kind = pa.fixed_shape_tensor(pa.int16(), (FRAMES, MELS))
    data = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(q.ravel()), FRAMES * MELS))
    start = np.arange(n) * FRAMES * hop_s
    end = np.minimum(np.arange(1, n + 1) * FRAMES, len(mel)) * hop_s
    batch = pa.RecordBatch.from_arrays([pa.array(start), pa.array(end), data], names=["start_s", "end_s", "tensor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_arrow(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(tensors n x FRAMES x MELS, spans n x 2) of a stored stream."""
    t = pa.ipc.open_stream(raw).read_all()
    spans = np.stack((t["start_s"].to_numpy(), t["end_s"].to_numpy()), 1)
    return t["tensor"].combine_chunks().to_numpy_ndarray(), spans


def features(samples: bytes, rate: int) -> tuple[bytes, list[tuple[float, float]]]:
    """The stored tensors and the segments in seconds."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    out_rate = rate * UP // DOWN
    mel = log_mel(resample(x), out_rate)
    hop = HOP / out_rate
    return to_arrow(mel, hop), [(a * hop, b * hop) for a, b in segments(mel.mean(1))]


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a WAV
    container.  Null texts count as empty.  Rows are kept one by one; an empty table gives an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4_000_000):
                raw = [t.encode("utf-8", "surrogatepass") for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(x) for x in raw], pa.int64()), pa.array([encode_wav(x + b"\0" * (-len(x) % 64 or 64 * (not x))) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return texts(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def audio_features(media: DataFrame) -> DataFrame:
    """Adds to (doc_id, n_bytes, media): ``payload`` (the samples read back), ``tensors`` (an Arrow stream, see
    ``from_arrow``) and ``spans`` (start-end in milliseconds of each segment, joined by commas).

    All three are null for null media and for media that are no 8-bit mono WAV container; other rows aren't touched by
    them.  An empty table gives an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4_000_000):
                read = [read_wav(x) for x in part["media"].to_pylist()]
                got = [x and features(*x) for x in read]
                spans = [x and ",".join(f"{round(1000 * a)}-{round(1000 * b)}" for a, b in x[1]) for x in got]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x and x[0] for x in read], pa.binary()), pa.array([x and x[0] for x in got], pa.binary()), pa.array(spans, pa.string())], names=["doc_id", "n_bytes", "media", "payload", "tensors", "spans"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(lean(run), "doc_id long, n_bytes long, media binary, payload binary, tensors binary, spans string")
