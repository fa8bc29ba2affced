"""Media columns: lossless 8-bit audio, polyphase resampling, log-mel filterbanks, hysteresis segments, tensors."""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirlog.llm.base import bounded

#: Samples a second as stored and as analysed (ratio UP / DOWN), samples of a window, of its transform and between windows.
RATE, UP, DOWN, WINDOW, FFT, HOP = 8000, 3, 4, 150, 256, 60
#: Mel bands, frames of a tensor, dB above and below the median energy at which a segment opens and closes.
MELS, FRAMES, OPEN_DB, CLOSE_DB = 24, 32, 0.5, -0.5
#: Bytes to a multiple of which a payload is filled, and windows analysed at once.
UNIT, BLOCK = 576, 8192


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, those bytes filled with 255 to a positive multiple of UNIT)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def to_wav(samples: bytes) -> bytes:
    """A mono 8-bit PCM file."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data)) as f:
        if (f.getnchannels(), f.getsampwidth(), f.getframerate()) != (1, 1, RATE):
            raise ValueError("not a mono 8-bit file at the expected rate")
        return f.readframes(f.getnframes())


@lru_cache(1)
def taps(width: int = 8) -> np.ndarray:
    """Phases of a windowed-sinc low pass for UP / DOWN: row p holds the taps of outputs of phase p."""
    half = width * max(UP, DOWN)
    n = np.arange(-half, half + 1)
    h = np.sinc(n / max(UP, DOWN)) * np.hanning(len(n) + 2)[1:-1]
    h = np.concatenate((h * UP / h.sum(), np.zeros(-len(h) % UP)))
    return h.reshape(-1, UP).T[:, ::-1].astype(np.float32)


def resampled(x: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Outputs start to stop (start a multiple of UP) of the signal x, taken as 0 outside; group delay removed."""
    h = taps()
    length, delay = h.shape[1], (8 * max(UP, DOWN))
    out = np.zeros(stop - start, np.float32)
    for first in range(start, min(start + UP, stop)):
        at = first * DOWN + delay
        phase, newest = at % UP, at // UP
        count = len(range(first, stop, UP))
        a, b = newest - length + 1, newest + (count - 1) * DOWN + 1
        part = np.zeros(b - a, np.float32)
        lo, hi = max(a, 0), min(b, len(x))
        if lo < hi:
            part[lo - a : hi - a] = (x[lo:hi].astype(np.float32) - 128) / 128
        out[first - start :: UP] = np.lib.stride_tricks.sliding_window_view(part, length)[::DOWN] @ h[phase]
    return out


@lru_cache(1)
def filterbank() -> tuple[np.ndarray, np.ndarray]:
    """(window, triangular mel filters over the bins of the transform)."""
    rate = RATE * UP / DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1) / rate * FFT
    bins = np.arange(FFT // 2 + 1)[:, None]
    rise = (bins - edges[:-2]) / np.diff(edges)[:-1]
    fall = (edges[2:] - bins) / np.diff(edges)[1:]
    return np.hanning(WINDOW).astype(np.float32), np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log energies, dB energy of each frame) over overlapping windows of 8-bit samples."""
    window, filters = filterbank()
    # The last window may reach past the signal's end, where there is silence.
    total = max(1, -(-(-(-len(x) * UP // DOWN) - WINDOW) // HOP) + 1)
    mels, energy = np.empty((total, MELS), np.float16), np.empty(total, np.float32)
    for first in range(0, total, BLOCK):
        n = min(BLOCK, total - first)
        y = resampled(x, first * HOP, (first + n - 1) * HOP + WINDOW)
        frames = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP][:n]
        energy[first : first + n] = 10 * np.log10(np.einsum("ij,ij->i", frames, frames) / WINDOW + 1e-9)
        power = np.abs(np.fft.rfft(frames * window, FFT)) ** 2
        mels[first : first + n] = np.log10(power.astype(np.float32) @ filters + 1e-6)
    return mels, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames at or above the closing level that reach the opening level (levels relative to the median)."""
    level = float(np.median(energy))
    on = np.concatenate(([False], energy >= level + CLOSE_DB, [False]))
    change = np.flatnonzero(on[1:] != on[:-1])
    peaks = np.concatenate(([0], np.cumsum(energy >= level + OPEN_DB)))
    return [(int(a), int(b)) for a, b in zip(change[::2], change[1::2]) if peaks[b] > peaks[a]]


TENSOR = pa.fixed_shape_tensor(pa.float16(), (FRAMES, MELS))


def tensors(mels: np.ndarray, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """(an Arrow stream of fixed-shape tensors with their time spans in ms, tensors in it)."""
    cuts = [(i, min(i + FRAMES, b)) for a, b in spans for i in range(a, b, FRAMES)]
    data = np.zeros((len(cuts), FRAMES, MELS), np.float16)
    for k, (a, b) in enumerate(cuts):
        data[k, : b - a] = mels[a:b]
    rate = RATE * UP // DOWN
    storage = pa.FixedSizeListArray.from_arrays(pa.array(data.reshape(-1)), FRAMES * MELS)
    columns = {"tensor": pa.ExtensionArray.from_storage(TENSOR, storage), "start_ms": pa.array([a * HOP * 1000 // rate for a, _ in cuts], pa.int64()), "end_ms": pa.array([((b - 1) * HOP + WINDOW) * 1000 // rate for _, b in cuts], pa.int64())}
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes(), len(cuts)


def read_tensors(data: bytes) -> pa.Table:
    """The tensors of one row with their spans."""
    return pa.ipc.open_stream(data).read_all()


def as_media(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each whole text as an audio file, from which its bytes can be read back.

    A null text counts as empty and gives UNIT bytes of filling. Repeated rows come back repeated.
    """

    def make(batches):
        for batch in batches:
            made = [payload(t) for t in batch.column(1).to_pylist()]
            for i in range(0, len(made), 1000):
                part = made[i : i + 1000]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), pa.array([n for n, _ in part], pa.int64()), pa.array([to_wav(p) for _, p in part], pa.binary())], ["id", "n_bytes", "media"])

    kind = docs.select(id).schema[0].dataType.simpleString()
    return bounded(docs).select(id, text).mapInArrow(make, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id)


SCHEMA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, n_segments long, active_frames long, n_tensors long, tensors binary"


def describe(media: bytes) -> tuple:
    """Checks of the stored bytes and the features of the samples read back from them, in the order of SCHEMA."""
    samples = from_wav(media)
    mels, energy = log_mel(np.frombuffer(samples, np.uint8))
    spans = segments(energy)
    data, n = tensors(mels, spans)
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), len(energy), len(spans), sum(b - a for a, b in spans), n, data


def audio_features(media: DataFrame, column: str = "media") -> DataFrame:
    """Every column of ``media`` but the stored bytes, then SCHEMA. Null media gives nulls.

    Each row is analysed alone with the same array shapes, so equal bytes give equal features.
    """
    keep = [c for c in media.columns if c != column]
    fields = SCHEMA.split(", ")

    def make(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows = [describe(m) if m is not None else (None,) * len(fields) for m in part.column(column).to_pylist()]
                types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
                made = [pa.array([r[k] for r in rows], types[f.split()[1]]) for k, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, keep + [f.split()[0] for f in fields])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != column)
    return media.mapInArrow(make, f"{schema}, {SCHEMA}")


def digest(features: DataFrame) -> DataFrame:
    """The features as one string: counts, then a digest of the tensors with their spans."""
    text = F.concat_ws(":", "n_frames", "n_segments", "active_frames", "n_tensors", F.sha2("tensors", 256))
    return features.withColumn("feature", text).drop("n_frames", "n_segments", "active_frames", "n_tensors", "tensors")
