"""Media columns: texts as stored audio, and features of what is read back (operator 9).

A payload is kept losslessly as 8-bit mono samples in a WAV container, in a binary column of a Parquet
table in the shared folder. Features come from the stored samples: a polyphase FIR resampler changes the
rate by UP / DOWN, overlapped windows give log-mel bands, and hysteresis on the frame energy cuts segments. Each segment
has its time span and a tensor of fixed shape (SLICES, MELS). The segments of every row are stored beside the
media as an Arrow stream whose schema has the fixed-shape tensor type, and what is read back gives the feature text.

Defined results: null text is the empty payload before padding. Everything is computed text by text with
the same shapes, so equal texts have equal values. Repeated and null doc_ids give a row each. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keep, prepare, work_folder

RATE, UP, DOWN, TAPS = 16_000, 2, 3, 32
FRAME, HOP, MELS, SLICES = 256, 128, 32, 4
PAD, UNIT = 255, 576
#: Outputs of the resampler computed at a time.
ROWS = 1 << 16
#: Decibels over and under the median frame energy at which a segment opens and closes.
OPEN, CLOSE = 1.0, -1.0
SEGMENTS = f"array<struct<start_ms:double,end_ms:double,tensor:array<float>>>"


def padded(raw: bytes, unit: int = UNIT, pad: int = PAD) -> bytes:
    return raw + bytes([pad]) * (max(1, -(-len(raw) // unit)) * unit - len(raw))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes()), w.getframerate()


@lru_cache(4)
def phases(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed-sinc low-pass, split into its up phases."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hamming(n)
    h *= up / h.sum()
    return h.reshape(taps, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase resampling by up / down: each output takes the one phase of the filter that it needs."""
    h = phases(up, down, taps)
    total = -(-len(x) * up // down)
    edge = np.concatenate([np.zeros(taps - 1, np.float32), x.astype(np.float32), np.zeros(taps, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(edge, taps)
    out = np.zeros(total, np.float32)
    for first in range(min(up, total)):  # outputs of one phase: first, first + up, ...; their windows are down apart
        some, phase = windows[first * down // up :: down], np.ascontiguousarray(h[first * down % up][::-1])
        count = len(range(first, total, up))
        for k in range(0, count, ROWS):
            out[first + k * up : first + min(count, k + ROWS) * up : up] = some[k : min(count, k + ROWS)] @ phase
    return out


@lru_cache(2)
def mel_filters(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2)
    hz = 700 * (10 ** (mel / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)
    up = (f[:, None] - hz[None, :-2]) / (hz[1:-1] - hz[:-2])
    down = (hz[None, 2:] - f[:, None]) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel bands and energy in decibels of each overlapped frame."""
    if len(x) < FRAME:
        x = np.concatenate([x, np.zeros(FRAME - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2
    energy = 10 * np.log10((frames * frames).mean(1) + 1e-9)
    return np.log(power @ mel_filters(rate) + 1e-6), energy


def hysteresis(energy: np.ndarray, high: float = OPEN, low: float = CLOSE) -> list[tuple[int, int]]:
    """Runs of frames that rise over median + high and last until they fall under median + low."""
    middle = float(np.median(energy))
    sure = np.where(energy >= middle + high, 1, np.where(energy < middle + low, 0, -1))
    last = np.maximum.accumulate(np.where(sure >= 0, np.arange(len(sure)), -1))
    on = np.where(last >= 0, sure[np.maximum(last, 0)], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def analyse(payload: bytes, rate: int = RATE):
    """Segments (start_ms, end_ms, tensor of shape (SLICES, MELS)) and a short description of all frames."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    y, new_rate = resample(x), rate * UP / DOWN
    bands, energy = log_mel(y, new_rate)
    out = []
    for a, z in hysteresis(energy):
        at = a + (np.arange(SLICES + 1) * (z - a)) // SLICES
        tensor = np.stack([bands[s : max(e, s + 1)].mean(0) for s, e in zip(at[:-1], at[1:], strict=True)])
        out.append((1000 * a * HOP / new_rate, 1000 * ((z - 1) * HOP + FRAME) / new_rate, tensor.astype(np.float32)))
    coarse = bands.mean(0).reshape(4, -1).mean(1)
    return out, f"frames={len(bands)};energy={energy.mean():.2f};mel={'/'.join(f'{v:.2f}' for v in coarse)}"


def described(text: str, starts: list[float], ends: list[float]) -> str:
    """The description of analyse() with the segments' time spans."""
    spans = ",".join(f"{a:.0f}-{z:.0f}" for a, z in zip(starts, ends, strict=True))
    return f"{text};segments={len(starts)};spans_ms={spans}"


def store(docs: DataFrame, path: str) -> DataFrame:
    """Writes doc_id, n_bytes (unpadded) and media (the WAV file) as Parquet at path, and reads it back."""
    prepare(docs.sparkSession)

    def run(iterator):
        for b in iterator:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array([to_wav(padded(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return keep(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary"), path)


def features(media: DataFrame, tensors: bool = True) -> DataFrame:
    """What the stored media hold: sizes and digests, feature text and, if tensors, the segments."""
    prepare(media.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(iterator):
        for b in iterator:
            rows, parts = [], []
            for doc, n, stored in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist(), strict=True):
                payload, rate = from_wav(stored)
                segments, text = analyse(payload, rate)
                text = described(text, [a for a, _, _ in segments], [z for _, z, _ in segments])
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), text))
                parts.append([{"start_ms": a, "end_ms": z, "tensor": t.ravel().tolist()} for a, z, t in segments] if tensors else None)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            if tensors:
                kind = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64()), ("tensor", pa.list_(pa.float32()))]))
                yield pa.record_batch([*columns, pa.array(parts, kind)], [*names, "segments"])
            else:
                yield pa.record_batch(columns, names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema + (f", segments {SEGMENTS}" if tensors else ""))


def as_tensors(segments: list[dict]) -> pa.Table:
    """Segments of features() as Arrow columns: time spans and a fixed-shape tensor."""
    kind = pa.fixed_shape_tensor(pa.float32(), (SLICES, MELS))
    flat = pa.array([s["tensor"] for s in segments], pa.list_(pa.float32(), SLICES * MELS))
    return pa.table({"start_ms": [s["start_ms"] for s in segments], "end_ms": [s["end_ms"] for s in segments], "tensor": pa.ExtensionArray.from_storage(kind, flat)})


def packed(segments) -> bytes:
    """Segments of analyse() as an Arrow stream: start_ms, end_ms and a tensor of the fixed shape (SLICES, MELS)."""
    table = as_tensors([{"start_ms": a, "end_ms": z, "tensor": t.ravel()} for a, z, t in segments])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue()


def unpacked(stored: bytes) -> pa.Table:
    """The table of a stored stream; its tensors must have the fixed shape."""
    table = pa.ipc.open_stream(stored).read_all()
    if table.schema.field("tensor").type != pa.fixed_shape_tensor(pa.float32(), (SLICES, MELS)):
        raise ValueError(f"stored tensors are of type {table.schema.field('tensor').type}")
    return table


SIZES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def store_segments(media: DataFrame, path: str) -> DataFrame:
    """Writes the segments of all stored media at path (sizes and digests, frames, segments) and reads them back."""
    names = [c.split()[0] for c in SIZES.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(iterator):
        for b in iterator:
            rows = []
            for doc, n, stored in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist(), strict=True):
                payload, rate = from_wav(stored)
                segments, text = analyse(payload, rate)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), text, packed(segments)))
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*names, "frames", "segments"])

    return keep(media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"{SIZES}, frames string, segments binary"), path)


def op9_media(docs: DataFrame) -> DataFrame:
    folder = work_folder(docs.sparkSession, "media")
    stored = store_segments(store(docs, f"{folder}/media"), f"{folder}/segments")
    names = [c.split()[0] for c in SIZES.split(", ")]

    def run(iterator):
        for b in iterator:
            text = []
            for frames, segments in zip(b.column("frames").to_pylist(), b.column("segments").to_pylist(), strict=True):
                t = unpacked(segments)
                text.append(described(frames, t.column("start_ms").to_pylist(), t.column("end_ms").to_pylist()))
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(text, pa.string())], [*names, "feature"])

    return stored.mapInArrow(run, f"{SIZES}, feature string")
