"""Audio features: polyphase resampling, overlapped log-mel filterbanks, hysteresis energy segmentation."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planforge.llm.common import in_batches, slices, table

RATE, UP, DOWN, TAPS = 16_000, 5, 8, 16
OUT_RATE = RATE * UP // DOWN
FRAME, HOP, MELS, TENSOR = 256, 128, 20, (32, 20)


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of 8-bit unsigned mono samples."""
    pad = len(samples) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


def read_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of a file that wav() made, or of any RIFF file of 8-bit mono samples."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono samples")
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


@functools.cache
def polyphase() -> np.ndarray:
    """A column for each of the UP phases: the filter over the samples of a block of DOWN and TAPS around it."""
    half = TAPS * UP // 2
    t = np.arange(-half, half + 1)
    cut = 0.9 / max(UP, DOWN)
    low = np.sinc(t * cut) * cut * UP * np.hamming(len(t))
    out = np.zeros((DOWN + TAPS, UP), np.float32)
    for p in range(UP):
        for w in range(DOWN + TAPS):
            d = p * DOWN - (w - TAPS // 2) * UP  # distance on the up-sampled grid
            if -half <= d <= half:
                out[w, p] = low[d + half]
    return out


def resample(x: np.ndarray) -> np.ndarray:
    """Change the rate by UP/DOWN. The input counts as zero outside; blocks of DOWN samples give UP each."""
    blocks = -(-len(x) // DOWN)
    padded = np.zeros(blocks * DOWN + TAPS, np.float32)
    padded[TAPS // 2 : TAPS // 2 + len(x)] = x
    view = np.lib.stride_tricks.as_strided(padded, (blocks, DOWN + TAPS), (DOWN * 4, 4), writeable=False)
    return (np.ascontiguousarray(view) @ polyphase()).ravel()


@functools.cache
def mel_bank() -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale from 0 to half the rate."""
    top = 2595 * np.log10(1 + OUT_RATE / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    freq = np.arange(FRAME // 2 + 1) * OUT_RATE / FRAME
    left, mid, right = hz[:-2, None], hz[1:-1, None], hz[2:, None]
    return np.maximum(0, np.minimum((freq - left) / (mid - left), (right - freq) / (right - mid))).T.astype(np.float32)


def log_mel(y: np.ndarray) -> np.ndarray:
    """(frames, MELS) of frames of FRAME samples, HOP apart; a shorter signal is padded to one frame."""
    frames = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    padded = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    padded[: len(y)] = y[: len(padded)]
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    spectrum = np.fft.rfft(view * np.hanning(FRAME).astype(np.float32))
    power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
    return np.log(power @ mel_bank() + np.float32(1e-6))


def segments(energy: np.ndarray, high: float = 0.5, low: float = 0.0) -> list[tuple[int, int]]:
    """Runs of frames (end exclusive) over mean + low * deviation that somewhere exceed mean + high * deviation."""
    mean, dev = float(energy.mean()), float(energy.std())
    over = np.concatenate([[0], (energy > mean + low * dev).astype(np.int8), [0]])
    edge = np.diff(over)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hits = np.concatenate([[0], np.cumsum(energy > mean + high * dev)])
    keep = hits[end] > hits[start]
    return list(zip(start[keep].tolist(), end[keep].tolist(), strict=True))


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream of fixed-shape tensors of 32 frames each, with their time spans in seconds. The last is padded with its lowest value."""
    n = -(-len(mel) // TENSOR[0])
    full = np.full((n * TENSOR[0], MELS), mel.min(), np.float32)
    full[: len(mel)] = mel
    values = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(full.reshape(n, *TENSOR)))
    start = np.arange(n) * (TENSOR[0] * HOP / OUT_RATE)
    end = np.minimum(start + TENSOR[0] * HOP / OUT_RATE, ((len(mel) - 1) * HOP + FRAME) / OUT_RATE)
    batch = pa.record_batch([pa.array(start), pa.array(end), values], ["start_s", "end_s", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


SPANS = T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))
FIELDS = [
    T.StructField("media", T.BinaryType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("tensors", T.BinaryType()),
    T.StructField("band_means", T.ArrayType(T.FloatType())),
    T.StructField("voiced", SPANS),
]


def audio(df: DataFrame, payload: str = "text") -> DataFrame:
    """Store each payload as audio, read it back and add its features.

    Adds `media` (the file), what was read back (`payload_bytes`, `payload_sha256`, `tail_crc32` of the last 64
    bytes), `tensors` (see tensors()), `band_means` and `voiced` (time spans). The payload is a string
    or binary column, padded by bytes 0 to a positive multiple of 64; null counts as empty.
    Every other column stays; columns of these names are replaced.
    """
    names = [f.name for f in FIELDS]
    rest = df.drop(*names)
    spans = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.float32()), spans]

    def one(value: str | bytes | None) -> tuple:
        raw = value.encode() if isinstance(value, str) else bytes(value or b"")
        media = wav(raw + b"\0" * (64 - len(raw) % 64 if len(raw) % 64 or not raw else 0))
        _, back = read_wav(media)
        x = (np.frombuffer(back, np.uint8).astype(np.float32) - 128) / 128
        mel = log_mel(resample(x))
        voiced = [{"start_s": a * HOP / OUT_RATE, "end_s": ((b - 1) * HOP + FRAME) / OUT_RATE} for a, b in segments(mel.mean(1))]
        return media, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), tensors(mel), mel.mean(0), voiced

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, payload, 2 << 20):
                made = list(zip(*(one(v) for v in part.column(payload).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))], names=[*part.schema.names, *names])

    return in_batches(rest, run, T.StructType([*rest.schema.fields, *FIELDS]))


def op7_media(spark, sf_dir: str) -> DataFrame:
    """Every document stored as audio and read back; the feature is frames, band means, voiced spans and voiced seconds."""
    out = audio(table(spark, sf_dir, "documents").select("doc_id", "text"))
    seconds = F.aggregate("voiced", F.lit(0.0), lambda s, v: s + v["end_s"] - v["start_s"])
    means = F.concat_ws(",", F.transform("band_means", lambda v: F.format_string("%.1f", v)))
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("|", means, F.size("voiced"), F.format_string("%.3f", seconds)).alias("feature"),
    )
