"""Audio files as arrays: WAV decoded to one channel at 16 kHz, and the noise that training adds."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formulary.functions.names import fresh

RATE, LONGEST = 16_000, 30.0


#: The filter's half length, in periods of its cutoff; the share of the lower half rate that passes; its window's shape; outputs made at a time.
PERIODS, PASSED, SHAPE, AT_ONCE = 48, 0.94, 9.0, 4096


@lru_cache(16)
def _phases(up: int, down: int) -> tuple[np.ndarray, int]:
    """For each place of an output between two inputs the weights of the inputs around it (a windowed sinc that passes what both rates hold), and how many lie before."""
    cutoff = PASSED * min(1.0, up / down)  # of the input's half rate
    half = math.ceil(PERIODS / cutoff)
    away = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    window = np.i0(SHAPE * np.sqrt(np.clip(1 - (away / half) ** 2, 0, None))) / np.i0(SHAPE)
    weights = cutoff * np.sinc(cutoff * away) * window
    return weights / weights.sum(1, keepdims=True), half - 1


def resampled(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """x at another rate, by a polyphase filter over a part of the outputs at a time; beyond its ends x is silent."""
    if rate == to or not len(x):
        return x
    common = math.gcd(rate, to)
    up, down = to // common, rate // common
    weights, before = _phases(up, down)
    n, taps = max(1, round(len(x) * to / rate)), weights.shape[1]
    held = np.concatenate((np.zeros(before), x, np.zeros(taps)))
    out = np.empty(n)
    for at in range(0, n, AT_ONCE):
        place = np.arange(at, min(n, at + AT_ONCE)) * down
        near = np.lib.stride_tricks.sliding_window_view(held, taps)[np.minimum(place // up, len(held) - taps)]
        out[at : at + len(place)] = np.einsum("ij,ij->i", near, weights[place % up])
    return out


def decoded(raw: bytes | None, longest: float = LONGEST) -> np.ndarray | None:
    """Samples from -1 to 1 of a WAV file of 8, 16, 24 or 32 bits: the mean of its channels at 16 kHz, cut to the longest duration. What isn't such a file gives null."""
    try:
        with wave.open(io.BytesIO(raw or b"")) as f:
            width, rate, channels, data = f.getsampwidth(), f.getframerate(), f.getnchannels(), f.readframes(f.getnframes())
    except (wave.Error, EOFError):
        return None
    if not rate or not channels or width > 4:
        return None
    data = data[: len(data) // (width * channels) * width * channels]
    if width == 1:
        x = np.frombuffer(data, np.uint8) / 128.0 - 1
    else:
        bytes_ = np.frombuffer(data, np.uint8).reshape(-1, width)
        whole = np.zeros((len(bytes_), 4), np.uint8)
        whole[:, 4 - width :] = bytes_
        x = whole.view("<i4")[:, 0] / 2147483648.0
    return resampled(x.reshape(-1, channels).mean(1), rate)[: int(RATE * longest)].astype(np.float32)


def read_audio(spark: SparkSession, path: str, longest: float = LONGEST) -> DataFrame:
    """(path, samples, duration): a row for each file; null samples and duration where a file isn't readable."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):  # a file may be large: one at a time
                x = decoded(b.column(1)[at].as_py(), longest)
                columns = [b.column(0).slice(at, 1), pa.array([x], pa.list_(pa.float32())), pa.array([None if x is None else len(x) / RATE], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "samples", "duration"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decode, "path string, samples array<float>, duration double")


def noisy(x: np.ndarray, seed: int, share: float) -> np.ndarray:
    """For a share of the seeds: another gain of up to 6 dB, and in seven of ten of these white noise 15 to 35 dB below the signal, clipped."""
    rng = np.random.default_rng(seed)
    if rng.random() >= share or not len(x):
        return x
    x = x * 10 ** (rng.uniform(-6, 6) / 20)
    if rng.random() < 0.7:
        power, below = np.sqrt(np.mean(np.square(x)) + 1e-9), 10 ** (rng.uniform(15, 35) / 20)
        x = x + rng.standard_normal(len(x)) * power / below
    return np.clip(x, -1, 1).astype(np.float32)


def augmented(rows: DataFrame, key: str, share: float, samples: str = "samples") -> DataFrame:
    """rows with noisy samples, the same for the same key. Null samples stay null."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if x is None else noisy(np.array(x, np.float32), s, share) for x, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float32())), *b.columns[2:]], names=[samples, *rest])

    rest, (seed,) = [c for c in rows.columns if c != samples], fresh(rows, "seed")
    read = rows.select(samples, F.abs(F.xxhash64(key)).alias(seed), *rest)
    return read.mapInArrow(add, read.drop(seed).schema).select(rows.columns)
