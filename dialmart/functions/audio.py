"""Signals in binary columns: G.711 decoding, resampling and energy-based speech detection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def mu_law(data: np.ndarray) -> np.ndarray:
    """Linear 16-bit samples of mu-law bytes, by the standard's formula."""
    x = ~data
    size = (((x & 15).astype(np.int32) << 3) + 132 << ((x >> 4) & 7)) - 132
    return np.where(x & 128, -size, size).astype(np.int16)


def a_law(data: np.ndarray) -> np.ndarray:
    """Linear 16-bit samples of A-law bytes, by the standard's formula."""
    x = data ^ 0x55
    part, step = (x >> 4) & 7, (x & 15).astype(np.int32)
    size = np.where(part == 0, (step << 4) + 8, (step << 4) + 264 << np.maximum(part, 1) - 1)
    return np.where(x & 128, size, -size).astype(np.int16)


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate, by straight lines between neighbours."""
    n = int(round(len(samples) * to / rate))
    return np.interp(np.arange(n) * rate / to, np.arange(len(samples)), samples) if len(samples) else samples


def speech_spans(samples: np.ndarray, rate: int, frame: float = 0.03, merge: float = 0.3, least: float = 0.2) -> list[tuple[float, float]]:
    """Spans in seconds whose frames are louder than between the quiet tenth and the loud end.

    Spans within `merge` seconds are one, and those below `least` are dropped.
    """
    size = max(1, int(rate * frame))
    n = len(samples) // size
    if not n:
        return []
    level = np.sqrt((samples[: n * size].reshape(n, size).astype(float) ** 2).mean(1))
    quiet, loud = np.percentile(level, [10, 95])
    on = level > quiet + 0.25 * (loud - quiet) if loud > 2 * quiet else level > max(quiet, 1.0) * 2
    edge = np.flatnonzero(np.diff(np.r_[False, on, False]))
    spans: list[list[float]] = []
    for a, b in zip(edge[::2] * size / rate, edge[1::2] * size / rate, strict=True):
        if spans and a - spans[-1][1] <= merge:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans if b - a >= least]


def speech_of(content: Column, law: str = "mu", rate: int = 8000) -> Column:
    """Speech spans of G.711 recordings in a binary column."""
    decode = mu_law if law == "mu" else a_law

    @F.pandas_udf("array<struct<start: double, end: double>>")
    def spans(values):
        return values.map(lambda raw: [{"start": a, "end": b} for a, b in speech_spans(decode(np.frombuffer(raw, np.uint8)), rate)])

    return spans(content)


def byte_entropy(content: Column) -> Column:
    """Bits a byte of a binary column."""

    @F.pandas_udf("double")
    def entropy(values):
        def one(raw):
            p = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / max(len(raw), 1)
            p = p[p > 0]
            return float(-(p * np.log2(p)).sum()) if len(p) else 0.0

        return values.map(one)

    return entropy(content)
