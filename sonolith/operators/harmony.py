"""Tonal space: tonnetz paths and the constant-Q helix of tracks."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsp
from ..sources.audio import samples_of, with_contents

# The intervals (in steps of pi) and radii of the three circles of the tonal centroid: fifths, minor and major thirds.
CIRCLES = [(7 / 6, 1.0), (3 / 2, 1.0), (2 / 3, 0.5)]


def tonnetz(chroma: Sequence[Column]) -> list[Column]:
    """The six coordinates of a chroma's tonal centroid, sine and cosine on each circle; zeros for silence."""
    total = sum((F.abs(c) for c in chroma[1:]), F.abs(chroma[0]))
    out = []
    for step, radius in CIRCLES:
        for turn in (math.sin, math.cos):
            weighted = [c * (radius * turn(math.pi * step * i)) for i, c in enumerate(chroma)]
            out.append(sum(weighted[1:], weighted[0]) / F.when(total > 0, total).otherwise(1.0))
    return out


def tonnetz_path(frames: DataFrame, key: Sequence[str], chroma: Sequence[Column], points: int = 400, reach: int = 3) -> DataFrame:
    """(key, point, frame, x, y): a recording's way on the circle of fifths, every so many frames that ``points`` to twice as many remain, smoothed over ``reach`` points to each side (fewer at the ends)."""
    x, y = tonnetz(chroma)[:2]
    size = frames.groupBy(*key).agg(F.greatest(F.floor((F.max("frame") + 1) / points), F.lit(1)).alias("_step"))
    p = frames.join(size, list(key)).filter(F.col("frame") % F.col("_step") == 0).select(*key, F.floor(F.col("frame") / F.col("_step")).alias("point"), "frame", x.alias("x"), y.alias("y"))
    near = Window.partitionBy(*key).orderBy("point").rowsBetween(-reach, reach)
    return p.select(*key, "point", "frame", *[F.avg(c).over(near).alias(c) for c in ("x", "y")])


@functools.cache
def constant_q(sr: int, lowest: float, bins: int, per_octave: int, n_fft: int) -> list[tuple[int, np.ndarray]]:
    """Of each bin the first place and the values of its kernel in a spectrum of ``n_fft``: a Hann-windowed tone whose length keeps its quality, values under a hundredth of the largest left out."""
    q = 1 / (2 ** (1 / per_octave) - 1)
    out = []
    for k in range(bins):
        f = lowest * 2 ** (k / per_octave)
        if f * (1 + 1 / q) >= sr / 2:
            break
        n = min(n_fft, round(q * sr / f))
        window = np.hanning(n + 2)[1:-1]
        tone = np.zeros(n_fft, complex)
        at = (n_fft - n) // 2
        tone[at : at + n] = window / window.sum() * np.exp(2j * np.pi * f / sr * (np.arange(n) - n / 2))
        kernel = np.conj(np.fft.fft(tone)[: n_fft // 2 + 1])
        loud = np.flatnonzero(np.abs(kernel) > 0.01 * np.abs(kernel).max())
        out.append((int(loud[0]), kernel[loud[0] : loud[-1] + 1] / n_fft))
    return out


def constant_q_sums(y: np.ndarray, sr: int, first: int, last: int, step: int, lowest: float, bins: int, per_octave: int, n_fft: int) -> tuple[np.ndarray, int]:
    """Sums of the magnitudes of ``bins`` bins over every ``step``-th of the frames ``first`` to ``last`` - 1 of ``y``, and how many those are."""
    kernels = constant_q(sr, lowest, bins, per_octave, n_fft)
    total, at = np.zeros(bins), np.arange(-(-first // step) * step, last, step)
    for t in at:
        a = t * dsp.HOP - n_fft // 2
        part = y[max(a, 0) : max(a + n_fft, 0)]
        spectrum = np.fft.rfft(np.pad(part, (max(0, -a), n_fft - len(part) - max(0, -a))))
        for k, (lo, kernel) in enumerate(kernels):
            total[k] += 2 * abs(np.dot(spectrum[lo : lo + len(kernel)], kernel))
    return total, len(at)


def helix(files: DataFrame, lowest: float = 65.40639132514966, octaves: int = 5, per_octave: int = 36, step: int = 8, chunk_s: float = 60.0, n_fft: int = 1 << 15) -> DataFrame:
    """(album, track, bin, hz, angle, radius, energy): mean constant-Q magnitudes of tracks from C2 up, the largest of a track 1; an octave is a turn, outward."""
    bins = octaves * per_octave

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                y, sr = samples_of(r.content)
                n, size = dsp.n_frames(len(y)), max(step, int(chunk_s * sr) // dsp.HOP)
                for a in range(0, n, size):
                    total, count = constant_q_sums(y, sr, a, min(a + size, n), step, lowest, bins, per_octave, n_fft)
                    yield pd.DataFrame({"album": r.album, "track": r.track, "bin": np.arange(bins), "total": total, "n": count})

    parts = with_contents(files).mapInPandas(run, "album string, track string, bin long, total double, n long")
    mean = parts.groupBy("album", "track", "bin").agg((F.sum("total") / F.greatest(F.sum("n"), F.lit(1))).alias("e"))
    most = F.max("e").over(Window.partitionBy("album", "track"))
    return mean.select("album", "track", "bin", (lowest * F.pow(F.lit(2.0), F.col("bin") / per_octave)).alias("hz"), (2 * math.pi * (F.col("bin") % per_octave) / per_octave).alias("angle"), (0.3 + F.col("bin") / per_octave / 5).alias("radius"), (F.col("e") / (most + 1e-9)).alias("energy"))
