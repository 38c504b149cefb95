"""Tempo from onset envelopes: tempogram, tempo under a prior, dominant lag.

Envelopes are long tables (key, frame, value). They are dealt in blocks of frames, each with the frames beyond its ends
that its windows reach, so that tasks are of one size however long a recording is, and a row doesn't depend on the cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsp

#: Frames of a block.
BLOCK = 4096


def in_blocks(f: DataFrame, key: Sequence[str], frame: str, value: str, before: int, after: int, run: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], out: str, block: int = BLOCK) -> DataFrame:
    """(key, the columns ``out``) that ``run`` makes of each block: (envelope with ``before`` and ``after`` frames more, its present frames) to arrays.

    Frames that are missing are 0 in the envelope; those present are given by their numbers.
    """
    own = f.select(*key, F.col(frame).cast("long").alias("_frame"), F.col(value).cast("double").alias("_value"))
    first, last = F.floor((F.col("_frame") - after) / block), F.floor((F.col("_frame") + before) / block)
    dealt = own.withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    names = [c.split()[0] for c in out.split(", ")]

    def one(at: pa.Table) -> pa.Table:
        start = at["_block"][0].as_py() * block
        frames, values = at["_frame"].to_numpy(), at["_value"].to_numpy(zero_copy_only=False)
        envelope = np.zeros(before + block + after)
        envelope[frames - start + before] = np.nan_to_num(values)
        made = run(envelope, np.sort(frames[(frames >= start) & (frames < start + block)]) - start)
        n = len(made[names[0]])
        made = {k: np.asarray(v) + start if k == "frame" else v for k, v in made.items()}
        return pa.table({**{k: pa.array([at[k][0].as_py()] * n, at.schema.field(k).type) for k in key}, **{k: pa.array(made[k]) for k in names}})

    kinds = ", ".join(f"`{k}` {f.schema[k].dataType.simpleString()}" for k in key)
    return dealt.groupBy(*key, "_block").applyInArrow(one, f"{kinds}, {out}")


def _windows(window: int) -> tuple[int, int, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    half = window // 2
    return half, window - half - 1, lambda envelope, frames: np.lib.stride_tricks.sliding_window_view(envelope, window)[frames]


def tempogram(f: DataFrame, key: Sequence[str], frame: str, value: str, window: int, step: int = 1, block: int = BLOCK) -> DataFrame:
    """(key, frame, lag, value): how much the envelope around every ``step``-th frame agrees with itself ``lag`` frames on, its largest value 1.

    A window of ``window`` frames is centred on the frame, weighted by Hann, and silent beyond the recording; a window of silence has 0 at all lags.
    """
    before, after, view = _windows(window)

    def run(envelope: np.ndarray, frames: np.ndarray) -> dict[str, np.ndarray]:
        frames = frames[frames % step == 0] if block % step == 0 else frames
        parts = [dsp.lag_strengths(view(envelope, frames[i : i + 256])) for i in range(0, len(frames), 256)]
        r = np.concatenate(parts) if parts else np.zeros((0, window))
        return {"frame": np.repeat(frames, window), "lag": np.tile(np.arange(window), len(frames)), "value": r.ravel()}

    rows = in_blocks(f, key, frame, value, before, after, run, "frame long, lag long, value double", block)
    return rows if block % step == 0 else rows.filter(F.col("frame") % step == 0)


def lag_means(f: DataFrame, key: Sequence[str], frame: str, value: str, window: int, block: int = BLOCK) -> DataFrame:
    """(key, lag, value): means of the tempogram over all frames, summed up block by block."""
    before, after, view = _windows(window)

    def run(envelope: np.ndarray, frames: np.ndarray) -> dict[str, np.ndarray]:
        total = np.zeros(window)
        for i in range(0, len(frames), 256):
            total += dsp.lag_strengths(view(envelope, frames[i : i + 256])).sum(axis=0)
        return {"lag": np.arange(window), "total": total, "n": np.full(window, len(frames), float)}

    parts = in_blocks(f, key, frame, value, before, after, run, "lag long, total double, n double", block)
    return parts.groupBy(*key, "lag").agg((F.sum("total") / F.greatest(F.sum("n"), F.lit(1.0))).alias("value"))


def bpm(lag: Column, rate: Column) -> Column:
    """Beats a minute of a lag in frames; null for lag 0."""
    return 60 * rate / F.when(lag > 0, lag)


def tempo(means: DataFrame, key: Sequence[str], start: float = 120.0, octaves: float = 1.0, most: float = 320.0) -> DataFrame:
    """(key, lag, bpm) of the strongest lag under a log-normal prior; ``means`` has key, lag, value and rate, the frames a second.

    ``bpm`` is that of the vertex of the parabola through the lag and its neighbours, as tempos of whole lags lie some percent apart.
    """
    near = Window.partitionBy(*key).orderBy("lag")
    left, right = F.lag("value").over(near), F.lead("value").over(near)
    bend = left - 2 * F.col("value") + right
    vertex = F.when(bend < 0, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), (left - right) / (2 * bend)))).otherwise(0.0)
    m = means.withColumn("_off", F.coalesce(vertex, F.lit(0.0))).filter((F.col("lag") > 0) & (bpm(F.col("lag"), F.col("rate")) < most))
    prior = -0.5 * F.pow(F.log2(bpm(F.col("lag"), F.col("rate")) / start) / octaves, F.lit(2.0))
    score = F.log1p(1e6 * F.greatest("value", F.lit(0.0))) + prior
    best = m.groupBy(*key).agg(F.max_by(F.struct("lag", "_off", "rate"), F.struct(F.round(score, 9), -F.col("lag"))).alias("b"))
    return best.select(*key, "b.lag", (60 * F.col("b.rate") / (F.col("b.lag") + F.col("b._off"))).alias("bpm"))


def dominant_lag(f: DataFrame, key: Sequence[str], frame: str, value: str, rates: DataFrame, beats: tuple[float, float], seconds: float = 4.0, rate: float = 22050 / dsp.HOP, block: int = BLOCK) -> DataFrame:
    """(key, lag, rate): the lag within the range of ``beats`` a minute at which an envelope agrees most with itself; ``rates`` are (key, rate)."""
    most = int(math.ceil(2.2 * seconds * rate))  # up to 48 kHz

    def run(envelope: np.ndarray, frames: np.ndarray) -> dict[str, np.ndarray]:
        own, n = envelope[:block], 1 << (2 * block + most).bit_length()
        r = np.fft.irfft(np.conj(np.fft.rfft(own, n)) * np.fft.rfft(envelope, n), n)[:most]
        return {"lag": np.arange(most), "r": r}

    parts = in_blocks(f, key, frame, value, 0, most, run, "lag long, r double", block)
    r = parts.groupBy(*key, "lag").agg(F.sum("r").alias("r")).join(rates, list(key))
    low, high = F.greatest(F.floor(60.0 / beats[1] * F.col("rate")), F.lit(1)), F.floor(60.0 / beats[0] * F.col("rate"))
    inside = r.filter((F.col("lag") >= low) & (F.col("lag") < high))
    return inside.groupBy(*key).agg(F.max_by(F.struct("lag", "rate"), F.struct(F.round("r", 6), -F.col("lag"))).alias("b")).select(*key, "b.lag", "b.rate")
