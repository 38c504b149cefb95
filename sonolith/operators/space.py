"""Stereo fields of tracks from both channels: width, correlation, and panning by band."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsp
from ..sources.audio import read_wav, with_contents

STEREO = "album string, track string, frame long, t double, mono boolean, width double, correlation double, pan array<double>, energy array<double>"


def bands(sr: int, n: int = 64, low: float = 60.0, high: float = 8000.0) -> list[tuple[int, int]]:
    """First and last + 1 bins of ``n`` bands evenly spaced in pitch; each has one bin at least."""
    at = np.searchsorted(np.fft.rfftfreq(dsp.N_FFT, 1 / sr), np.geomspace(low, high, n + 1))
    return [(int(a), int(max(b, a + 1))) for a, b in zip(at, at[1:], strict=False)]


def pair_rows(left: np.ndarray, right: np.ndarray, sr: int) -> dict[str, np.ndarray]:
    """Per frame the side's share of energy, Pearson's r of the channels, and in each band (R - L) / (R + L) and the energy."""
    view = lambda y: np.lib.stride_tricks.sliding_window_view(y, dsp.N_FFT)[:: dsp.HOP]
    a, b = view(left.astype(float)), view(right.astype(float))
    side, mid = (((b - a) / 2) ** 2).sum(axis=1), (((a + b) / 2) ** 2).sum(axis=1)
    a0, b0 = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    r = (a0 * b0).sum(axis=1) / (np.sqrt((a0**2).sum(axis=1) * (b0**2).sum(axis=1)) + 1e-12)
    pa, pb = (dsp.spectra(y).astype(float) ** 2 for y in (left, right))
    ea, eb = (np.stack([p[:, lo:hi].sum(axis=1) for lo, hi in bands(sr)], axis=1) for p in (pa, pb))
    return {"width": side / (mid + side + 1e-12), "correlation": r, "pan": (eb - ea) / (ea + eb + 1e-12), "energy": ea + eb}


def stereo_frames(files: DataFrame, chunk_s: float = 60.0) -> DataFrame:
    """A row a frame of ``files`` (path, album, track), as STEREO; a mono file counts as two equal channels, of several the first two are taken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f in pdf.itertuples():
                x, sr = read_wav(f.content)
                left, right = (x[0], x[1]) if len(x) > 1 else (x[0], x[0])
                mono = bool(np.abs(left - right).max(initial=0) <= 1e-6)
                n, step = dsp.n_frames(len(left)), max(1, int(chunk_s * sr) // dsp.HOP)
                for a in range(0, n, step):
                    b = min(a + step, n)
                    rows = pair_rows(dsp.around(left, a, b), dsp.around(right, a, b), sr)
                    yield pd.DataFrame({"album": f.album, "track": f.track, "frame": np.arange(a, b), "t": np.arange(a, b) * dsp.HOP / sr, "mono": mono, **{k: list(v) if v.ndim > 1 else v for k, v in rows.items()}})

    return with_contents(files).mapInPandas(run, STEREO)


def smoothed(rows: DataFrame, reach: int = 12) -> DataFrame:
    """(album, track, frame, t, width, correlation): means over ``reach`` frames to each side, fewer at the ends."""
    near = Window.partitionBy("album", "track").orderBy("frame").rowsBetween(-reach, reach)
    return rows.select("album", "track", "frame", "t", *[F.avg(c).over(near).alias(c) for c in ("width", "correlation")])


def pan_bands(rows: DataFrame) -> DataFrame:
    """(album, track, band, pan): where a track's energy in each band lies over its whole length, from -1 (left) to 1 (right); mono tracks have none."""
    e = rows.filter(~F.col("mono")).select("album", "track", F.posexplode(F.arrays_zip("pan", "energy")).alias("band", "b"))
    return e.groupBy("album", "track", "band").agg((F.sum(F.col("b.pan") * F.col("b.energy")) / F.when(F.sum("b.energy") > 0, F.sum("b.energy"))).alias("pan"))
