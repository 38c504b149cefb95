"""Track descriptors: frames as a long table, then aggregates over it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import circular, dsp
from ..sources.audio import chunks_of, with_contents
from ..sources.guard import guarded
from . import rhythm
from .stability import folded_tempo, windowed_vote
from .timbre import object_profile, sound_objects  # noqa: F401, part of what tracks are described by

FEATURES = ["onset_rate", "centroid_hz", "flatness", "zcr", "flux", "perc_ratio", "dyn_range_db", "chroma_entropy", "duration_s", "pulse_R"]
LOG_FEATURES = ["onset_rate", "centroid_hz", "flatness", "zcr", "duration_s"]
FRAMES = "album string, track string, frame long, t double, duration_s double, heard_s double, rms double, centroid double, flatness double, zcr double, onset double, is_onset boolean, harmonic double, percussive double, chroma array<double>, mfcc array<double>, fine array<double>, capped_s double, error string"
_COLUMNS = [c.split()[0] for c in FRAMES.split(", ")]


def frame_table(chunk: pd.DataFrame) -> pd.DataFrame:
    """The frames of a chunk's row, as FRAMES."""
    (c,) = chunk.itertuples()
    x = dsp.frame_rows(np.asarray(c.samples, np.float32), c.sr, c.before, c.own, dsp.Extent(*c.extent))
    frame = round(c.start_s * c.sr / dsp.HOP) + np.arange(c.own)
    x = {k: list(v) if v.ndim > 1 else v for k, v in x.items()}
    return pd.DataFrame({"album": c.album, "track": c.track, "frame": frame, "t": frame * dsp.HOP / c.sr, "duration_s": c.duration_s, "heard_s": c.heard_s, **x, "capped_s": c.capped_s, "error": None})[_COLUMNS]


def frames(chunks: DataFrame) -> DataFrame:
    """A row a frame of the decoded ``chunks``; those with an error have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                yield frame_table(pdf.iloc[i : i + 1])

    return chunks.filter("error is null").mapInPandas(run, FRAMES)


def frames_of_file(job: tuple, duration: float | None = None, trim_db: float | None = 40.0, chunk_s: float = 60.0, capped: bool = False) -> Iterator[pd.DataFrame]:
    """The frames of one file, a table a chunk; ``job`` is (path, album, track, content)."""
    for chunk in chunks_of(*job, chunk_s, 0.0, duration, trim_db, capped):
        yield frame_table(chunk)


def guarded_frames(files: DataFrame, duration: float | None = None, retry_cap_s: float | None = 600.0, memory_mb: int | None = 4096, seconds: float | None = 3600.0, work: Callable[..., Iterator[pd.DataFrame]] = frames_of_file) -> DataFrame:
    """A row a frame of ``files`` (path, album, track), trimmed; a file without frames has one row with an error.

    Files are analysed in processes apart from Spark's workers. One whose analysis fails or kills its process is tried
    again alone, its first ``retry_cap_s`` seconds only (capped_s says so), under a limit of memory and time.
    """
    cap = retry_cap_s if duration is None or retry_cap_s is None else min(duration, retry_cap_s)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            jobs = list(pdf[["path", "album", "track", "content"]].itertuples(index=False, name=None))
            again = lambda job: work(job, duration=cap if cap is not None else duration, capped=cap is not None)
            for i, tables, error in guarded(jobs, lambda job: work(job, duration=duration), again, memory_mb, seconds):
                if error is None:
                    yield from tables
                else:
                    yield pd.DataFrame([{c: None for c in _COLUMNS} | {"album": jobs[i][1], "track": jobs[i][2], "error": error}], dtype=object)

    return with_contents(files).mapInPandas(run, FRAMES)


def track_features(f: DataFrame) -> DataFrame:
    """The descriptors of each track from its frames (cached by the caller)."""
    key = ["album", "track"]
    db = 20 * F.log10(F.greatest("rms", F.lit(1e-6)))
    chroma = [F.avg(F.element_at("chroma", i + 1)).alias(f"_c{i}") for i in range(12)]
    a = f.groupBy(*key).agg(
        F.round(F.max("duration_s"), 1).alias("duration_s"),
        F.round(F.sum(F.col("is_onset").cast("int")) / F.greatest(F.max("heard_s"), F.lit(1e-9)), 3).alias("onset_rate"),
        F.round(F.avg("centroid"), 1).alias("centroid_hz"),
        F.round(F.avg("flatness"), 5).alias("flatness"),
        F.round(F.avg("zcr"), 5).alias("zcr"),
        F.round(F.avg("onset"), 3).alias("flux"),
        F.round(F.sum("percussive") / (F.sum("harmonic") + F.sum("percussive") + 1e-12), 4).alias("perc_ratio"),
        F.round(F.percentile(db, 0.95) - F.percentile(db, 0.10), 2).alias("dyn_range_db"),
        F.max("capped_s").alias("analysis_capped_s"),
        *chroma,
    )
    c = [F.col(f"_c{i}") for i in range(12)]
    a = a.withColumn("chroma", F.array(*[F.round(x, 4) for x in c]))
    p = F.transform("chroma", lambda x: x / (F.aggregate("chroma", F.lit(0.0), lambda s, y: s + y) + 1e-12))
    a = a.withColumn("chroma_entropy", F.round(-F.aggregate(F.transform(p, lambda x: x * F.log2(x + 1e-12)), F.lit(0.0), lambda s, y: s + y), 3))
    angle, r = circular.fifths(c)
    a = a.withColumns({"fifths_center": circular.fifths_note(angle), "fifths_R": F.round(r, 4)})
    keys = circular.key_estimate(a, [F.element_at("chroma", i + 1) for i in range(12)], key).select(*key, "key", F.round("conf", 3).alias("key_conf"))
    return a.join(keys, key).join(pulse(f), key, "left").drop(*[f"_c{i}" for i in range(12)])


def pulse(f: DataFrame, least: int = 8, bpm: tuple[float, float] = (40.0, 200.0)) -> DataFrame:
    """Per track the strength-weighted resultant of its onsets at the dominant period, its half or its double, whichever locks best; and the tempo by a prior around 120."""
    key = ["album", "track"]
    rate = F.lit(1.0) / F.max(F.col("t") / F.when(F.col("frame") > 0, F.col("frame")))
    rates = f.groupBy(*key).agg(F.coalesce(rate, F.lit(22050 / dsp.HOP)).alias("rate"))
    env = rhythm.dominant_lag(f, key, "frame", "onset", rates, bpm).select(*key, (F.col("lag") / F.col("rate")).alias("p0"))
    on = f.filter("is_onset").select("album", "track", "t", "onset").join(env, key)
    e = on.select("*", F.explode(F.array(F.col("p0") / 2, F.col("p0"), F.col("p0") * 2)).alias("p")).filter(F.col("p").between(60 / bpm[1], 60 / bpm[0]))
    ang = F.col("t") / F.col("p") * (2 * np.pi)
    s = e.groupBy("album", "track", "p").agg(F.sum(F.col("onset") * F.cos(ang)).alias("c"), F.sum(F.col("onset") * F.sin(ang)).alias("s"), F.sum("onset").alias("w"), F.count("*").alias("n")).filter(F.col("n") >= least)
    best = s.withColumn("R", circular.resultant(F.col("c"), F.col("s"), F.col("w"))).groupBy("album", "track").agg(F.max_by(F.struct("R", "p"), F.struct(F.round("R", 9), -F.col("p"))).alias("b"))
    tempo = rhythm.tempo(rhythm.lag_means(f, key, "frame", "onset", int(8 * 22050 / dsp.HOP)).join(rates, key), key).select(*key, F.round("bpm", 1).alias("tempo_bpm"))
    out = env.join(best, key, "left").join(tempo, key, "left")
    return out.select("album", "track", F.round(F.coalesce("b.R", F.lit(0.0)), 4).alias("pulse_R"), F.round(60 / F.coalesce("b.p", "p0"), 1).alias("pulse_bpm"), "tempo_bpm")


def windowed(f: DataFrame, size: float = 20.0) -> DataFrame:
    """Per track the key and the tempo of its whole windows of ``size`` seconds, with the shares that agree (null with one window) and their number.

    A last window that isn't whole counts only where it is the only one. An envelope is gathered a window at a time.
    """
    key = ["album", "track"]
    w = f.withColumn("win", F.floor(F.col("t") / size).cast("long")).filter((F.col("win") == 0) | ((F.col("win") + 1) * size <= F.col("heard_s")))
    chroma = [F.avg(F.element_at("chroma", i + 1)).alias(f"_c{i}") for i in range(12)]
    own = w.groupBy(*key, "win").agg(*chroma, F.array_sort(F.collect_list(F.struct("frame", "onset"))).alias("e"), F.least(F.max("heard_s"), F.lit(size)).alias("d"))
    keys = circular.key_estimate(own.withColumn("id", F.struct(*key)), [F.col(f"_c{i}") for i in range(12)], ["id", "win"])
    votes = windowed_vote(keys, "id", F.col("win").cast("double"), "key", 1.0).select(F.col("id").alias("k_id"), F.col("modal").alias("key_windowed"), F.col("agreement").alias("key_agreement"), F.col("n_windows").alias("key_windows"))
    period = F.pandas_udf(lambda env, rate: pd.Series([dsp.dominant_period(np.asarray(e, float), r) for e, r in zip(env, rate, strict=True)]), "double")
    tempo = own.select(F.struct(*key).alias("id"), (60 / period(F.transform("e", lambda x: x["onset"]), F.size("e") / F.greatest("d", F.lit(0.1)))).alias("bpm"))
    folded = folded_tempo(tempo, "id", "bpm").select("id", F.round("tempo", 1).alias("tempo_windowed_bpm"), F.col("agreement").alias("tempo_agreement"))
    return folded.join(votes, F.col("id") == F.col("k_id")).select("id.album", "id.track", "key_windowed", "key_agreement", "key_windows", "tempo_windowed_bpm", "tempo_agreement")
