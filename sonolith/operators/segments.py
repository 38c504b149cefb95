"""Ordered recordings: pooled frames, adaptive masks, runs, spans and regions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 128


def pool(df: DataFrame, recording: str, time: Column, size: float, aggs: list[Column]) -> DataFrame:
    """Frames of ``size`` seconds: floor(time / size) and the aggregates."""
    return df.groupBy(F.col(recording).alias("recording"), F.floor(time / size).cast("long").alias("frame")).agg(*aggs)


def otsu(df: DataFrame, group: str, value: str, bins: int = BINS) -> DataFrame:
    """Per group the threshold (upper edge of the first best bin), the means of the two classes and the share below.

    Bins are counted first, so what is summed up in order is at most ``bins`` rows a group; the counts are integers, so
    that empty bins tie exactly.
    """
    g = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("recording"), F.col(value).alias("v"))
    r = g.groupBy("recording").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select("recording", F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor((F.col("v") - F.col("lo")) / step), F.lit(bins - 1)).cast("long")
    h = g.join(r, "recording").groupBy("recording", "lo", "hi", b.alias("bin")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("recording").orderBy("bin")
    whole = Window.partitionBy("recording")
    c = h.select("*", F.sum("n").over(up).alias("w0"), F.sum(F.col("n") * F.col("bin")).over(up).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("bin")).over(whole).alias("s"))
    w1 = F.col("w") - F.col("w0")
    m0 = F.col("s0") / F.col("w0")
    m1 = F.when(w1 > 0, (F.col("s") - F.col("s0")) / F.when(w1 > 0, w1)).otherwise(0.0)
    between = F.when(w1 > 0, F.col("w0").cast("double") * w1 * (m0 - m1) * (m0 - m1)).otherwise(0.0)
    scored = c.select("recording", "lo", "hi", "bin", "w0", "w", m0.alias("m0"), m1.alias("m1"), F.round(between, 6).alias("between"))
    best = scored.groupBy("recording").agg(F.max_by(F.struct("lo", "hi", "bin", "m0", "m1", "w0", "w"), F.struct("between", -F.col("bin"))).alias("b"))
    width = (F.col("b.hi") - F.col("b.lo")) / bins
    centre = lambda m: F.col("b.lo") + (m + 0.5) * width
    return best.select("recording", (F.col("b.lo") + (F.col("b.bin") + 1) * width).alias("threshold"), centre(F.col("b.m0")).alias("mean_low"), centre(F.col("b.m1")).alias("mean_high"), (F.col("b.w0") / F.col("b.w")).alias("share_low"))


def music_mask(frames: DataFrame, level: str, flat: str, floor_db: float = 15.0, decades: float = 0.7, least: float = 0.05) -> DataFrame:
    """``frames`` (recording, frame, level in dB, log10 flatness) with is_music: loud, and tonal where the flatness has two modes."""
    cut = otsu(frames, "recording", flat)
    loudness = frames.groupBy("recording").agg(F.percentile(level, 0.95).alias("p95"))
    j = frames.join(cut, "recording").join(loudness, "recording")
    loud = F.col(level) > F.col("p95") - floor_db
    one_mode = (F.col("mean_high") - F.col("mean_low") < decades) | (F.least("share_low", 1 - F.col("share_low")) < least)
    return j.select(*frames.columns, (loud & (one_mode | (F.col(flat) < F.col("threshold")))).alias("is_music"))


def runs(frames: DataFrame, label: Column) -> DataFrame:
    """Maximal runs of one label in consecutive frames: (recording, label, start, end), end exclusive."""
    w = Window.partitionBy("recording").orderBy("frame")
    f = frames.select("recording", "frame", label.alias("label"))
    new = F.when((F.lag("label").over(w).eqNullSafe(F.col("label"))) & (F.lag("frame").over(w) == F.col("frame") - 1), 0).otherwise(1)
    i = f.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return i.groupBy("recording", "_run", "label").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("end")).drop("_run")


def gap_merge(spans: DataFrame, min_gap: float, min_length: float = 0.0) -> DataFrame:
    """Spans of a recording closer than ``min_gap`` as one; then those shorter than ``min_length`` go."""
    w = Window.partitionBy("recording").orderBy("start")
    new = F.when(F.col("start") - F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) < min_gap, 0).otherwise(1)
    g = spans.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w))
    merged = g.groupBy("recording", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")
    return merged.filter(F.col("end") - F.col("start") >= min_length)


def segments(mask: DataFrame, min_gap: float = 12.0, min_length: float = 60.0) -> DataFrame:
    """The songs of a frame mask (recording, frame, is_music), in frames."""
    return gap_merge(runs(mask.filter("is_music"), F.lit(True)), min_gap, min_length)


def join_across(spans: DataFrame, files: DataFrame, tolerance: float = 5.0, min_length: float = 60.0) -> DataFrame:
    """Songs over the files of a session: a span that reaches the end of its file goes on in one that opens the next.

    ``files`` has (session, file, file_idx, duration), ``spans`` (file, start, end). A file without spans breaks the chain.
    Songs shorter than ``min_length`` in all their parts go; the rest are numbered in order of time.
    """
    f = files.withColumn("offset", F.sum("duration").over(Window.partitionBy("session").orderBy("file_idx")) - F.col("duration"))
    j = f.join(spans, "file", "left")
    own = Window.partitionBy("session", "file_idx").orderBy("start")
    j = j.withColumn("_i", F.row_number().over(own)).withColumn("_last", F.row_number().over(own.orderBy(F.desc("start"))) == 1)
    by_time = Window.partitionBy("session").orderBy("file_idx", "_i")
    open_end = F.col("_last") & F.col("start").isNotNull() & (F.col("duration") - F.col("end") <= tolerance)
    goes_on = (F.col("_i") == 1) & F.col("start").isNotNull() & (F.col("start") <= tolerance) & F.coalesce(F.lag("_open").over(by_time), F.lit(False)) & (F.lag("file_idx").over(by_time) == F.col("file_idx") - 1)
    g = j.withColumn("_open", open_end).withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_song", F.sum("_new").over(by_time)).filter("start is not null")
    part = F.struct("file_idx", "file", "start", "end")
    songs = g.groupBy("session", "_song").agg(F.min(F.col("offset") + F.col("start")).alias("start"), F.max(F.col("offset") + F.col("end")).alias("end"), F.sum(F.col("end") - F.col("start")).alias("duration"), F.array_sort(F.collect_list(part)).alias("parts"))
    kept = songs.filter(F.col("duration") >= min_length)
    return kept.withColumn("index", F.row_number().over(Window.partitionBy("session").orderBy("start"))).drop("_song")


def classify(frames: DataFrame, level: str, flat: str, variability: str, music_flat: float = -2.2, quiet_db: float = 12.0, applause_flat: float = -1.62, voices: float = 0.40) -> DataFrame:
    """``frames`` with a label: music before quiet before voices or applause, else other."""
    p95 = frames.groupBy("recording").agg(F.percentile(level, 0.95).alias("_p95"))
    music = F.col("is_music") & (F.col(flat) < music_flat)
    label = F.when(music, "music").when(F.col(level) <= F.col("_p95") - quiet_db, "quiet").when(F.col(variability) >= voices, "voices").when(F.col(flat) >= applause_flat, "applause").otherwise("other")
    return frames.join(p95, "recording").withColumn("label", label).drop("_p95")


def _next_length(left: list[list]) -> float:
    """The length of the next span in reverse order, with those of its label right after it."""
    label, start, end = left[-1][1], left[-1][2], left[-1][3]
    for x in reversed(left[:-1]):
        if x[1] != label:
            break
        end = x[3]
    return end - start


def absorb(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """The spans of one recording with those shorter than ``least`` given to their longer neighbour, first ones first.

    One pass: what lies before the first short span stays long, as spans only grow.
    """
    done: list[list] = []
    left = [list(x) for x in pdf.sort_values("start", ascending=False)[["recording", "label", "start", "end"]].itertuples(index=False)]
    while left:
        span = left.pop()
        while left and left[-1][1] == span[1]:
            span[3] = left.pop()[3]
        if done and done[-1][1] == span[1]:
            done[-1][3] = span[3]
        elif span[3] - span[2] >= least or not (done or left):
            done.append(span)
        elif not left or (done and done[-1][3] - done[-1][2] >= _next_length(left)):
            done[-1][3] = span[3]
        else:
            left[-1][2] = span[2]
    return pd.DataFrame(done, columns=["recording", "label", "start", "end"])


def regions(frames: DataFrame, least: float = 5.0) -> DataFrame:
    """Labelled spans of each recording without flickers; a recording's spans, not its frames, meet in one task."""
    r = runs(frames, F.col("label")).select("recording", "label", "start", "end")
    return r.groupBy("recording").applyInPandas(lambda pdf: absorb(pdf, least), r.schema)


def paint(frames: DataFrame, songs: DataFrame) -> DataFrame:
    """``frames`` (recording, frame, label) under a setlist (recording, start, end): music inside a song, and music nowhere else."""
    s = songs.select(F.col("recording").alias("_r"), F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("_f")).distinct()
    j = frames.join(s, (F.col("recording") == F.col("_r")) & (F.col("frame") == F.col("_f")), "left")
    return j.select("recording", "frame", F.when(F.col("_f").isNotNull(), "music").when(F.col("label") == "music", "other").otherwise(F.col("label")).alias("label"))


def overlap(spans: DataFrame, bounds: DataFrame, width: float, least: float = 0.0) -> DataFrame:
    """(span_id, part_id, start, end) where a span and a part of one recording overlap by more than ``least``.

    Both sides are dealt to the buckets of ``width`` they touch, an equality join, and a pair counts in the bucket where
    its overlap begins.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width).cast("long"), F.floor(F.col(b) / width).cast("long")))
    s = spans.select("recording", "span_id", F.col("start").alias("s0"), F.col("end").alias("s1"), cells("start", "end").alias("cell"))
    p = bounds.select("recording", "part_id", F.col("start").alias("p0"), F.col("end").alias("p1"), cells("start", "end").alias("cell"))
    start, end = F.greatest("s0", "p0"), F.least("s1", "p1")
    return s.join(p, ["recording", "cell"]).filter((start < end - least) & (F.floor(start / width) == F.col("cell"))).select("recording", "span_id", "part_id", start.alias("start"), end.alias("end"))
