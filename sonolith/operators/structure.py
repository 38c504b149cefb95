"""Structure of recordings as tables: similarity between frames, repeats, keys by width, colours, envelopes and stereo.

Frames are a long table (recording, frame from 0, and columns). Everything is a window, a join on (recording, frame) or an
aggregate; none gathers a recording, so cost grows with the frames and the lags or widths asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import circular


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def _dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def self_similarity(frames: DataFrame, vector: str, most_lag: int) -> DataFrame:
    """(recording, frame, lag, sim): cosine of each frame with those up to ``most_lag`` frames on; a frame of norm 0 is like nothing."""
    v = frames.select("recording", "frame", F.col(vector).alias("x")).withColumn("n", F.sqrt(_dot(F.col("x"), F.col("x"))))
    ahead = v.select("recording", F.col("x").alias("y"), F.col("n").alias("m"), "frame", F.explode(F.sequence(F.lit(1), F.lit(most_lag))).alias("lag"))
    ahead = ahead.withColumn("frame", F.col("frame") - F.col("lag"))
    length = F.col("n") * F.col("m")
    sim = F.when(length > 0, _dot(F.col("x"), F.col("y")) / F.when(length > 0, length)).otherwise(0.0)
    return v.join(ahead, ["recording", "frame"]).select("recording", "frame", "lag", sim.alias("sim"))


def repeat_runs(similar: DataFrame, least_sim: float, least_run: int, least_lag: int) -> DataFrame:
    """(recording, lag, start, length): runs of neighbouring frames that all are more alike than ``least_sim`` to those ``lag`` frames on."""
    s = similar.filter((F.col("lag") >= least_lag) & (F.col("sim") > least_sim))
    island = F.col("frame") - F.row_number().over(Window.partitionBy("recording", "lag").orderBy("frame"))
    runs = s.withColumn("_g", island).groupBy("recording", "lag", "_g").agg(F.min("frame").alias("start"), F.count("*").alias("length"))
    return runs.filter(F.col("length") >= least_run).select("recording", "lag", "start", "length")


def keyscape(frames: DataFrame, chroma: list[Column], widths: list[int]) -> DataFrame:
    """(recording, width, frame, key, conf): the key of every ``width`` frames from ``frame`` on."""
    f = frames.select("recording", "frame", *[c.alias(f"c{i}") for i, c in enumerate(chroma)])
    order = Window.partitionBy("recording").orderBy("frame")
    before = f.select("recording", "frame", F.count("*").over(Window.partitionBy("recording")).alias("n"), *[F.sum(f"c{i}").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(f"c{i}") for i in range(12)])
    start = before.select("recording", "frame", "n", *[(F.col(f"c{i}") - F.lag(f"c{i}", 1, 0.0).over(order)).alias(f"o{i}") for i in range(12)], *[F.col(f"c{i}").alias(f"c{i}") for i in range(12)])
    start = start.select("recording", "frame", "n", *[(F.col(f"c{i}") - F.col(f"o{i}")).alias(f"s{i}") for i in range(12)], F.explode(F.array(*[F.lit(w) for w in widths])).alias("width"))
    end = before.select("recording", F.col("frame").alias("last"), *[f"c{i}" for i in range(12)])
    spans = start.filter(F.col("frame") + F.col("width") <= F.col("n")).withColumn("last", F.col("frame") + F.col("width") - 1).join(end, ["recording", "last"])
    return circular.key_estimate(spans, [(F.col(f"c{i}") - F.col(f"s{i}")) / F.col("width") for i in range(12)], ["recording", "width", "frame"])


def barcode(frames: DataFrame, chroma: list[Column], level: str) -> DataFrame:
    """(recording, frame, hue, saturation, value): the angle of a frame's fifths resultant, its length, and its level against the 95th percentile."""
    angle, r = circular.fifths(chroma)
    top = frames.groupBy(F.col("recording").alias("_rec")).agg(F.percentile(level, 0.95).alias("_p"))
    j = frames.join(top, F.col("recording") == F.col("_rec"))
    hue = F.pmod(angle / (2 * math.pi), F.lit(1.0))
    loud = F.col(level) / F.greatest("_p", F.lit(1e-12))
    clip = lambda x, lo: F.greatest(F.lit(lo), F.least(F.lit(1.0), x))
    return j.select("recording", "frame", hue.alias("hue"), clip(1.6 * r, 0.0).alias("saturation"), F.pow(clip(loud, 0.12), F.lit(0.6)).alias("value"))


def envelope(samples: DataFrame, position: str, value: str, blocks: int) -> DataFrame:
    """(recording, block, peak): the largest absolute value in each of ``blocks`` equal stretches of a recording."""
    n = samples.groupBy(F.col("recording").alias("_rec")).agg((F.max(position) + 1).alias("_n"))
    step = F.greatest(F.floor(F.col("_n") / F.lit(blocks)), F.lit(1))
    b = samples.join(n, F.col("recording") == F.col("_rec")).withColumn("block", F.floor(F.col(position) / step).cast("long")).filter(F.col("block") < blocks)
    return b.groupBy("recording", "block").agg(F.max(F.abs(F.col(value))).alias("peak"))


def stereo(frames: DataFrame, left: Column, right: Column) -> DataFrame:
    """(recording, frame, width, correlation): the side's share of energy, and Pearson's r of the channels; null for a silent or constant channel."""
    f = frames.select("recording", "frame", left.alias("l"), right.alias("r")).withColumn("n", F.size("l").cast("double"))
    f = f.withColumns({"sl": _total(F.col("l")), "sr": _total(F.col("r")), "ll": _dot(F.col("l"), F.col("l")), "rr": _dot(F.col("r"), F.col("r")), "lr": _dot(F.col("l"), F.col("r"))})
    side, mid = F.col("ll") + F.col("rr") - 2 * F.col("lr"), F.col("ll") + F.col("rr") + 2 * F.col("lr")
    spread = F.sqrt(F.greatest((F.col("n") * F.col("ll") - F.col("sl") * F.col("sl")) * (F.col("n") * F.col("rr") - F.col("sr") * F.col("sr")), F.lit(0.0)))
    r = (F.col("n") * F.col("lr") - F.col("sl") * F.col("sr")) / F.when(spread > 1e-12, spread)
    return f.select("recording", "frame", (side / F.when(side + mid > 0, side + mid)).alias("width"), r.alias("correlation"))


def pan(frames: DataFrame, left: Column, right: Column, bands: int) -> DataFrame:
    """(recording, band, pan): (R - L) / (R + L) of the energies in each of ``bands`` equal stretches of the spectrum, summed over a recording."""
    f = frames.select("recording", F.posexplode(F.arrays_zip(left.alias("l"), right.alias("r"))).alias("bin", "x"), F.size(left).alias("n"))
    b = f.groupBy("recording", F.floor(F.col("bin") * bands / F.col("n")).cast("long").alias("band")).agg(F.sum(F.col("x.l") * F.col("x.l")).alias("l"), F.sum(F.col("x.r") * F.col("x.r")).alias("r"))
    both = F.col("l") + F.col("r")
    return b.select("recording", "band", ((F.col("r") - F.col("l")) / F.when(both > 0, both)).alias("pan"))


def trajectory(frames: DataFrame, columns: list[str], reach: int) -> DataFrame:
    """``columns`` standardised within a recording (constant ones to 0) and smoothed over ``reach`` frames to each side."""
    own, near = Window.partitionBy("recording"), Window.partitionBy("recording").orderBy("frame").rowsBetween(-reach, reach)
    z = lambda c: (F.col(c) - F.avg(c).over(own)) / (F.stddev_pop(c).over(own) + 1e-12)
    return frames.select("recording", "frame", *[z(c).alias(c) for c in columns]).select("recording", "frame", *[F.avg(c).over(near).alias(c) for c in columns])


def moving_median(frames: DataFrame, value: str, reach: int) -> DataFrame:
    """(recording, frame, smooth): the median over ``reach`` frames to each side; the window shrinks at the ends."""
    near = Window.partitionBy("recording").orderBy("frame").rowsBetween(-reach, reach)
    s, half = F.array_sort("_v"), (F.size("_v") / 2).cast("int")
    mid = F.when(F.size("_v") % 2 == 1, F.element_at(s, half + 1)).otherwise((F.element_at(s, F.greatest(half, F.lit(1))) + F.element_at(s, half + 1)) / 2)
    return frames.withColumn("_v", F.collect_list(value).over(near)).filter(F.size("_v") > 0).select("recording", "frame", mid.alias("smooth"))


def interpolated(frames: DataFrame, value: str) -> DataFrame:
    """(recording, frame, value): frames that are missing between two others, on the straight line between them."""
    order = Window.partitionBy("recording").orderBy("frame")
    n = frames.select("recording", "frame", F.col(value).alias("v"), F.lead("frame").over(order).alias("f2"), F.lead(value).over(order).alias("v2"))
    at = n.withColumn("at", F.explode(F.sequence(F.col("frame"), F.coalesce(F.col("f2") - 1, F.col("frame")))))
    line = F.col("v") + F.coalesce(F.col("v2") - F.col("v"), F.lit(0.0)) * (F.col("at") - F.col("frame")) / F.coalesce(F.col("f2") - F.col("frame"), F.lit(1))
    return at.select("recording", F.col("at").alias("frame"), line.alias("value"))


def pooled(frames: DataFrame, step: int, columns: list[str]) -> DataFrame:
    """Means over every ``step`` frames; a last stretch that isn't whole is dropped."""
    g = frames.groupBy("recording", F.floor(F.col("frame") / step).cast("long").alias("bucket")).agg(F.count("*").alias("_n"), *[F.avg(c).alias(c) for c in columns])
    return g.filter(F.col("_n") == step).drop("_n")


def export_plan(spans: DataFrame, files: DataFrame, exclude: list[str], least: float = 0.05) -> DataFrame:
    """(recording, file, label, start, end, name): the pieces of spans to cut from each file, spans of excluded labels aside, named by the span's minutes.

    ``spans`` are (recording, label, start, end), ``files`` (recording, file, start, end), in seconds on one clock.
    """
    clock = lambda s: F.format_string("%02d%02d", F.floor(s / 60).cast("int"), F.pmod(F.floor(s).cast("int"), F.lit(60)))
    f = files.withColumnsRenamed({"start": "f0", "end": "f1"})
    j = spans.filter(~F.col("label").isin(exclude)).join(f, "recording").withColumns({"a": F.greatest("start", "f0"), "b": F.least("end", "f1")}).filter(F.col("b") - F.col("a") > least)
    name = F.concat(clock(F.col("start")), F.lit("-"), clock(F.col("end")), F.lit(" "), F.col("label"))
    return j.select("recording", "file", "label", (F.col("a") - F.col("f0")).alias("start"), (F.col("b") - F.col("f0")).alias("end"), name.alias("name"))


def timeline(frames: DataFrame, level: str) -> DataFrame:
    """(recording, frame, amplitude): the level between a recording's 2nd and 98th percentile, from 0 to 1."""
    ends = frames.groupBy(F.col("recording").alias("_rec")).agg(F.percentile(level, 0.02).alias("_lo"), F.percentile(level, 0.98).alias("_hi"))
    a = (F.col(level) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12))
    return frames.join(ends, F.col("recording") == F.col("_rec")).select("recording", "frame", F.greatest(F.lit(0.0), F.least(F.lit(1.0), a)).alias("amplitude"))


def first_of_each(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_i") <= n).drop("_i")
