"""How far the windows of a recording agree: votes, folded tempo, pulse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windowed_vote(df: DataFrame, recording: str, time: Column, label: str, size: float) -> DataFrame:
    """Per recording the label most windows hold, ties to the earliest, its share (null with one window) and their number."""
    n = df.groupBy(recording, F.floor(time / size).cast("long").alias("win"), label).agg(F.count("*").alias("n"))
    per_window = Window.partitionBy(recording, "win").orderBy(F.desc("n"), label)
    votes = n.withColumn("_r", F.row_number().over(per_window)).filter("_r = 1")
    counts = votes.groupBy(recording, label).agg(F.count("*").alias("n"), F.min("win").alias("first"))
    top = Window.partitionBy(recording).orderBy(F.desc("n"), "first")
    c = counts.withColumn("_r", F.row_number().over(top)).withColumn("t", F.sum("n").over(Window.partitionBy(recording))).filter("_r = 1")
    return c.select(recording, F.col(label).alias("modal"), F.when(F.col("t") > 1, F.round(F.col("n") / F.col("t"), 3)).alias("agreement"), F.col("t").alias("n_windows"))


#: Sums run in any order, so values this close, relatively, are ties.
_TIE = 1e-11


def folded_tempo(df: DataFrame, recording: str, tempo: str, tolerance: float = 0.02) -> DataFrame:
    """Per recording the median window tempo, octaves folded towards the median first, and the share of windows near it.

    A tempo just at a bound is neither folded nor near, whatever the order in which it was summed; windows without a tempo count as not near.
    """
    own = Window.partitionBy(recording)
    t, m = F.col(tempo), F.col("_m")
    folded = F.when(t < m / 1.5 * (1 - _TIE), t * 2).when(t > m * 1.5 * (1 + _TIE), t / 2).otherwise(t)
    f = df.select(recording, tempo, F.median(tempo).over(own).alias("_m")).select(recording, folded.alias("_t"))
    near = F.abs(F.col("_t") - F.col("_mid")) / F.greatest("_mid", F.lit(1e-9)) < tolerance * (1 - _TIE)
    g = f.withColumn("_mid", F.median("_t").over(own)).withColumn("_near", F.coalesce(near, F.lit(False)).cast("double"))
    g = g.groupBy(recording).agg(F.max("_mid").alias("tempo"), F.avg("_near").alias("a"), F.count("*").alias("n_windows"))
    # shares are rounded as they stand times 1000
    return g.select(recording, "tempo", F.when(F.col("n_windows") > 1, F.round(F.col("a") * 1000) / 1000).alias("agreement"), "n_windows")


def pulse(df: DataFrame, recording: str, time: Column, weight: Column, periods: list[float]) -> DataFrame:
    """Per recording the period among ``periods`` of the largest weighted resultant of phases, the first of equals, and R."""
    angle = lambda p: time * (2 * 3.141592653589793) / p
    sums = df.groupBy(F.col(recording).alias("recording")).agg(F.sum(weight).alias("w"), *[f(weight * g(angle(p))).alias(f"{n}{i}") for i, p in enumerate(periods) for n, f, g in (("c", F.sum, F.cos), ("s", F.sum, F.sin))])
    r = [F.sqrt(F.col(f"c{i}") * F.col(f"c{i}") + F.col(f"s{i}") * F.col(f"s{i}")) / F.col("w") for i in range(len(periods))]
    best = reduce(lambda acc, x: F.when(F.round(x["R"], 9) > F.round(acc["R"], 9), x).otherwise(acc), [F.struct(F.lit(p).alias("period"), x.alias("R")) for p, x in zip(periods, r, strict=True)])
    return sums.select("recording", best.alias("b")).select("recording", "b.period", "b.R")
