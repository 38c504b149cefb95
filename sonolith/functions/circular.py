"""Circular statistics and key estimates as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
# The Krumhansl-Schmuckler key profiles.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def resultant(cos_sum: Column, sin_sum: Column, weight: Column) -> Column:
    """Length of the weighted mean vector, 0 without weight."""
    return F.when(weight > 0, F.sqrt(cos_sum * cos_sum + sin_sum * sin_sum) / weight).otherwise(0.0)


def circular_sd(r: Column) -> Column:
    """sqrt(-2 ln R) in radians."""
    return F.sqrt(-2.0 * F.ln(F.greatest(r, F.lit(1e-12))))


def fifths(chroma: list[Column]) -> tuple[Column, Column]:
    """(angle, R) of twelve pitch-class weights on the circle of fifths."""
    angles = [2 * math.pi * (7 * k % 12) / 12 for k in range(12)]
    c = _sum([w * math.cos(a) for w, a in zip(chroma, angles, strict=True)])
    s = _sum([w * math.sin(a) for w, a in zip(chroma, angles, strict=True)])
    return F.atan2(s, c), resultant(c, s, _sum(chroma))


def fifths_note(angle: Column) -> Column:
    """The note nearest to an angle on the circle of fifths."""
    step = F.pmod(F.bround(angle * (12 / (2 * math.pi))).cast("int") * 7, F.lit(12))
    return F.element_at(F.array(*[F.lit(k) for k in KEYS]), step + 1)


def key_profiles() -> list[tuple[int, str, list[float]]]:
    """(order, name, profile) of the 24 keys: at each tonic the major before the minor."""
    out = []
    for i, tonic in enumerate(KEYS):
        for j, (mode, profile) in enumerate((("major", MAJOR), ("minor", MINOR))):
            out.append((2 * i + j, f"{tonic} {mode}", [profile[(p - i) % 12] for p in range(12)]))
    return out


def key_estimate(df: DataFrame, chroma: list[Column], keep: list[str]) -> DataFrame:
    """(keep, key, conf) of each row, without a shuffle: the best Pearson correlation of the chroma with one of 24 profiles; ("C major", -2) for constant chroma."""
    rows = []
    for order, name, profile in key_profiles():
        centred = [p - sum(profile) / 12 for p in profile]
        length = math.sqrt(sum(p * p for p in centred))
        rows.append(F.struct(F.lit(order).alias("o"), F.lit(name).alias("key"), F.array(*[F.lit(p / length) for p in centred]).alias("p")))
    c = df.select(*keep, F.array(*chroma).alias("_c")).withColumn("_m", F.aggregate("_c", F.lit(0.0), lambda a, x: a + x) / 12.0)
    c = c.withColumn("_c", F.transform("_c", lambda x: x - F.col("_m"))).withColumn("_n", F.sqrt(F.aggregate("_c", F.lit(0.0), lambda a, x: a + x * x)))

    def matched(k: Column) -> Column:
        dot = F.aggregate(F.zip_with("_c", k["p"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        r = F.when(F.col("_n") > 1e-12, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.when(F.col("_n") > 0, F.col("_n"))))).otherwise(-2.0)
        return F.struct(F.round(r, 9).alias("near"), (-k["o"]).alias("first"), k["key"].alias("key"), r.alias("r"))

    best = c.withColumn("_b", F.array_max(F.transform(F.array(*rows), matched)))
    return best.select(*keep, F.col("_b.key").alias("key"), F.col("_b.r").alias("conf"))


def tonal_spread(df: DataFrame, album: str, chroma: list[Column]) -> DataFrame:
    """Per album: R and sd (in steps of a fifth) of its tracks' unweighted tonal centres, and their number."""
    angle, _ = fifths(chroma)
    a = df.select(F.col(album).alias("album"), angle.alias("angle")).groupBy("album").agg(F.sum(F.cos("angle")).alias("c"), F.sum(F.sin("angle")).alias("s"), F.count("*").alias("n"))
    r = resultant(F.col("c"), F.col("s"), F.col("n"))
    return a.select("album", r.alias("R"), "n").select("album", "R", (circular_sd(F.col("R")) * (12 / (2 * math.pi))).alias("sd_fifths"), "n")
