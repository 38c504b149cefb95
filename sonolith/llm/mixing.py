"""Mixing sources to target weights.

Words are summed per source, the weights share out all words by water-filling under a cap of ``most`` times each source,
and each document is emitted floor(rate) times plus one Bernoulli copy, seeded by a hash of its doc_id, whose probability
is the fraction of its source's rate. A document's copies depend on its id and its source's rate alone, so nothing is
sorted or gathered.

Defined results: null or empty texts have size 0 and take 0 words; a null source is a source of its own, ordered last;
rows that repeat a doc_id draw alike, as do all rows without one; without any words every target is 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_rows, broadcast_if_small, cut

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Runs of non-space characters; null gives 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) made of the MD5 of the parts, the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _ranked(sources: DataFrame, weights: list[int]) -> DataFrame:
    """Adds ``weight``: the sources in code point order, null last, get the weights in turn.

    The rank is counted by leading byte pairs, so that no task holds all sources: offsets of at most 65,537 prefixes are
    summed, and each prefix is ranked on its own.
    """
    prefix = F.when(F.col("source").isNull(), F.lit("~")).otherwise(F.rpad(F.hex(F.substring(F.encode("source", "utf-8"), 1, 2)), 4, "0"))
    s = sources.withColumn("_p", prefix)
    counts = s.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(F.hex(F.encode("source", "utf-8")).asc_nulls_last()))
    rank = F.col("_before") + F.col("_own") - 1
    weight = reduce(lambda acc, x: F.when(F.pmod(rank, F.lit(len(weights))) == x[0], F.lit(x[1])).otherwise(acc), list(enumerate(weights))[1:], F.lit(weights[0]))
    return s.withColumn("_own", own).join(offsets, "_p").select("source", "source_size", weight.cast("long").alias("weight"))


def targets(sources: DataFrame, weights: list[int], most: int = 3) -> DataFrame:
    """(source, source_size, weight, target): the level at which the capped shares sum to all words.

    Each round sums what is left for the sources not yet at their cap; only those sums reach the driver.
    """
    s = cut(_ranked(sources, weights))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    cap = F.lit(most) * F.col("source_size")
    level, before = 0.0, -1
    while total:
        capped = cap.cast("double") <= F.lit(level) * F.col("weight")
        row = s.agg(F.sum(F.when(capped, cap).otherwise(0)).alias("held"), F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("open"), F.sum(capped.cast("int")).alias("n")).first()
        if row["n"] == before or not row["open"]:
            break
        level, before = (total - row["held"]) / row["open"], row["n"]
    return s.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight").cast("double")))


def mix(docs: DataFrame, weights: list[int], most: int = 3, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken (size times copies) and the whole row as r."""
    row = F.col("r")
    d = as_rows(docs).select(row[doc_id].alias("doc_id"), row[source].alias("source"), word_count(row[text]).alias("size"), "r")
    sources = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    rated = targets(sources, weights, most).select(
        F.col("source").alias("_s"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )
    u = _uniform(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    j = d.join(broadcast_if_small(cut(rated)), F.col("source").eqNullSafe(F.col("_s")))
    extra = (u < F.col("rate") - F.floor("rate")).cast("long")
    out = j.withColumn("copies", F.floor("rate").cast("long") + extra)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "r")


def emit(docs: DataFrame, weights: list[int], most: int = 3, **names) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, numbered by the column mix_copy from 1."""
    out = mix(docs, weights, most, **names).filter("copies > 0")
    return out.select("r.*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("mix_copy"))
