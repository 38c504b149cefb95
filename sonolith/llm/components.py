"""Connected components over an edge list, by alternating large-star and small-star steps.

Each step is a minimum per vertex (pre-aggregated) joined back to the edges, so no vertex's edges are gathered; the
number of steps grows with the logarithm of the component size. Edges are written to the checkpoint folder after each
round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame) -> DataFrame:
    """(v, m): each neighbour v of a vertex u led to the least of u and its neighbours, over edges u -> v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


#: Edges for each partition; fewer than that are led home in one task, without a shuffle.
EDGES = 15_000


def _both_ways(edges: DataFrame) -> DataFrame:
    ahead, back = F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    return edges.select(F.inline(F.array(ahead, back)))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every id of ``edges`` (columns a and b of one integer type, in any order and direction) the least id of its component."""
    e = cut(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", "u"))).first()
        e = e.coalesce(state[0] // EDGES + 1)
        if state == before:
            return e.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("component")), F.struct(F.col("v").alias("id"), F.col("v").alias("component"))))).distinct()
        before = state
        large = _star(_both_ways(e)).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        s = _star(large)
        own = F.struct("u", F.col("m").alias("v"))
        e = cut(s.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), own))).filter("u != v").distinct())


def cells(members: DataFrame, member: str, part: int = 512) -> DataFrame:
    """``members`` (grp, label and others) of groups of several labels, each group cut into cells of two parts of about ``part`` members.

    Every member outside the label with most members (odd) meets every other member of its group in some cell, so a group
    that is one component but for a few members has about as many rows as members.
    """
    sizes = members.groupBy("grp", "label").count()
    of = sizes.groupBy("grp").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("most"))
    parts = lambda c: F.ceil(c / F.lit(float(part))).cast("int")
    of = of.filter("most < n").select("grp", "main", parts(F.col("n") - F.col("most")).alias("odds"), parts(F.col("most")).alias("mains"))
    m = members.join(of, "grp").withColumn("odd", F.col("label") != F.col("main"))
    m = m.withColumn("own", F.pmod(F.xxhash64(member), F.when(F.col("odd"), F.col("odds")).otherwise(F.col("mains"))).cast("int"))
    # cell (i, j) holds odd part i, and main part j or, beyond those, odd part j - mains
    rows = F.transform(F.sequence(F.lit(0), F.col("mains") + F.col("odds") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("odd")))
    column = F.when(F.col("odd"), F.col("mains") + F.col("own")).otherwise(F.col("own"))
    columns = F.transform(F.sequence(F.lit(0), F.col("odds") - 1), lambda i: F.struct(i.alias("i"), column.alias("j"), F.lit(False).alias("odd")))
    placed = m.withColumn("_at", F.explode(F.when(F.col("odd"), F.concat(rows, columns)).otherwise(columns)))
    return placed.select(*members.columns, (F.col("_at.i").cast("long") * F.lit(1 << 31) + F.col("_at.j")).alias("cell"), F.col("_at.odd").alias("odd"))
