"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns a unit vector by ``rounds`` fast Hadamard pseudo-rotations (random signs, then a Walsh-Hadamard
transform) and assigns it to the nearest signed axis; as many turned copies are taken together as it needs for buckets
of about ``fill`` vectors, so their number follows the rows. A query probes, in each table, the buckets whose axes cost
it no more than a bound: the sum over the copies of the squared distance between its largest coordinate and the one on
that axis. The bound is fitted on ``fit`` queries, whose exact neighbours among all vectors are found in one pass, so that
``recall`` of them are probed. Candidates are reranked by their exact cosine, and per query the best ``k`` stay.

The axes of a vector's copies make its code, one number, and a table's codes are packed in order into as many cells as give
each about ``block`` vectors; so a vector travels once a table (and once for each ``calls`` queries of its cell), and a query
travels to the cells that hold a code within its bound. A cell that holds more than ``block`` vectors or ``calls``
queries is dealt in parts, so one that has a third of all rows is many tasks. Within a task only the buckets that a query
probes are scored for it, and its k best leave. A query that finds fewer than k probes within four times the bound, and one
that is short even so every bucket of one table, which is exact for it.

Defined results: vectors that are null, of norm zero, of another length than most, or that hold null or non-finite
components take no part; equal scores go to the smaller vec_id; a query has all candidates if they are fewer than k;
rows that repeat a vec_id are one candidate each, but never their own query's neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x


def rotations(d: int, tables: int, copies: int, rounds: int, seed: int) -> np.ndarray:
    """The random signs: tables x copies x rounds x the next power of two."""
    width = 1 << max(1, (d - 1).bit_length())
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), size=(tables, copies, rounds, width))


def turned(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Unit vectors by one pseudo-rotation, and their opposites beside them: column i is the axis i, i + width its opposite."""
    width = signs.shape[1]
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for s in signs:
        y = _hadamard(y * s) / math.sqrt(width)
    return np.concatenate((y, -y), axis=1)


def costs(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """What each signed axis costs a query."""
    y = turned(x, signs)
    return (y.max(axis=1, keepdims=True) - y) ** 2


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of the vectors that take part, as they are."""
    v = F.col(embedding)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(vec_id).isNotNull() & v.isNotNull() & fine).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))


def _unit(column: pd.Series) -> np.ndarray:
    """The vectors in double precision and of unit length; divided by the largest component first, so that no square overflows or vanishes."""
    x = np.stack(column.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _firsts(r: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best of each query r, best first, an id once, ties by id."""
    o = np.lexsort((-score, ids, r))
    o = o[np.r_[True, (r[o][1:] != r[o][:-1]) | (ids[o][1:] != ids[o][:-1])]] if len(o) else o
    o = o[np.lexsort((ids[o], -score[o], r[o]))]
    return o[np.arange(len(o)) - np.searchsorted(r[o], r[o]) < k]


def _best(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, vector's place, score) of the k best of each query that reach its ``floor``, ties by id; ``ids`` ascend."""
    score = q @ x.T
    score[qids[:, None] == ids[None, :]] = -np.inf
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    single = score if len(first) == len(ids) else np.maximum.reduceat(score, first, axis=1)
    # a rounding apart from the k-th best may be a tie, so those stay too until the exact score is known
    at = single.shape[1] - k
    kth = np.maximum(np.partition(single, at, axis=1)[:, at] if at > 0 else np.full(len(score), -np.inf), floor)
    r, c = np.nonzero((score >= kth[:, None] - 1e-12) & (score > -np.inf))
    exact = (q[r] * x[c]).sum(axis=1)
    o = _firsts(r, ids[c], exact, k)
    return r[o], c[o], exact[o]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)


_FOUND = "query_id long, vec_id long, score double"


def _fitted(base: DataFrame, asked: DataFrame, signs: np.ndarray, k: int, fit: int, recall: float) -> float:
    """The bound on costs that leads ``fit`` queries to ``recall`` of their exact neighbours."""
    sample = asked.orderBy(F.xxhash64("id"), "id").limit(fit).toPandas()
    if not len(sample):
        return 0.0
    qids, q = sample["id"].to_numpy(), _unit(sample["v"])

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                order = np.argsort(pdf["id"].to_numpy(), kind="stable")
                ids, x = pdf["id"].to_numpy()[order], _unit(pdf["v"])[order]
                r, c, score = _best(ids, x, qids, q, k)
                yield pd.DataFrame({"query_id": qids[r], "vec_id": ids[c], "score": score, "v": pdf["v"].to_numpy()[order][c]})

    near = _ranked(base.mapInPandas(exact, f"{_FOUND}, v {base.schema['v'].dataType.simpleString()}"), k).toPandas()  # fit * k rows
    if not len(near):
        return 0.0
    x, own = _unit(near["v"]), np.searchsorted(np.sort(qids), near["query_id"].to_numpy())
    q = q[np.argsort(qids, kind="stable")]
    best = np.full(len(near), np.inf)
    for table in signs:
        cost = sum(costs(q, s)[own, turned(x, s).argmax(axis=1)] for s in table)
        best = np.minimum(best, cost)
    return float(np.quantile(best, recall, method="higher")) + 1e-9


def _codes(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The code of each vector: the axes of its copies as digits."""
    code = np.zeros(len(x), np.int64)
    for s in table:
        code = code * (2 * table.shape[2]) + turned(x, s).argmax(axis=1)
    return code


def _within(x: np.ndarray, table: np.ndarray, cells: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(query's place, cell) of the cells, ranges of codes, whose cheapest code costs the query at most ``bound``; ``cells`` is a power of two."""
    at, cell, spent = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    for s in table:
        digits = min(cells, 2 * table.shape[2])
        if digits == 1:
            break
        cost = costs(x, s).reshape(len(x), digits, -1).min(axis=2)
        total = spent[:, None] + cost[at]
        r, c = np.nonzero(total <= bound)
        at, cell, spent, cells = at[r], cell[r] * digits + c, total[r, c], cells // digits
    return at, cell


def _search(base: DataFrame, asked: DataFrame, signs: np.ndarray, bound: float, k: int, cells: int, block: int, calls: int, seed: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query in each part of the cells it probes."""
    axes, copies = 2 * signs.shape[3], signs.shape[1]
    wide = axes**copies // cells

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _unit(pdf["v"])
                for t, table in enumerate(signs):
                    yield pd.DataFrame({"bucket": t * cells + _codes(x, table) // wide, "id": pdf["id"], "v": pdf["v"]})

    def probing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f in range(0, len(pdf), 256):
                x, ids, own = _unit(pdf["v"][f : f + 256]), pdf["id"].to_numpy()[f : f + 256], pdf["v"].to_numpy()[f : f + 256]
                for t, table in enumerate(signs):
                    r, c = _within(x, table, cells, bound)
                    yield pd.DataFrame({"bucket": t * cells + c, "id": ids[r], "v": own[r]})

    kind = base.schema["v"].dataType.simpleString()
    mine, theirs = (rows.mapInPandas(f, f"bucket long, id long, v {kind}") for rows, f in ((base, dealt), (asked, probing)))

    def parts(rows: DataFrame, most: int, name: str) -> DataFrame:
        return cut(rows.groupBy("bucket").count().select("bucket", F.ceil(F.col("count") / F.lit(float(most))).cast("int").alias(name)))

    # a row for each cell that is probed: small beside the vectors, and broadcast only where it is counted to be
    sizes = broadcast_if_small(cut(parts(mine.select("bucket"), block, "blocks").join(parts(theirs.select("bucket"), calls, "calls"), "bucket")))
    part = lambda n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = mine.join(sizes, "bucket").select("bucket", part("blocks").alias("i"), spread("calls").alias("j"), "id", "v")
    theirs = theirs.join(sizes, "bucket").select("bucket", spread("blocks").alias("i"), part("calls").alias("j"), "id", "v")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        r, ids_, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(left) and len(right):
            table = signs[int(left["bucket"].iloc[0]) // cells]
            x, q, qids = _unit(left["v"]), _unit(right["v"]), right["id"].to_numpy()
            code = _codes(x, table)
            order = np.lexsort((left["id"].to_numpy(), code))
            ids, x, code = left["id"].to_numpy()[order], x[order], code[order]
            cost, floor, new, held = [costs(q, s) for s in table], np.full(len(q), -np.inf), [], 0
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            for f, e in zip(first, np.r_[first[1:], len(code)], strict=True):
                total, c = np.zeros(len(q)), int(code[f])
                for own in reversed(cost):
                    total += own[:, c % axes]
                    c //= axes
                at = np.flatnonzero(total <= bound)
                for i in range(0, len(at), 512):
                    own = at[i : i + 512]
                    near, c_, s_ = _best(ids[f:e], x[f:e], qids[own], q[own], k, floor[own])
                    new.append((own[near], ids[f + c_], s_))
                    held += len(near)
                if held > 4 * k * len(q) + 10_000 or e == len(code):  # the k best so far stay, and what they reach is asked of later buckets
                    r, ids_, score = (np.concatenate(z) for z in zip((r, ids_, score), *new, strict=True))
                    o = _firsts(r, ids_, score, k)
                    r, ids_, score, new, held = r[o], ids_[o], score[o], [], 0
                    last = np.flatnonzero(np.bincount(r, minlength=len(q)) == k)
                    floor[last] = score[np.searchsorted(r, last, side="right") - 1]
            r = qids[r]
        return pd.DataFrame({"query_id": r, "vec_id": ids_, "score": score})

    return mine.groupBy("bucket", "i", "j").cogroup(theirs.groupBy("bucket", "i", "j")).applyInPandas(best, _FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = 12, rounds: int = 3, fill: int = 8, fit: int = 64, recall: float = 0.95, block: int = 8192, calls: int = 16_384, seed: int = 20_001, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): per row of ``queries`` (columns as ``vectors``) its ``k`` nearest found."""
    base, asked = _usable(vectors, vec_id, embedding), _usable(queries, vec_id, embedding)
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d, n = (sizes[0]["d"], sizes[0]["count"]) if sizes else (1, 1)
    base, asked = base.filter(F.size("v") == d), asked.filter(F.size("v") == d)
    width = 1 << max(1, (d - 1).bit_length())
    copies = max(1, math.ceil(math.log(max(n / fill, 1.0)) / math.log(2 * width)))
    signs = rotations(d, tables, copies, rounds, seed)
    cells = min((2 * width) ** copies, 1 << max(0, math.ceil(math.log2(max(n / block, 1.0)))))
    bound = _fitted(base, asked, signs, k, fit, recall)

    def best(asked: DataFrame, signs: np.ndarray, bound: float) -> DataFrame:
        return _search(base, asked, signs, bound, k, cells, block, calls, seed).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    found = cut(best(asked, signs, bound))
    for tables_, wider in ((signs, 4 * bound), (signs[:1], math.inf)):
        full = found.groupBy("query_id").count().filter(F.col("count") >= k).select("query_id")
        short = cut(asked.join(full, F.col("id") == F.col("query_id"), "left_anti"))
        if not short.limit(1).count():
            break
        found = cut(found.unionByName(best(short, tables_, wider)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
