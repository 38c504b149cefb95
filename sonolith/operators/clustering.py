"""Principal components from one pass of sums, and k-means with a chosen number of clusters."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import silhouettes
from .corpus import zscore


def pca(df: DataFrame, features: list[str], keep: list[str], k: int = 2) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(``keep`` and pc1..pck, explained shares, loadings). Only the Gram matrix of the features reaches the driver; of each component the largest loading is positive."""
    z = zscore(df, features)
    cols = [f"z_{c}" for c in features]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = z.agg(F.count("*").alias("n"), *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(c).alias(f"m_{c}") for c in cols]).first()
    gram = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = (row[f"g{i}_{j}"] or 0) - (row[f"m_{cols[i]}"] or 0) * (row[f"m_{cols[j]}"] or 0) / max(1, row["n"])
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values)
    values, loadings = np.maximum(values[order], 0), vectors[:, order].T
    loadings *= np.sign(loadings[np.arange(len(loadings)), np.abs(loadings).argmax(axis=1)])[:, None]
    coords = [sum((F.col(c) * float(w) for c, w in zip(cols, loadings[p], strict=True)), F.lit(0.0)) for p in range(k)]
    return z.select(*keep, *[F.round(c, 3).alias(f"pc{p + 1}") for p, c in enumerate(coords)]), values[:k] / max(values.sum(), 1e-12), loadings[:k]


def kmeans_sweep(df: DataFrame, ids: str, features: list[str], ks: Iterable[int] | None = None, seed: int = 0) -> DataFrame:
    """(ids, cluster, k, silhouette) for the k of the best silhouette over all rows, the first of equals; ks (2 to 8, or fewer than the rows) that leave a cluster empty are passed over.

    All numbers of clusters are judged in one pass over the distances of blocks of rows.
    """
    z = zscore(df, features).select(ids, *[f"z_{c}" for c in features])
    v = VectorAssembler(inputCols=[f"z_{c}" for c in features], outputCol="_v").transform(z).persist(StorageLevel.DISK_ONLY)
    out, tried = v, []
    for k in ks or range(2, min(9, v.count())):
        done = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=f"_k{k}").fit(v).transform(out)
        if done.select(f"_k{k}").distinct().count() == k:
            out, tried = done, [*tried, k]
    if not tried:
        raise ValueError("every number of clusters left one empty")
    rows = out.select(ids, F.array(*[f"z_{c}" for c in features]).alias("_a"), F.array(*[F.col(f"_k{k}").cast("string") for k in tried]).alias("_l"))
    score = {r["which"]: r["silhouette"] for r in silhouettes(rows, ids, "_a", "_l").collect()}
    best = max(range(len(tried)), key=lambda i: (round(score.get(i, -1.0), 9), -i))
    return out.select(ids, F.col(f"_k{tried[best]}").alias("cluster"), F.lit(tried[best]).alias("k"), F.round(F.lit(float(score.get(best, 0.0))), 6).alias("silhouette"))
