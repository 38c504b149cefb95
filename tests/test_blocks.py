"""Block products against plain loops, and what is built on them."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonolith.operators import blocks, corpus
from sonolith.operators.clustering import kmeans_sweep
from sonolith.operators.segments import absorb


def plain_silhouette(x, labels):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    out = []
    for i, own in enumerate(labels):
        mine = np.array([k == own and j != i for j, k in enumerate(labels)])
        if mine.any() and len(set(labels)) > 1:
            a, b = d[i, mine].mean(), min(d[i, [k == c for k in labels]].mean() for c in set(labels) - {own})
            out.append((b - a) / max(a, b, 1e-12))
    return np.mean(out) if out else 0.0, len(out)


@pytest.mark.parametrize("block", [7, 1000])
def test_silhouettes_of_several_labellings(spark, block):
    rng = np.random.default_rng(block)
    x = rng.standard_normal((60, 4))
    x[40] = x[41]
    first, second = [str(i % 3) for i in range(60)], ["alone" if i == 5 else str(i // 20) for i in range(60)]
    df = spark.createDataFrame([(i, [float(y) for y in v], [a, b, "one"]) for i, (v, a, b) in enumerate(zip(x, first, second, strict=True))], "id long, v array<double>, l array<string>")
    got = {r.which: (r.silhouette, r.n) for r in blocks.silhouettes(df, "id", "v", "l", block).collect()}
    for which, labels in ((0, first), (1, second)):
        value, n = plain_silhouette(x, labels)
        assert np.isclose(got[which][0], value) and got[which][1] == n
    assert 2 not in got
    dots = {(r.a, r.b): r.dot for r in blocks.products(df, "id", "v", block).collect()}
    assert len(dots) == 3600 and all(np.isclose(dots[i, j], x[i] @ x[j]) for i, j in dots)


def test_silhouette_edges(spark):
    df = spark.createDataFrame([(1, "a", [0.0]), (2, None, [1.0]), (3, "b", [2.0])], "id long, l string, v array<double>")
    assert tuple(corpus.silhouette(df, "id", "l", "v").first()) == (0.0, 0) and tuple(corpus.silhouette(df.filter("false"), "id", "l", "v").first()) == (0.0, 0)


def test_kmeans_finds_six_clusters(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0], [9, 0], [0, 9], [9, 9], [4.5, 20], [20, 4.5]])
    x = np.concatenate([c + 0.3 * rng.standard_normal((30, 2)) for c in centres])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    out = kmeans_sweep(df, "id", ["a", "b"]).toPandas().sort_values("id")
    assert set(out["k"]) == {6} and len(out) == 180
    assert all(g.nunique() == 1 for _, g in out["cluster"].groupby(np.arange(180) // 30))
    z = (x - x.mean(0)) / x.std(0)
    assert abs(out["silhouette"].iloc[0] - plain_silhouette(z, out["cluster"].tolist())[0]) < 1e-5


def test_numbered_by_parts(spark):
    values = random.Random(1).sample(range(100_000), 5000)
    df = spark.createDataFrame([(v,) for v in values], "x long").repartition(5)
    got = {r.x: r.place for r in corpus.numbered(df, "x", "place", 16).collect()}
    assert got == {v: i + 1 for i, v in enumerate(sorted(values))}
    assert corpus.numbered(df.filter("false"), "x", "place").count() == 0 and corpus.numbered(df.limit(1), "x", "place").first().place == 1


def plain_absorb(spans, least):
    """The first short span goes to its longer neighbour, again and again."""
    def fused(items):
        out = []
        for label, a, b in items:
            out[-1:] = [(label, out[-1][1], b)] if out and out[-1][0] == label else [*out[-1:], (label, a, b)]
        return out

    spans = fused(spans)
    while len(spans) > 1 and any(b - a < least for _, a, b in spans):
        i = next(i for i, (_, a, b) in enumerate(spans) if b - a < least)
        size = lambda k: spans[k][2] - spans[k][1] if 0 <= k < len(spans) else -1
        if size(i + 1) < 0 or size(i - 1) >= size(i + 1):
            spans[i - 1] = (spans[i - 1][0], spans[i - 1][1], spans[i][2])
        else:
            spans[i + 1] = (spans[i + 1][0], spans[i][1], spans[i + 1][2])
        spans = fused(spans[:i] + spans[i + 1 :])
    return spans


def test_absorb_against_repeated_scans():
    rng = random.Random(3)
    for _ in range(400):
        at, spans = 0, []
        for _ in range(rng.randrange(1, 30)):
            d = rng.choice([1, 2, 3, 4, 5, 6, 8, 12])
            spans.append((rng.choice("abc"), at, at + d))
            at += d
        pdf = pd.DataFrame([("r", *s) for s in spans], columns=["recording", "label", "start", "end"])
        for least in (3, 5, 9):
            assert [tuple(x[1:]) for x in absorb(pdf.sample(frac=1, random_state=1), least).to_numpy().tolist()] == plain_absorb(spans, least)


def test_affinity_by_blocks(spark):
    rng = np.random.default_rng(4)
    x, album = rng.standard_normal((40, 3)), [f"a{i % 5}" for i in range(39)] + ["single"]
    x[7] = 0
    df = spark.createDataFrame([(a, [float(y) for y in v]) for a, v in zip(album, x, strict=True)], "album string, v array<double>")
    u = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    s = u @ u.T
    got = {(r.album_a, r.album_b): r.affinity for r in corpus.album_affinity(df, "album", "v").collect()}
    assert len(got) == 36
    for a, b in got:
        pairs = [s[i, j] for i in range(40) for j in range(40) if album[i] == a and album[j] == b and i != j]
        if a != b or pairs:
            n = [k for k in range(40) if album[k] == a]
            want = np.mean(pairs) if a != b else (s[np.ix_(n, n)].sum() - (u[n] ** 2).sum()) / (len(n) * (len(n) - 1))
            assert np.isclose(got[a, b], want)
    assert got["single", "single"] == 1.0 and F


def test_components_against_numpy(spark):
    from sonolith.operators.clustering import pca

    rng = np.random.default_rng(5)
    x = rng.standard_normal((80, 2)) @ rng.standard_normal((2, 4)) + 0.2 * rng.standard_normal((80, 4))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double, d double")
    coords, explained, loadings = pca(df, list("abcd"), keep=["id"])
    z = (x - x.mean(0)) / x.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    v = vt[:2] * np.sign(vt[[0, 1], np.abs(vt[:2]).argmax(axis=1)])[:, None]
    assert np.allclose(loadings, v, atol=1e-6) and np.allclose(explained, (s**2 / (s**2).sum())[:2])
    got = coords.orderBy("id").toPandas()[["pc1", "pc2"]].to_numpy()
    assert np.allclose(got, z @ v.T, atol=6e-4)


def test_many_labellings_share_their_distances():
    import time

    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = rng.standard_normal((2304, 10))

    def seconds(labellings):
        labels = [[str(k % (w % 7 + 2)) for w in range(labellings)] for k in range(len(x))]
        held = blocks._Held()
        held.add(x[:2048], pa.array(labels[:2048]), False)
        held.held()
        rest = pa.array(labels[2048:])
        start = time.perf_counter()
        for _ in range(4):
            held.add(x[2048:], rest, True)
        return time.perf_counter() - start

    one, many = (min(seconds(n) for _ in range(5)) for n in (1, 40))
    assert many < 3.5 * one
