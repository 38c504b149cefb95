"""Periodic runs, quality scores and the manifest: brute force, held-out labels and edges."""

import collections
import hashlib
import math
import os
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonolith.llm import line_dedup, manifest, ngram_join, quality, suffix_dedup
from sonolith.llm import queries as q
from sonolith.llm.periodic_runs import next_smaller, periodic_runs, runs_of

DIR = "/root/testdata/sf0.001"
EXTRA = ["r", "k", "pos", "n", "leaf", "runs", "_text", "text_", "score", "path", "_g"]


def plain_runs(s, shortest, times):
    best = {}
    for p in range(1, len(s) // times + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j > i and j + p - i >= max(shortest, times * p):
                best.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted(((a, b, p) for (a, b), p in best.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_every_period():
    rng = random.Random(4)
    for _ in range(1500):
        s = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(60))]
        if s and rng.random() < 0.6:
            s = s[: rng.randrange(len(s))] + s[: rng.randrange(1, 9)] * rng.randrange(1, 9) + s[rng.randrange(len(s)) :]
        after = [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) for i in range(len(s))]
        assert next_smaller(s)[0] == after
        for shortest, times in ((6, 4), (2, 2), (4, 3)):
            assert runs_of(s, shortest, times) == plain_runs(s, shortest, times)


class Letter(int):
    """A letter that counts how often letters are compared."""

    count = 0

    def __eq__(self, other):
        Letter.count += 1
        return int(self) == int(other)

    def __gt__(self, other):
        Letter.count += 1
        return int(self) > int(other)

    __hash__ = int.__hash__


@pytest.mark.parametrize("of", ["ones", "fibonacci", "blocks", "periods", "stairs", "random"])
def test_lyndon_pass_is_linear(of):
    rng, n = random.Random(5), 20_000
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    s = {"ones": [1] * n, "fibonacci": b[:n], "blocks": ([0] * 99 + [1]) * (n // 100), "periods": [rng.randrange(3) for _ in range(n // 9)] * 9, "stairs": [x for k in range(200) for x in [0] * k + [1]], "random": [rng.randrange(2) for _ in range(n)]}[of]
    for sign in (1, -1):
        Letter.count = 0
        next_smaller([Letter(sign * x) for x in s])
        assert Letter.count < 6 * len(s)


def test_periodic_runs_edges(spark):
    rows = [(1, "a b a b a b a b c"), (1, "a b a b a b a b c"), (2, ""), (3, None), (None, "x x x x x x x"), (4, " \n "), (5, "w " * 30_000), (6, "x x x x x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in EXTRA})
    out = periodic_runs(df).orderBy("doc_id")
    got = collections.Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in out.collect())
    assert got == collections.Counter({(1, 9, ((0, 8, 2),), "a b c"): 2, (2, 0, (), ""): 1, (3, 0, (), ""): 1, (None, 7, ((0, 7, 1),), "x"): 1, (4, 0, (), ""): 1, (5, 30_000, ((0, 30_000, 1),), "w"): 1, (6, 5, (), "x x x x x"): 1})
    assert {"r", "k", "_text"} <= set(out.columns) and periodic_runs(df.filter("false")).count() == 0
    assert periodic_runs(df, shortest=5, times=2).filter("doc_id = 6").first().collapsed == "x"


@pytest.mark.skipif(not os.path.exists(DIR), reason="no tables")
def test_quality_on_held_out_labels(spark):
    folder = DIR.replace("sf0.001", "sf0.01")
    out = q.op12_quality(spark, folder).toPandas().merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    held = out[out["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.97
    assert held.groupby("quality")["predicted"].mean()[1] > 0.98


def test_leader_against_plain_sums():
    """Weights after some steps equal those of the update rule written out for single places."""
    rng, own = np.random.default_rng(2), quality.Leader(np.zeros(6), np.zeros(6))
    z, n = [0.0] * 6, [0.0] * 6
    weight = lambda i: 0.0 if abs(z[i]) <= own.l1 else (math.copysign(own.l1, z[i]) - z[i]) / ((own.beta + math.sqrt(n[i])) / own.alpha + own.l2)
    for _ in range(50):
        at, x, y = rng.choice(6, 3, replace=False), rng.random(3), float(rng.integers(2))
        own.learn(at, x, y)
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in zip(at, x, strict=True))))
        for i, v in zip(at, x, strict=True):
            w, g = weight(i), (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / own.alpha * w
            n[i] += g * g
    assert np.allclose(own.weights(), [weight(i) for i in range(6)])


def test_quality_features_are_of_one_text_each():
    texts = ["The cat, the cat!", "", None, "cat | cat", "THE 12 cats", "x"]
    together = quality.features(pa.array(texts).fill_null(""), 12)
    for k, t in enumerate(texts):
        _, place, value = quality.features(pa.array([t or ""]), 12)
        own = together[0] == k
        assert np.array_equal(together[1][own], place) and np.allclose(together[2][own], value)
        assert not len(value) or np.isclose((value**2).sum(), 1)


def test_quality_edges(spark):
    rows = [(k, "good words in a calm text of some length" if k % 2 else "BAD!! BAD!! ### | | $$$", k % 2) for k in range(60)] + [(70, None, 0), (71, "", 1), (None, "good words", 1), (5, "good words in a calm text of some length", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs, labels = df.drop("quality").withColumns({c: F.lit(7) for c in EXTRA if c != "score"}), df.select("doc_id", "quality")
    model = quality.train(docs, labels)
    got = quality.score(docs, model)
    assert got.count() == len(rows) and set(docs.columns) < set(got.columns)
    assert {r.text[:4] for r in got.filter("score >= 0.5 and text != ''").collect()} == {"good"}
    assert got.filter("text is null or text = ''").select("score").distinct().count() == 1
    assert quality.train(docs, labels.filter("quality = 1")) is None and quality.train(docs.filter("false"), labels) is None
    assert [r.score for r in quality.score(docs, None).select("score").distinct().collect()] == [0.0]
    assert quality.score(docs.filter("false"), model).count() == 0


def plain_manifest(rows, fields, group, order):
    """Leaf, subroot, root and path of each row, in memory."""
    h = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                lo = i - i % 8
                paths[k].append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 8])))
                at[k] = i // 8
            nodes = [h(nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        return nodes[0] if nodes else None, paths

    low = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    by = collections.defaultdict(list)
    for r in rows:
        by[r[group]].append((low(r[order]), h([told(r[f]) for f in fields]), r[order]))
    keys = sorted(by, key=low)
    subs = [tree([leaf for _, leaf, _ in sorted(by[k])]) for k in keys]
    root, over = tree([s for s, _ in subs])
    return [(o, leaf, sub, root, tuple(path + up)) for k, (sub, paths), up in zip(keys, subs, over, strict=True) for (_, leaf, o), path in zip(sorted(by[k]), paths, strict=True)]


@pytest.mark.parametrize("block", [1, 2, 4])
def test_manifest_against_a_tree_in_memory(spark, block):
    rng = random.Random(block)
    rows = [{"doc_id": rng.choice([None, rng.randrange(-300, 300)]), "lang": rng.choice([None, "", "en", "en", "en", "é", *"abcdefgh"]), "text": rng.choice([None, "", "é text", "x" * rng.randrange(2000), str(k)])} for k in range(700)]
    rows += [{"doc_id": 7, "lang": "en", "text": "same"}] * 20 + [{"doc_id": 1, "lang": "alone", "text": "one"}]
    df = spark.createDataFrame([(r["doc_id"], r["lang"], r["text"]) for r in rows], "doc_id long, lang string, text string")
    df = df.repartition(5).withColumns({c: F.lit(7) for c in EXTRA})
    got = manifest.manifest(df, ["doc_id", "lang", "text"], group="lang", order="doc_id", block=block)
    found = collections.Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple(tuple(s) for s in r.path)) for r in got.collect())
    assert found == collections.Counter(plain_manifest(rows, ["doc_id", "lang", "text"], "lang", "doc_id"))
    assert got.filter(manifest.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_manifest_edges(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    make = lambda df: manifest.manifest(df, ["doc_id", "text"], group="lang", order="doc_id", keep=["text"]).collect()
    assert make(none) == []
    (one,) = make(spark.createDataFrame([(None, None, None)], none.schema))
    assert one.leaf == one.subroot == one.root == hashlib.sha256(b"--").hexdigest() and one.path == [] and one.text is None


@pytest.mark.parametrize("n,levels", [(1, 0), (5, 1), (8, 1), (9, 2), (70, 3), (512, 3), (513, 4), (600, 4)])
def test_traversal_keeps_two_subtrees_a_stack(n, levels):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    run = manifest.traverse(leaves, levels, height=1)
    for i, path in enumerate(run):
        at = leaves[i]
        for left, right in path:
            at = hashlib.sha256((left + at + right).encode()).hexdigest()
        assert at == manifest.root_of(leaves, levels)
        if run.gi_frame is not None:
            held = run.gi_frame.f_locals["exist"] + run.gi_frame.f_locals["desired"]
            assert sum(len(x) for t in held for x in t.nodes.values()) <= 2 * 8 * levels


def test_cells_of_the_same_members_are_checked_once(spark):
    rows = [(g, b, d, label) for g, b, held in [(1, 0, {5: 1, 6: 2}), (2, 3, {5: 1, 6: 2}), (2, 4, {5: 1, 6: 3}), (3, 0, {5: 1, 6: 2, 7: 2})] for d, label in held.items()]
    got = ngram_join._once(spark.createDataFrame(rows, "grp long, block long, doc_id long, label long")).collect()
    assert sorted(map(tuple, got)) == sorted(r for r in rows if r[:2] != (2, 3))


def test_contexts_that_share_no_half_are_put_aside(spark):
    rng, gram = np.random.default_rng(8), b"g" * suffix_dedup.GRAM
    letters = lambda n: bytes(rng.integers(97, 103, n))
    depth, half = 100, (100 - suffix_dedup.GRAM) // 2
    before, after = letters(half), letters(half)
    texts = [letters(40) + before + gram + letters(60), letters(40) + before + gram + letters(60), letters(60) + gram + after + letters(40), letters(50) + gram + after + letters(40), letters(70) + gram + letters(70)]
    rows = []
    for i, b in enumerate(texts):
        far = b.index(gram)
        near = max(0, far + depth - len(b))
        rows.append((1, far, near, i, 1, i, 0, far, b[: far - near + depth]))
    contexts = spark.createDataFrame(rows, suffix_dedup.CONTEXT.format(id="long"))
    got = suffix_dedup._sharing_a_half(contexts, ["gram", "far", "near", "whole"], depth).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 3]


def test_lines_of_lengths_too_far_apart_are_no_pair():
    held = pd.DataFrame({"grp": 1, "cell": 0, "odd": [True, False, False], "label": [1, 2, 3], "digest": [1, 2, 3], "s0": 0, "s1": 0, "length": [40, 31, 29]})
    for near in (3, None):
        got = pd.concat(line_dedup._across(20, near, 0.75)(iter([held])))
        assert got[["a", "b"]].to_numpy().tolist() == [[1, 2]], near
    text = pa.array(["  One, two\n\nthree--Four ", "é x"])
    assert line_dedup.line_hashes(text, 1)[5].tolist() == [len(line_dedup.normalised(x)) for x in (b"  One, two", b"three--Four ", "é x".encode())]
