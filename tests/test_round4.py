"""Findings of round 3: ties, whole pairs, bounded steps."""

import random
from itertools import combinations, permutations

import numpy as np
from pyspark.sql import functions as F

from sonolith.llm.line_dedup import drop_duplicate_lines, within
from sonolith.operators import blocks, corpus, form
from sonolith.operators import structure as st
from sonolith.operators.stability import folded_tempo


def test_tempo_ties_do_not_depend_on_the_order_of_sums(spark):
    # 30.365 / 1.5 is the mean of the three: a tie, which isn't folded; its sums come out on either side of it
    values = {0: [58.52, 0.38, 1.83], 1: [30.365], 2: [30.365], 3: [None]}
    rng = random.Random(3)
    seen = set()
    for times in (1, 7, 60, 113):
        for _ in range(3):
            rows = [(u, w, v) for u in (1, None) for w, own in values.items() for v in own * times]
            rng.shuffle(rows)
            tempo = spark.createDataFrame(rows, "u long, w int, v double").repartition(5).groupBy("u", "w").agg(F.avg("v").alias("tempo"))
            seen |= {(r.u, round(r.tempo, 9), r.agreement, r.n_windows) for r in folded_tempo(tempo, "u", "tempo").collect()}
    assert seen == {(1, 30.365, 0.5, 4), (None, 30.365, 0.5, 4)}


def test_tempo_shares_round_as_they_stand_times_1000(spark):
    # 203 of 400 windows near the median: 0.5075 times 1000 is just below 507.5
    rows = [(1, 100.0)] * 203 + [(1, 120.0)] * 99 + [(1, 80.0)] * 98
    got = folded_tempo(spark.createDataFrame(rows, "u long, tempo double"), "u", "tempo").first()
    assert (got.tempo, got.agreement, got.n_windows) == (100.0, 0.507, 400)


def test_lines_that_meet_lose_no_link(spark):
    # orders of the same words have one SimHash, so all of them meet; most are unlike, and a line may be unlike its nearest
    rng = random.Random(8)
    lines = [" ".join(p) for words in ("amber birch cedar delta ember", "quartz river stone tulip umber") for p in rng.sample(list(permutations(words.split())), 70)]
    rng.shuffle(lines)
    lead = list(range(len(lines)))
    for i, j in combinations(range(len(lines)), 2):
        a, b = lines[i].encode(), lines[j].encode()
        if within(a, b, int(0.25 * max(len(a), len(b)))):
            x, y = lead[i], lead[j]
            lead = [min(x, y) if v in (x, y) else v for v in lead]
    want = {i: line if lead[i] == i else "" for i, line in enumerate(lines)}
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in drop_duplicate_lines(docs).collect()}
    assert 2 < len(set(lead)) < len(lines)
    assert got == want


def test_rows_are_sent_to_a_bounded_number_of_parts():
    assert [blocks._parts(n, 2048, 10) for n in (0, 1, 10_000, 100_000, 600_000, 3_000_000)] == [1, 1, 5, 48, 48, 48]
    assert blocks._parts(600_000, 2048, 600_000) * 32 * blocks.HELD >= 600_000 * 600_000  # sums that a task holds


def test_silhouettes_of_labels_that_turn_up_late(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 3))
    labels = [f"l{i // 30}" for i in range(900)]
    df = spark.createDataFrame([(i, [float(y) for y in v], [k, "x"]) for i, (v, k) in enumerate(zip(x, labels, strict=True))], "id long, v array<double>, l array<string>")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    means = np.stack([d[:, 30 * k : 30 * k + 30].sum(axis=1) for k in range(30)], axis=1)
    own = np.arange(900) // 30
    a = means[np.arange(900), own] / 29
    means[np.arange(900), own] = np.inf
    b = (means / 30).min(axis=1)
    got = blocks.silhouettes(df, "id", "v", "l", 100).collect()
    assert [(r.which, r.n) for r in got] == [(0, 900)] and np.isclose(got[0].silhouette, ((b - a) / np.maximum(a, b)).mean())


def test_cosines_are_products_of_blocks(spark):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    every = corpus.pair_cosine(df, "id", "v")
    assert "NestedLoop" not in every._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    got = {(r.i, r.j): r.sim for r in every.collect()}
    assert got == {(1, 2): 0.6, (1, 3): None, (1, 4): 0.0, (1, 5): None, (2, 3): None, (2, 4): 0.0, (2, 5): None, (3, 4): None, (3, 5): None, (4, 5): None}
    some = {(r.i, r.j): r.sim for r in corpus.pair_cosine(df, "id", "v", df.filter("id in (1, 3)")).collect()}
    assert some == {(i, j): got[min(i, j), max(i, j)] for i in (1, 3) for j in range(1, 6) if i != j}


def recordings(spark, rng, sizes):
    return spark.createDataFrame([(r, i, [float(y) for y in rng.standard_normal(3)]) for r, n in enumerate(sizes) for i in range(n)], "recording int, frame long, v array<double>")


def test_longest_repeats_without_the_pairs(spark):
    frames = recordings(spark, np.random.default_rng(12), (70, 1, 33)).cache()
    every = st.repeat_runs(form.similar_pairs(frames, "v", 0.0, 4), 0.0, 3, 4)
    want = {tuple(r) for r in every.collect()}
    assert {tuple(r) for r in form.similar_runs(frames, "v", 0.0, 4, 3, 10**9, block=8).collect()} == want
    apart = sorted(map(tuple, form.longest_apart(every, 12).collect()))
    for keep in (4, 4096):  # few are not enough: the rest is looked at
        assert sorted(map(tuple, form.longest_repeats(frames, "v", 0.0, 4, 3, 12, keep=keep, block=8).collect())) == apart


def test_blocks_of_a_recording_are_sent_to_a_bounded_number_of_stripes(spark):
    frames = recordings(spark, np.random.default_rng(1), (400,))
    sent = form._striped(frames, "v", 1, 4).groupBy("k").count().collect()
    assert len(sent) == 100 and {r["count"] for r in sent} == {form.STRIPES}
