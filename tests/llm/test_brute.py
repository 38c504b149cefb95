"""The queries against brute force, held-out labels and exact round trips on the smallest tables."""

import collections
import hashlib
import os
import re

import numpy as np
import pandas as pd
import pytest

from sonolith.llm import queries as q
from sonolith.llm.line_dedup import duplicate_lines, within
from sonolith.llm.ngram_join import similar_groups
from sonolith.llm.suffix_dedup import remove_repeats

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DIR), reason="no tables")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DIR}/documents.parquet").sort_values("doc_id", ignore_index=True)


def edit_distance(a: bytes, b: bytes) -> int:
    """Levenshtein distance by rows of the matrix."""
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (c != d))
    return row[-1]


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("group", [4096, 1])
def test_repeated_bytes(spark, docs, group):
    texts = [t.encode() for t in docs.text]
    seen = collections.Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    out = {r.doc_id: r for r in remove_repeats(spark.read.parquet(f"{DIR}/documents.parquet"), depth=400, group=group).collect()}
    for doc_id, t in zip(docs.doc_id, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        assert bytes(out[doc_id].kept) == bytes(np.frombuffer(t, np.uint8)[~gone])
        assert len(out[doc_id]["spans"]) == int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())


@pytest.mark.parametrize("block", [4096, 4])
def test_jaccard_groups(spark, docs, block):
    sets = []
    for t in docs.text:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * (c := len(sets[i] & sets[j])) >= 75 * (len(sets[i]) + len(sets[j]) - c)]
    want = roots(len(sets), pairs)
    out = {r.doc_id: r for r in similar_groups(spark.read.parquet(f"{DIR}/documents.parquet"), block=block).collect()}
    for i, doc_id in enumerate(docs.doc_id):
        assert (out[doc_id].n_shingles, out[doc_id].component_id) == (len(sets[i]), docs.doc_id[want[i]])


def plain_line(x):
    """A line as lower-case words, by a rule of its own."""
    return " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))).encode()


def test_line_dedup(spark, docs):
    """Against a plain join by edit similarity, without any SimHash: links are true, exact repeats all go, and few near ones are missed."""
    at = collections.defaultdict(list)
    for doc_id, t in zip(docs.doc_id, docs.text, strict=True):
        for n, x in enumerate(t.split("\n")):
            if s := plain_line(x):
                at[s].append((doc_id, n))
    lines = sorted(at, key=len)
    pairs = []
    for i, a in enumerate(lines):
        for j in range(i + 1, len(lines)):
            b = lines[j]
            if 3 * len(b) > 4 * len(a):
                break
            if within(a, b, len(b) // 4):
                pairs.append((i, j))
    want = roots(len(lines), pairs)
    out = {r.doc_id: r.text.split("\n") for r in q.op2_line_dedup(spark, DIR).collect()}
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    kept = set()
    for doc_id, left in out.items():
        all_lines, n = texts[doc_id].split("\n"), 0
        for x in left:  # what is left comes in the order of the input
            if left == [""] and all_lines[n] != "":
                break
            while all_lines[n] != x:
                n += 1
            kept.add(plain_line(x))
            n += 1
    lost = [s for s in lines if s not in kept]
    groups = collections.defaultdict(list)
    for i, s in enumerate(lines):
        groups[want[i]].append(s)
    assert all(any(s in kept for s in g) for g in groups.values())  # of every true group a line is left
    total = len(lines) - len(groups)
    assert len(lost) <= total and len(lost) >= 0.9 * total, (len(lost), total)
    count = collections.Counter(plain_line(x) for left in out.values() for x in left)
    assert all(n == 1 for s, n in count.items() if s)  # exact repeats are gone


def test_edit_distance_bound():
    rng = np.random.default_rng(4)
    for _ in range(400):
        a = bytes(rng.integers(97, 101, rng.integers(0, 24)).tolist())
        b = bytes(rng.integers(97, 101, rng.integers(0, 24)).tolist())
        for limit in (0, 1, 3, 7):
            assert within(a, b, limit) == (edit_distance(a, b) <= limit)


@pytest.mark.parametrize("block", [1024, 8])
def test_large_groups_of_lines(spark, block):
    """Variants of one line, more than a block holds, keep one occurrence; unlike lines beside them stay."""
    from pyspark.sql import functions as F

    base = [f"word{i}" for i in range(60)]
    rows = [(k, " ".join([*base[:k], f"other{k}", *base[k + 1 :]])) for k in range(60)] + [(100 + k, " ".join(f"x{k}y{i}" for i in range(40))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("_t"), "text")
    gone = {r.doc_id for r in duplicate_lines(df, block=block).collect()}
    assert gone == set(range(1, 60))


def test_nearest_recall(spark):
    v = pd.read_parquet(f"{DIR}/embeddings.parquet").sort_values("vec_id", ignore_index=True)
    x = np.stack(v.embedding.to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    out = q.op3_nearest(spark, DIR).toPandas()
    hits = total = 0
    for i in np.flatnonzero(v.vec_id % 50 == 0):
        s = x @ x[i]
        s[i] = -2
        own = out[out.query_id == v.vec_id[i]].sort_values("rank")
        assert np.allclose(own.score, s[np.searchsorted(v.vec_id, own.vec_id)], atol=1e-12) and (np.diff(own.score) <= 0).all()
        hits += len(set(own.vec_id) & set(v.vec_id[np.argsort(-s, kind="stable")[:5]]))
        total += 5
    assert hits / total >= 0.9


def test_toxicity_held_out(spark):
    out = q.op8_toxicity(spark, "/root/testdata/sf0.1").toPandas().merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    held = out[out.held_out]
    rank = held.score.rank()
    bad = held.toxic == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.97 and (held.predicted == held.toxic).mean() > 0.97


def test_fuzzy_matches_distance():
    from sonolith.llm.toxicity import Lexicon

    lexicon = Lexicon({"worthless": 2.0, "idiot": 1.0, "clown": 1.5, "bad": 1.0}, {})
    for word in ("worthles", "wortless", "worthlesss", "w0rthless", "idiott", "idot", "klown", "clwn", "clown", "worthy", "idio", "dio", "bae", "clowning"):
        near = [w for w in ("worthless", "idiot", "clown") if edit_distance(word.encode(), w.encode()) <= 1]
        assert lexicon.near(word) == set(near), word


def test_toxicity_misspelled_and_quoted(spark):
    """On held-out texts a misspelled term weighs as its term, quotation marks lower a score, and the automaton finds what exact terms miss."""
    import random

    from sonolith.llm import toxicity as t

    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    docs, labels = read("documents"), read("labels")
    model = t.train(docs, labels)
    lexicon, dice = model.lexicon, random.Random(5)
    exact = t.Model(t.Lexicon(lexicon.terms, lexicon.stems, strict=frozenset(lexicon.terms)), model.weights, model.bias)
    assert (model.weights[: t.SIGNED] >= 0).all()

    def worse(m):
        w, i = m[0], dice.randrange(1, max(2, len(m[0])))
        return w[:i] + dice.choice("qxz") + w[i:] if w.lower() in lexicon.terms and w.lower() not in lexicon.strict and len(w) >= t.MIN_FUZZY else w

    held = docs.join(labels, "doc_id").filter(t.held_out("doc_id")).select("text", "toxic").distinct().toPandas().fillna({"text": ""})
    bad = held[held.toxic == 1].text
    bent = bad.map(lambda x: re.sub(r"\w+", worse, x))
    caught = lambda m, texts: (texts.map(m.score) >= 0.5).mean()
    assert caught(model, bent) >= caught(model, bad) - 0.02 and caught(exact, bent) < caught(model, bent) - 0.2
    for w in ("idiot", "moron", "worthless"):
        assert model.score(f"the {w} is here") == pytest.approx(model.score(f"the {w[:3]}q{w[3:]} is here"))
        assert model.score(f"the {w} is here") > model.score("the lake is here")
        assert model.score(f'the "{w}" is here') < model.score(f"the {w} is here") < model.score(f"you {w} is here")
    known = sorted(lexicon.known)[:50]
    assert known and all(lexicon.meant(w) is None for w in known)


def test_main_text_of_pages(spark):
    out = q.op10_main_text(spark, DIR).toPandas().set_index("page_id")
    pages = pd.read_parquet(f"{DIR}/pages.parquet")
    for r in pages.itertuples():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", r.html, re.S)[1]
        import html

        blocks = [" ".join(html.unescape(re.sub(r"</?(?:b|a|i|em|strong|span)\b[^>]*>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in re.split(r"</?(?:p|h1|h2|ul|li|div|table|tr|td)\b[^>]*>", article)]
        assert out.text[r.page_id] == "\n".join(b for b in blocks if b) and out.n_chars[r.page_id] == len(out.text[r.page_id])


def test_pipeline(spark, docs):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DIR).toPandas()
    assert set(out.doc_id) <= set(docs.doc_id) and len(out) and out.groupby("doc_id").size().max() <= 3
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near copies", "decontamination", "mixing"]


def test_digest_shape(spark):
    out = q.op4_repeated_bytes(spark, DIR).toPandas()
    gone = out[out.n_removed == out.n_bytes]
    assert (gone.kept_sha256 == hashlib.sha256(b"").hexdigest()).all() and (out.n_removed <= out.n_bytes).all()


@pytest.mark.parametrize("group", [1, 512])
def test_repeats_of_passages_in_many_contexts(spark, group):
    """Passages cut at different places, each between other bytes, rows repeated: removed bytes as by comparing all windows."""
    rng, depth = np.random.default_rng(3), 40
    letters = lambda n, size=26: bytes(rng.integers(97, 97 + size, n)).decode()
    passages = [letters(rng.integers(60, 260), 4) for _ in range(3)]
    texts: list = [(1000, "a" * 300), (1001, "b" * 95), (1002, None)]
    for i in range(60):
        p = passages[i % 3]
        texts.append((i, letters(rng.integers(0, 60)) + p[rng.integers(0, 20) : len(p) - rng.integers(0, 20)] + letters(rng.integers(0, 60)) + (p if i % 7 == 0 else "")))
    texts += texts[3:6]
    seen: dict = {}
    for _, t in texts:
        for j in range(len(t or "") - depth + 1):
            seen[t[j : j + depth]] = seen.get(t[j : j + depth], 0) + 1

    def kept(t: str) -> str:
        gone = {x for j in range(len(t) - depth + 1) if seen[t[j : j + depth]] > 1 for x in range(j, j + depth)}
        return "".join(c for x, c in enumerate(t) if x not in gone)

    got = remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), depth=depth, group=group).collect()
    assert sorted((r.doc_id, bytes(r.kept).decode()) for r in got) == sorted((i, kept(t or "")) for i, t in texts)
