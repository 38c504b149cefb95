"""Toxicity scores from a fuzzy lexicon with context.

A lexicon is learned from labelled rows: words, and word beginnings (stems), that mark toxic documents. Words of at
least ``MIN_FUZZY`` letters sit in a trie that is intersected with a word's Levenshtein automaton of distance one: states
(node, errors) without an error follow the word down the trie, and at each node those of one error branch off, which take
the rest of the word exactly; what a node takes as a rest, with any one letter before it or without, is held with the
node. So misspelled terms are caught in a few look-ups a letter, without tables that grow. A misspelled term weighs as its
term. Words of clean documents are never taken for one, and a term is matched exactly only where rare words around it
(which stand for those not seen yet) are no sign of toxic documents. Each hit is read with a window of words around it: one
between quotation marks or after words of reporting counts ``QUOTED`` times, one near words of address ``ADDRESSED``
times. A logistic model gives the score, over sums of those hits, none of whose weights may be negative, and the share of
distinct words, of either sign; it is fitted on hits of a lexicon learned from the other half of the sample. So a misspelled
term never lowers a score, and quotation marks never raise it.

The lexicon and the model are learned from at most ``max_train`` labelled rows (the smallest hashes of doc_id), counted
by Spark; what reaches the driver is the terms of that sample that stand out, its words at distance one from them, and
``max_train`` feature rows.

Defined results: null or empty texts have no hits and score as such; without labelled rows of both kinds every score is
0; rows that repeat a doc_id each score by their own text; labels of unknown documents are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, cut
from .hashing import tidy

MIN_FUZZY = 5
#: Words a task keeps ready, twice over.
WORDS = 150_000
STEMS = (3, 4, 5, 6, 7)
WINDOW = 5
QUOTED, ADDRESSED = 0.25, 1.5
#: Documents of the sample that may hold a word that stands for those not seen yet.
RARE = 2
#: Words added to each text's, so that one hit in a short text isn't all of it.
SMOOTH = 20
QUOTES = frozenset("\"“”„«»‹›")
# Words of reporting and of address, in the languages of the corpus.
REPORTING = frozenset("said says wrote writes quote quoted quotes called calls term word dit écrit cité sagte schrieb zitat dijo escribió cita".split())
ADDRESS = frozenset("you your yours you're u ur tu toi vous ton ta votre du dich dein deine ihr tú ti usted tus eres".split())
_TOKEN = re.compile(r"\w+|[\"“”„«»‹›]")


@dataclass
class Lexicon:
    """Terms and stems with their weights; ``match`` is the automaton's run over one word.

    ``strict`` terms are matched exactly only; ``known`` words are no misspelled terms.
    """

    terms: dict[str, float]
    stems: dict[str, float]
    strict: frozenset[str] = frozenset()
    known: frozenset[str] = frozenset()
    _seen: dict = field(default_factory=dict, repr=False)
    _before: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self._kids: list[dict[str, int]] = [{}]
        self._below: list[dict[str, str]] = [{}]  # of each node the rests that end a term, with the term
        self._after: list[dict[str, list[str]]] = [{}]  # the same after any one letter
        for word in self.terms:
            node = 0
            for i in range(len(word) + 1 if len(word) >= MIN_FUZZY and word not in self.strict else 0):
                self._below[node][word[i:]] = word
                if i < len(word):
                    self._after[node].setdefault(word[i + 1 :], []).append(word)
                    if word[i] not in self._kids[node]:
                        self._kids[node][word[i]] = len(self._kids)
                        for part in (self._kids, self._below, self._after):
                            part.append({})
                    node = self._kids[node][word[i]]

    def near(self, word: str) -> set[str]:
        """The terms at distance one at most that aren't strict."""
        kids, below, after, node = self._kids, self._below, self._after, 0
        found = {below[0][word]} if word in below[0] else set()
        for i in range(len(word)):
            rest, shorter = word[i:], word[i + 1 :]
            if rest in (own := after[node]):  # a letter missing
                found.update(own[rest])
            if shorter in own:  # one in another's place
                found.update(own[shorter])
            if shorter in below[node]:  # one too many
                found.add(below[node][shorter])
            if (node := kids[node].get(rest[0], -1)) < 0:
                break
        else:
            found.update(after[node].get("", ()))
        return found

    def meant(self, word: str) -> str | None:
        """The term of the largest weight that ``word`` may be a misspelling of."""
        return None if word in self.known else max(self.near(word), key=lambda t: (self.terms[t], t), default=None)

    def match(self, word: str) -> tuple[int, float, str] | None:
        """(0 term or 1 stem, weight, term or word) of a word that hits."""
        if len(self._seen) >= WORDS:  # words not met again for so long are forgotten
            self._before, self._seen = self._seen, {}
        if word in self._before:
            hit = self._before[word]
        elif word in self.terms:
            hit = (0, self.terms[word], word)
        elif len(word) >= MIN_FUZZY - 1 and (term := self.meant(word)):
            hit = (0, self.terms[term], term)
        else:
            w = max((self.stems.get(word[:n], 0.0) for n in STEMS if n < len(word)), default=0.0)
            hit = (1, w, word) if w > 0 else None
        self._seen[word] = hit
        return hit


def _context(tokens: list[str], i: int) -> float:
    """How often the hit at ``i`` counts."""
    before, later = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + WINDOW + 1]
    quoted = any(t in REPORTING for t in before) or (any(t in QUOTES for t in before) and any(t in QUOTES for t in later))
    return (QUOTED if quoted else 1.0) * (ADDRESSED if any(t in ADDRESS for t in before) or any(t in ADDRESS for t in later) else 1.0)


#: Features whose weights may not be negative come first.
SIGNED = 4


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Weights of a text's hits, each as often as its context says: of terms, of stems, both per word; and the share of distinct words."""
    tokens = _TOKEN.findall((text or "").lower())
    weight, words, seen = [0.0, 0.0], 0, set()
    for i, t in enumerate(tokens):
        if t in QUOTES:
            continue
        words += 1
        if h := lexicon._seen[t] if t in lexicon._seen else lexicon.match(t):
            kind, w, t = h
            weight[kind] += w * _context(tokens, i)
        seen.add(t)
    return [*np.log1p(weight), *np.log1p([100.0 * w / (words + SMOOTH) for w in weight]), len(seen) / words if words else 1.0]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, stem, t0, t1, c0, c1): documents that hold a term, by label (t toxic, c clean) and half, folded over each batch."""
    for pdf in batches:
        counts: dict[tuple[str, bool], list[int]] = {}
        for text, toxic, half in zip(pdf["text"], pdf["toxic"], pdf["half"], strict=True):
            own = set(_TOKEN.findall((text or "").lower()))
            keys = Counter((w, False) for w in own if len(w) > 2)
            keys.update({(w[:n], True) for w in own for n in STEMS if n < len(w)})
            at = int(half) + (0 if toxic else 2)
            for k in keys:
                counts.setdefault(k, [0, 0, 0, 0])[at] += 1
        yield pd.DataFrame([(t, s, *n) for (t, s), n in counts.items()], columns=["term", "stem", "t0", "t1", "c0", "c1"])


def _neighbours(lexicon: Lexicon):
    """The counted words, no terms, at distance one from a term, with those terms."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = pdf[[len(w) >= MIN_FUZZY - 1 and w not in lexicon.terms for w in pdf["term"]]]
            own = own.assign(near=[sorted(lexicon.near(w)) for w in own["term"]])
            yield own[own["near"].map(len) > 0][["term", "near", "t0", "t1", "c0", "c1"]]

    return found


def _lexicon(counted: pd.DataFrame, around: pd.DataFrame, halves: tuple[int, ...], sizes: dict[str, int]) -> Lexicon:
    """The terms and stems whose share of toxic documents, shrunk towards the base rate, stands out; ``around`` has the words at distance one from terms."""
    nt, nc = max(1, sum(sizes[f"t{h}"] for h in halves)), max(1, sum(sizes[f"c{h}"] for h in halves))
    both = lambda rows, kind: sum(rows[f"{kind}{h}"] for h in halves).to_numpy(float)
    odds = lambda t, c: np.log((t + 0.5) / (nt + 1)) - np.log((c + 0.5) / (nc + 1))
    t, c = both(counted, "t"), both(counted, "c")
    sure = odds(t, c) - 1.0 * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    good = (sure > 1.0) & (t >= 3)
    pick = lambda stem: {w: float(s) for w, s, g, k in zip(counted["term"], sure, good, counted["stem"], strict=True) if g and k == stem}
    t, c = both(around, "t"), both(around, "c")
    rare = pd.DataFrame({"near": around["near"], "t": t, "c": c})[(t + c > 0) & (t + c <= RARE)].explode("near").groupby("near")[["t", "c"]].sum()
    strict = rare.index[odds(rare["t"].to_numpy(float), rare["c"].to_numpy(float)) <= 1.0]
    return Lexicon(pick(False), pick(True), frozenset(strict), frozenset(around["term"][c > 0]))


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps; of the first ``SIGNED`` features the one of the most negative weight goes until none is negative."""
    kept = np.arange(x.shape[1])
    while True:
        z = np.c_[x[:, kept], np.ones(len(x))]
        w = np.zeros(z.shape[1])
        penalty = np.r_[np.full(len(kept), ridge * len(x) / 100), 1e-9]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (p - y) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        bound = w[: (kept < SIGNED).sum()]
        if not len(bound) or bound.min() >= 0:
            full = np.zeros(x.shape[1])
            full[kept] = w[:-1]
            return full, float(w[-1])
        kept = np.delete(kept, bound.argmin())


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(features(text, self.lexicon), self.weights) + self.bias, -30, 30))))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """The model, from at most ``max_train`` labelled rows that are not held out; None without rows of both kinds."""
    batches_by_bytes(docs.sparkSession)
    order = F.xxhash64(F.col("_id"))
    chosen = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).alias("_id"), (F.col(label) != 0).alias("toxic"))
    chosen = F.broadcast(cut(chosen.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(order, "_id").limit(max_train)))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(chosen, "_id").withColumn("half", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(2)).cast("int"))
    sizes = {f"{'t' if r['toxic'] else 'c'}{r['half']}": r["count"] for r in rows.groupBy("toxic", "half").count().collect()}
    sizes = {k: sizes.get(k, 0) for k in ("t0", "t1", "c0", "c1")}
    if not sizes["t0"] + sizes["t1"] or not sizes["c0"] + sizes["c1"]:
        return None
    counted = rows.select("text", "toxic", "half").mapInPandas(tidy(_counts), "term string, stem boolean, t0 long, t1 long, c0 long, c1 long")
    counted = cut(counted.groupBy("term", "stem").agg(*[F.sum(c).alias(c) for c in ("t0", "t1", "c0", "c1")]))
    toxic = F.col("t0") + F.col("t1")
    lift = toxic / (toxic + F.col("c0") + F.col("c1"))
    base = (sizes["t0"] + sizes["t1"]) / sum(sizes.values())
    terms = counted.filter((toxic >= 3) & (lift > F.lit(2 * base).cast("double"))).toPandas().sort_values(["term", "stem"], ignore_index=True)
    every = Lexicon(dict.fromkeys(terms["term"][~terms["stem"]], 1.0), {})
    around = counted.filter(~F.col("stem")).mapInPandas(_neighbours(every), "term string, near array<string>, t0 long, t1 long, c0 long, c1 long").toPandas()
    halves = [_lexicon(terms, around, (1,), sizes), _lexicon(terms, around, (0,), sizes)]  # rows of half 0 are read with what half 1 taught

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"f": [features(t, halves[h]) for t, h in zip(pdf["text"], pdf["half"], strict=True)], "y": pdf["toxic"].astype(float)})

    fitted = rows.select("text", "toxic", "half").mapInPandas(tidy(read), "f array<double>, y double").toPandas()
    weights, bias = _fit(np.stack(fitted["f"].to_numpy()), fitted["y"].to_numpy())
    return Model(_lexicon(terms, around, (0, 1), sizes), weights, bias)


def score(docs: DataFrame, model: Model | None, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the column ``into``."""
    if model is None:
        return docs.withColumn(into, F.lit(0.0))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(lambda it: (texts.map(model.score, na_action=None).astype(float) for texts in it))(batches)

    return docs.withColumn(into, scored(F.col(text)))
