"""Quality scores by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

Tokens are runs of letters and digits and runs of other signs. A text's features are its tokens, pairs of neighbouring
tokens, and triples of their shapes (small, capitalised, all capitals, with digits, or the signs themselves, each with
whether white space comes before it and whether it repeats one of the two tokens before), hashed to ``2**bits`` places; each has the square root of its count, and a text's
vector has length one. FTRL-proximal keeps two sums for each place, from which the weight follows, so that places seen
rarely stay at zero. A score is the logistic of a sparse dot product.

The model is learned from at most ``max_train`` labelled rows (the smallest hashes of doc_id), whose features Spark
makes and deals into ``shards``; each shard is trained by itself in a task, from the state that the shards' mean left
after the round before, and what reaches the driver is a sparse state of at most ``2**bits`` places from each shard.
Every document is scored.

Defined results: null and empty texts have no features and score the logistic of the bias; without labelled rows of both
kinds every score is 0; rows that repeat a doc_id each score by their own text; a doc_id labelled twice counts as good
only if all its labels do; labels of unknown documents are ignored; texts are read in slices of bounded bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, cut
from .hashing import SPACE, U, give_back, joined, mix, slices, word_hashes

_BYTES = np.arange(256)
WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES | 32 >= 0x61) & (_BYTES | 32 <= 0x7A)) | (_BYTES >= 0x80)
SIGN = ~WORD & ~SPACE
_CAPITAL = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_DIGIT = (_BYTES >= 0x30) & (_BYTES <= 0x39)
_KINDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, shape) of each token, in order."""
    edges = lambda own: np.flatnonzero(np.diff(own, prepend=False, append=False))
    starts, hashes = zip(word_hashes(data, ~WORD), word_hashes(data, ~SIGN), strict=True)
    at = edges(WORD[data])
    first, last = at[0::2], at[1::2]
    capitals, digits = (np.r_[0, np.cumsum(own[data])] for own in (_CAPITAL, _DIGIT))
    n, up = last - first, capitals[last] - capitals[first]
    shape = np.where(digits[last] > digits[first], 4, np.where(up == 0, 0, np.where((up == n) & (n > 1), 2, np.where((up == 1) & _CAPITAL[data[first]], 1, 3))))
    start, own, shape = np.concatenate(starts), np.concatenate(hashes), np.concatenate((shape.astype(U), hashes[1]))
    order = np.argsort(start, kind="stable")
    start, own, shape = start[order], own[order], shape[order]
    apart = SPACE[data[np.maximum(start - 1, 0)]] | (start == 0)
    return start, own, shape * U(2) + apart.astype(U)


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of the texts of ``column``, by row and place; each row's values have length one."""
    data, offsets = joined(column, 0x20)
    start, own, shape = _tokens(data)
    row = np.searchsorted(offsets, start, "right") - 1
    near, far = row[1:] == row[:-1], row[2:] == row[:-2]
    said = np.zeros(len(own), bool)
    said[1:] = near & (own[1:] == own[:-1])
    said[2:] |= far & (own[2:] == own[:-2])
    shape = mix(shape * U(2) + said.astype(U))
    grams = [own, (own[:-1] * _KINDS[0] + own[1:])[near], ((shape[:-2] * _KINDS[1] + shape[1:-1]) * _KINDS[1] + shape[2:])[far]]
    rows = np.concatenate((row, row[1:][near], row[2:][far]))
    places = np.concatenate([mix(g + k) >> U(64 - bits) for g, k in zip(grams, _KINDS, strict=True)]).astype(np.int64)
    key, count = np.unique((rows << bits) + places, return_counts=True)
    rows, value = key >> bits, np.sqrt(count)
    return rows, key & ((1 << bits) - 1), value / np.sqrt(np.bincount(rows, count, len(offsets) - 1))[rows]


@dataclass
class Model:
    """Weights of the places, the last one the bias."""

    weights: np.ndarray
    bits: int

    def scores(self, column: pa.Array) -> np.ndarray:
        rows, place, value = features(column, self.bits)
        return logistic(np.bincount(rows, self.weights[place] * value, len(column)) + self.weights[-1])


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Leader:
    """Follow the regularised leader: sums of gradients (z) and of their squares (n) for each place."""

    z: np.ndarray
    n: np.ndarray
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (logistic(w @ value) - label) * value
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _shard(z: np.ndarray, n: np.ndarray):
    """One pass over a shard's rows from the state ``z``, ``n``; gives the state after it."""

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        own, bias = Leader(z.astype(float), n.astype(float)), len(z) - 1
        for r in rows.sort_values("turn").itertuples():
            own.learn(np.append(r.place, bias), np.append(r.value, 1.0), float(r.good))
        at = np.flatnonzero(own.n)
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "place": [at.astype(np.int32)], "z": [own.z[at].astype(np.float32)], "n": [own.n[at].astype(np.float32)]})

    return learn


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, bits: int = 18, shards: int = 4, rounds: int = 4, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """The model, from at most ``max_train`` labelled rows that are not held out; None without rows of both kinds."""
    batches_by_bytes(docs.sparkSession)
    order = F.xxhash64("_id")
    chosen = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).alias("_id"), (F.col(label) != 0).alias("good"))
    chosen = F.broadcast(cut(chosen.groupBy("_id").agg(F.min("good").alias("good")).orderBy(order, "_id").limit(max_train)))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(chosen, "_id")
    rows = rows.select("text", "good", order.alias("turn"), F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(shards)).cast("int").alias("shard"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in slices(batch):
                    row, place, value = features(part.column("text"), bits)
                    at = pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32())
                    lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (place.astype(np.int32), value.astype(np.float32))]
                    yield pa.RecordBatch.from_arrays([*lists, *[part.column(c) for c in ("good", "turn", "shard")]], ["place", "value", "good", "turn", "shard"])
        finally:
            give_back()

    made = cut(rows.mapInArrow(read, "place array<int>, value array<float>, good boolean, turn long, shard int"))
    if {r["good"] for r in made.select("good").distinct().collect()} != {True, False}:
        return None
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(rounds):
        done = made.groupBy("shard").applyInPandas(_shard(z.astype(np.float32), n.astype(np.float32)), "shard int, place array<int>, z array<float>, n array<float>").toArrow().sort_by("shard")
        place, parts = done["place"].combine_chunks().flatten().to_numpy(), len(done)
        z, n = (np.bincount(place, done[c].combine_chunks().flatten().to_numpy(), size) / parts for c in "zn")
    return Model(Leader(z, n).weights().astype(np.float32), bits)


def score(docs: DataFrame, model: Model | None, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the column ``into``."""
    if model is None:
        return docs.withColumn(into, F.lit(0.0))
    batches_by_bytes(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for column in batches:
                batch = pa.RecordBatch.from_arrays([column], ["text"])
                yield pa.array(np.concatenate([np.zeros(0), *[model.scores(part.column("text")) for part in slices(batch)]]))
        finally:
            give_back()

    return docs.withColumn(into, scored(F.col(text)))
