"""Exact Jaccard self-join of word-shingle sets by PartEnum signatures, and its linked groups.

Two sets of sizes r <= s with Jaccard similarity of at least a threshold differ in at most (1 - t) / (1 + t) * (r + s)
elements, and r >= t * s. Sizes are cut into bands of ratio 1 / t, so that a pair lies in one band or in two neighbours;
a set signs for its own band and for the next. For a band whose pairs differ in at most k elements the feature domain is
partitioned into more than k parts, and every subset of ``keep`` parts is a signature, the hash of the set's elements in
them: at least one subset is free of differences, so every sufficiently similar pair shares a signature. Subsets without
elements are not signed; a set with too few filled parts for the guarantee also signs its prefix, the smallest
hashes of which any similar set has one in its own prefix.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_rows, batches_by_bytes, broadcast_if_small, cut
from .components import cells, components
from .hashing import U, joined, mix, slices, tidy, word_hashes

#: Bits of a sketch for each shingle: pairs down to a similarity of about 0.71 pass the coarse ones, of 0.746 the fine ones.
COARSE, FINE = 2, 16


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of ``column``; a text of fewer words is one shingle, none without words."""
    data, starts = joined(column, 0x20)
    n = len(starts) - 1
    start, h = word_hashes(data)
    edges = np.searchsorted(start, starts)
    first, last = edges[:-1], edges[1:]
    roll = h.copy()
    for j in range(1, width):
        roll = roll[: len(h) - j] * U(0x9FB21C651E98DF25) + h[j:] if len(h) > j else np.zeros(0, np.uint64)
    roll = mix(roll)
    for i in range(n):
        a, b = first[i], last[i]
        if b - a >= width:
            yield i, np.unique(roll[a : b - width + 1])
        elif b > a:
            x = U(b - a)
            for w in h[a:b]:
                x = U((int(x) * 0x9FB21C651E98DF25 + int(w)) & (2**64 - 1))
            yield i, mix(np.array([x], np.uint64))
        else:
            yield i, np.zeros(0, np.uint64)


@functools.cache
def bands(num: int, den: int, most: int = 1 << 40) -> np.ndarray:
    """The last size of each band: bands [lo, hi] with hi = floor(lo / threshold)."""
    out, lo = [], 1
    while lo <= most:
        out.append(lo * den // num)
        lo = out[-1] + 1
    return np.array(out, np.int64)


def scheme(hi: int, num: int, den: int) -> tuple[int, int, int]:
    """(most differences k, parts p, parts kept q) of the band that ends at size ``hi``."""
    k = (den - num) * 2 * hi // (den + num)
    if k == 0:
        return 0, 1, 1
    if k <= 4:
        return k, k + 2, 2
    return k, int(1.1 * (k + 1)) + 2, 1


@functools.cache
def _subsets(p: int, q: int) -> np.ndarray:
    return np.array(list(combinations(range(p), q)))


def signatures(s: np.ndarray, num: int = 3, den: int = 4) -> np.ndarray:
    """The signatures of a set of hashes for a threshold of num / den."""
    n, edges = len(s), bands(num, den)
    own = int(np.searchsorted(edges, n))
    out = []
    for band in (own, own + 1):
        hi = int(edges[band])
        k, p, q = scheme(hi, num, den)
        tag = U((band * 0x9E3779B97F4A7C15 + 0x165667B19E3779F9) & (2**64 - 1))
        part = ((mix(s ^ tag) >> U(32)) * U(p)) >> U(32)
        part = part.astype(np.int64)
        filled = np.bincount(part, minlength=p) > 0
        total = np.zeros(p, np.uint64)
        np.add.at(total, part, mix(s + tag))
        ids = (np.arange(p, dtype=np.uint64) + U(1)) * U(0xC2B2AE3D27D4EB4F)
        if q == 1:
            out.append(mix((mix(total + ids) ^ tag))[filled])
        else:
            sub = _subsets(p, q)
            use = filled[sub].any(axis=1)
            sub = sub[use]
            out.append(mix(mix(total[sub] + ids[sub]).sum(axis=1, dtype=np.uint64) ^ tag))
        reach = min(hi, n * den // num)
        if filled.sum() <= (den - num) * (n + reach) // (den + num) and k:
            prefix = np.sort(s)[: n - -(-n * num // den) + 1]
            out.append(mix(prefix ^ mix(np.array([tag + U(5)]))))
    return np.concatenate(out)


def sketch(s: np.ndarray, per: int = COARSE) -> bytes:
    """Parities of how many hashes fall to each of about ``per`` n bits; two sets differ in at least as many elements as their sketches in bits."""
    bits = 1 << max(6, int(per * len(s) - 1).bit_length())
    odd = np.bincount((mix(s + U(77)) % U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(b: bytes, size: int) -> bytes:
    """A sketch of ``size`` bytes made of a longer one; bit i of the short is the parity of the bits i modulo its length."""
    return b if len(b) == size else np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, size)).tobytes()


def _fitting(n: np.ndarray, sketches: list[bytes], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one group, by pair, the bits in which their sketches differ and whether they may be similar."""
    size = min(map(len, sketches))
    bits = np.frombuffer(b"".join(_folded(b, size) for b in sketches), np.uint64 if size % 8 == 0 else np.uint8).reshape(len(n), -1)
    distance = np.zeros((len(n), len(n)), np.int32)
    for w in range(bits.shape[1]):
        distance += np.bitwise_count(bits[:, w, None] ^ bits[None, :, w])
    total = n[:, None] + n[None, :]
    return distance, (distance <= (den - num) * total // (den + num)) & (den * np.minimum(n[:, None], n[None, :]) >= num * np.maximum(n[:, None], n[None, :]))


def _forest(docs: np.ndarray, n: np.ndarray, sketches: list[bytes], labels: np.ndarray, every: bool, num: int, den: int) -> list[tuple[int, int]]:
    """Of one group, pairs of different labels that may be similar: a shortest spanning forest of them, or all if ``every``."""
    if len(docs) == 2:
        size = min(map(len, sketches))
        x, y = (int.from_bytes(_folded(b, size)) for b in sketches)
        lo, hi = sorted(n.tolist())
        fits = labels[0] != labels[1] and den * lo >= num * hi and (x ^ y).bit_count() <= (den - num) * (lo + hi) // (den + num)
        return [(int(docs[0]), int(docs[1]))] if fits else []
    out: list[tuple[int, int]] = []
    distance, fits = _fitting(n, sketches, num, den)
    far = 1 << 30
    if every:
        i, j = np.nonzero(np.triu(fits & (labels[:, None] != labels[None, :]), 1))
        return [(int(docs[x]), int(docs[y])) for x, y in zip(i, j, strict=True)]
    distance[~fits] = far
    _, label = np.unique(labels, return_inverse=True)
    while True:
        d = np.where(label[:, None] == label[None, :], far, distance)
        near = d.argmin(axis=1)
        best = d[np.arange(len(docs)), near]
        order = np.lexsort((docs, best))
        order = order[best[order] < far]
        if not len(order):
            return out
        _, lead = np.unique(label[order], return_index=True)  # of each tree its shortest way out
        for i in order[lead]:
            a, b = label[i], label[near[i]]
            if a != b:
                out.append((int(docs[i]), int(docs[near[i]])))
                label = np.where(label == max(a, b), min(a, b), label)


def _described(width: int, per: int = COARSE):
    """Per text: doc_id, the number of shingles, two digests of the set, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, d1, d2, sk = [], [], [], []
                for _, s in shingle_sets(part.column("text"), width):
                    n.append(len(s))
                    d1.append(int(mix(s).sum(dtype=np.uint64)) - (1 << 63))
                    d2.append(int(mix(s ^ U(0x5555)).sum(dtype=np.uint64)) - (1 << 63))
                    sk.append(sketch(s, per) if len(s) else b"")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sk, pa.binary())], names=["doc_id", "n", "d1", "d2", "sketch"])

    return run


def _signed(width: int, num: int, den: int, buckets: int):
    """(bucket, b): the signatures of a batch of texts with their doc_ids, as bytes, by bucket of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, docs, held = [], [], 0
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                for i, s in shingle_sets(part.column("text"), width):
                    if len(s):
                        sigs.append(signatures(s, num, den))
                        docs.append(np.full(len(sigs[-1]), ids[i], np.int64))
                        held += len(sigs[-1])
                if held >= 1 << 18:
                    yield packed(sigs, docs)
                    sigs, docs, held = [], [], 0
        if sigs:
            yield packed(sigs, docs)

    def packed(sigs: list, docs: list) -> pa.RecordBatch:
        s, d = np.concatenate(sigs), np.concatenate(docs)
        bucket = ((s >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, s, d = bucket[order], s[order], d[order]
        ends = np.r_[np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
        blobs, at = [], 0
        for e in ends:
            blobs.append(s[at:e].tobytes() + d[at:e].tobytes())
            at = e
        return pa.RecordBatch.from_arrays([pa.array(bucket[ends - 1]), pa.array(blobs, pa.binary())], names=["bucket", "b"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, size, doc_id) of each set of documents that share a signature, once a task; rows come sorted by bucket."""
    seen: set[int] = set()

    def done(blobs: list[bytes]) -> pa.RecordBatch | None:
        s = np.concatenate([np.frombuffer(b, np.uint64, len(b) // 16) for b in blobs])
        d = np.concatenate([np.frombuffer(b, np.int64, len(b) // 16, len(b) // 2) for b in blobs])
        order = np.lexsort((d, s))
        s, d = s[order], d[order]
        once = np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])]
        s, d = s[once], d[once]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[first, len(s)])
        many = size >= 2
        if not many.any():
            return None
        digest = np.add.reduceat(mix(d.view(np.uint64)), first)
        keep = []
        for i in np.flatnonzero(many):
            g = int(digest[i])
            if g not in seen:
                seen.add(g)
                keep.append(i)
        if not keep:
            return None
        keep = np.array(keep)
        at = np.repeat(first[keep], size[keep]) + np.arange(size[keep].sum()) - np.repeat(np.r_[0, np.cumsum(size[keep])[:-1]], size[keep])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(digest[keep].view(np.int64), size[keep])), pa.array(np.repeat(size[keep], size[keep])), pa.array(d[at])], names=["grp", "size", "doc_id"])

    bucket, blobs = None, []
    for batch in batches:
        for k, b in zip(batch.column("bucket").to_pylist(), batch.column("b").to_pylist(), strict=True):
            if k != bucket and blobs:
                if (out := done(blobs)) is not None:
                    yield out
                blobs = []
            bucket = k
            blobs.append(b)
    if blobs and (out := done(blobs)) is not None:
        yield out


def _by_block(columns: list[str], pick):
    """``columns`` of what ``pick`` makes of each block of a group of two members or more; rows come sorted by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat((rest, pdf), ignore_index=True)
            if not len(pdf):
                continue
            key = pdf["grp"].to_numpy()
            block = pdf["block"].to_numpy()
            own = (key == key[-1]) & (block == block[-1])
            rest = pdf[own]
            yield picked(pdf[~own])
        if rest is not None and len(rest):
            yield picked(rest)

    def picked(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, ...]] = []
        if len(pdf):
            g, blk = pdf["grp"].to_numpy(), pdf["block"].to_numpy()
            docs, n, label, sk = pdf["doc_id"].to_numpy(), pdf["n"].to_numpy(), pdf["label"].to_numpy(), pdf["sketch"].tolist()
            first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (blk[1:] != blk[:-1])])
            for a, e in zip(first, np.r_[first[1:], len(g)], strict=True):
                if e - a > 1:
                    out += [(g[a], blk[a], *row) for row in pick(docs[a:e], n[a:e], sk[a:e], label[a:e])]
        return pd.DataFrame(out, columns=columns, dtype=np.int64)

    return run


def _candidates(every: bool, num: int, den: int):
    """(grp, block, a, b): candidate pairs of each block."""
    pick = lambda docs, n, sk, label: [(min(p), max(p)) for p in _forest(docs, n, sk, label, every, num, den) if p[0] != p[1]]
    return _by_block(["grp", "block", "a", "b"], pick)


def _near_others(num: int, den: int):
    """(grp, block, doc_id, label) of the members that may be similar to one of another label."""

    def pick(docs: np.ndarray, n: np.ndarray, sk: list[bytes], label: np.ndarray) -> list[tuple[int, int]]:
        _, fits = _fitting(n, sk, num, den)
        near = (fits & (label[:, None] != label[None, :])).any(axis=1)
        return list(zip(docs[near].tolist(), label[near].tolist(), strict=True))

    return _by_block(["grp", "block", "doc_id", "label"], pick)


def _sets(width: int):
    """(doc_id, s): the sorted shingle hashes of each text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for _, s in shingle_sets(part.column("text"), width)], pa.binary())], names=["doc_id", "s"])

    return run


def _similar(num: int, den: int):
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(a: bytes, b: bytes) -> bool:
            p, q = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = np.concatenate((p, q))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            return den * common >= num * (len(p) + len(q) - common)

        return pd.Series([one(a, b) for a, b in zip(x, y, strict=True)], dtype=bool)

    return F.pandas_udf(run, "boolean")


def _once(cells: DataFrame) -> DataFrame:
    """Of the cells (grp, block, doc_id, label) that hold the same members one, as they hold the same pairs."""
    h = F.xxhash64("doc_id", "label")
    held = cells.groupBy("grp", "block").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 8)).alias("y"))
    return cells.join(held.groupBy("n", "x", "y").agg(F.min(F.struct("grp", "block")).alias("one")).select("one.*"), ["grp", "block"], "left_semi")


def similar_groups(docs: DataFrame, width: int = 5, num: int = 3, den: int = 4, block: int = 1024, few: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, and component_id, the least doc_id that links of Jaccard similarity num / den or more lead to.

    Copies of one set are a class and take part once. Documents that share a signature form a group, whose members are
    held against each other by their sketches, about ``block`` members at a time: a spanning forest of what may be
    similar is verified on the whole sets, first in ``few`` groups of each document, then what lies outside a group's
    largest component against its other members, of those only what finer sketches don't tell apart and of cells with the
    same members one, and where the forest held a pair that isn't similar every pair that may be and still lies in
    different components. So no link is lost and no group is expanded into all its pairs.

    Defined results: null or empty texts have no shingles and are their own component; a null doc_id takes no part and
    has no component; rows that repeat a doc_id are one vertex that all their texts link. ids are integers.
    """
    batches_by_bytes(docs.sparkSession)
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = cut(d.mapInArrow(tidy(_described(width)), "doc_id long, n long, d1 long, d2 long, sketch binary"))
    some = known.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # rows that repeat a doc_id sign, but their sketch and set are those of all their texts' representatives
    classes = some.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    copies = cut(some.join(classes, ["n", "d1", "d2"]).filter(F.col("doc_id") != F.col("rep")).select("doc_id", "rep").distinct())
    repeated = some.groupBy("doc_id").agg(F.count_distinct("n", "d1", "d2").alias("k")).filter("k > 1").select("doc_id")
    out_of_play = broadcast_if_small(cut(copies.select("doc_id").distinct().join(repeated, "doc_id", "left_anti")))
    reps = d.filter(F.col("doc_id").isNotNull()).join(out_of_play, "doc_id", "left_anti")
    buckets = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = reps.mapInArrow(tidy(_signed(width, num, den, buckets)), "bucket long, b binary")
    groups = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_grouped), "grp long, size long, doc_id long")
    groups = cut(groups.distinct())
    sketches = some.join(out_of_play, "doc_id", "left_anti").select("doc_id", "n", "d1", "sketch").distinct()
    # a group of several parts is first compared part by part, the least member with each of them
    sized = groups.withColumn("parts", F.ceil(F.col("size") / F.lit(float(block))).cast("int"))
    members = cut(sized.select("grp", F.pmod(F.xxhash64("doc_id", "grp"), F.col("parts")).alias("block"), "doc_id"))
    least = sized.filter("parts > 1").groupBy("grp", "parts").agg(F.min("doc_id").alias("doc_id"))
    least = least.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("block"), "doc_id")
    verify = _similar(num, den)

    def by_block(rows: DataFrame, sketches: DataFrame) -> DataFrame:
        rows = rows.join(sketches, "doc_id").select("grp", "block", "doc_id", "n", "label", "sketch")
        return rows.repartition("grp", "block").sortWithinPartitions("grp", "block")

    def checked(rows: DataFrame, sketches: DataFrame, every: bool, done: DataFrame | None) -> DataFrame:
        """(grp, block, a, b, ok) of the candidate pairs of ``rows`` (grp, block, doc_id, label), ``done`` aside."""
        found = by_block(rows, sketches).mapInPandas(tidy(_candidates(every, num, den)), "grp long, block long, a long, b long")
        found = cut(found if done is None else found.join(done, ["a", "b"], "left_anti"))
        pairs = found.select("a", "b").distinct()
        ids = broadcast_if_small(cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()))
        sets = cut(reps.join(ids, "doc_id", "left_semi").mapInArrow(tidy(_sets(width)), "doc_id long, s binary"))
        x, y = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y"))
        tested = cut(pairs.join(x, "a").join(y, "b").select("a", "b", verify("x", "y").alias("ok")).groupBy("a", "b").agg(F.max("ok").alias("ok")))
        return found.join(tested, ["a", "b"])

    def labelled(members: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
        """``members`` with the component each lies in as its label, of groups that still have several."""
        m = members.join(found, members["doc_id"] == found["id"], "left").select(*by, "doc_id", F.coalesce("component", "doc_id").alias("label"))
        several = m.groupBy(by).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select(by)
        return m.join(several, by, "left_semi")

    # first each document in ``few`` of its groups, the same ones for documents that share most groups
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("grp", "block"), "grp", "block")
    chosen = members.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= few).select("grp", "block", "doc_id")
    chosen = chosen.unionByName(least).distinct().withColumn("label", F.col("doc_id"))
    one = checked(chosen, sketches, False, None)
    links = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).unionByName(one.filter("ok").select("a", "b"))
    found = components(links)
    # then what else may be similar across components: finer sketches of the members that the coarse ones don't tell apart
    apart = cells(cut(labelled(members, found, ["grp"])), "doc_id", block // 2).select("grp", F.col("cell").alias("block"), "doc_id", "label").distinct()
    near = by_block(apart, sketches).mapInPandas(tidy(_near_others(num, den)), "grp long, block long, doc_id long, label long")
    near = cut(near.distinct())
    if near.limit(1).count():
        own = broadcast_if_small(cut(near.select("doc_id").distinct()))
        fine = reps.join(own, "doc_id", "left_semi").mapInArrow(tidy(_described(width, FINE)), "doc_id long, n long, d1 long, d2 long, sketch binary")
        fine = cut(fine.filter("n > 0").select("doc_id", "n", "d1", "sketch").distinct())
        near = by_block(near, fine).mapInPandas(tidy(_near_others(num, den)), "grp long, block long, doc_id long, label long")
        near = cut(_once(cut(near.distinct())))
    if near.limit(1).count():
        two = cut(checked(near, fine, False, None))
        links = links.unionByName(two.filter("ok").select("a", "b"))
        failed = cut(two.filter(~F.col("ok")).select("grp", "block").distinct())
        if two.filter("ok").limit(1).count():
            found = components(links)
        if failed.limit(1).count():  # and in blocks where such a pair wasn't similar, every one
            done = one.select("a", "b").unionByName(two.select("a", "b")).distinct()
            three = cut(checked(labelled(near.drop("label").join(failed, ["grp", "block"], "left_semi"), found, ["grp", "block"]), fine, True, done))
            if three.filter("ok").limit(1).count():
                found = components(links.unionByName(three.filter("ok").select("a", "b")))
    j = known.select("doc_id", "n").join(found, known["doc_id"] == found["id"], "left")
    return j.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, num: int = 3, den: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the least doc_id of their component, columns unchanged; rows without doc_id stay. Of rows that repeat it all stay."""
    found = similar_groups(docs, width, num, den, doc_id=doc_id, text=text)
    gone = broadcast_if_small(cut(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()))
    return as_rows(docs).join(gone, F.col("r")[doc_id].cast("long") == F.col("_gone"), "left_anti").select("r.*")
