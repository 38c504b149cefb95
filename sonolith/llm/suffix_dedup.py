"""Exact repeated-span removal by a depth-limited radix sort of suffixes.

Every start of ``depth`` bytes in a text is a suffix, and suffixes are told apart by most-significant-digit passes down to
``depth`` bytes and no further; the groups that stay equal through the last pass are exactly the repeated windows.

First digit: a suffix is led to the smallest hash of a ``GRAM``-byte gram within its first ``depth`` bytes (equal windows
are led to the same gram at the same distance), so neighbouring suffixes with the same leading gram form a run that one
row stands for. Suffixes whose leading gram is unique can't repeat and drop out. Second digit: the bytes of a whole run;
runs equal in them form a class, all of whose suffixes repeat if it has two rows. Last digit: where several classes share
a gram, a suffix of each is told apart by its distance from the gram and the whole window of ``depth`` bytes. Equal rows
are pre-aggregated counts that are joined back, so a passage that a third of all documents hold is one class; a gram of
more than ``group`` classes takes its last pass as rows counted across tasks instead of within one.

Defined results: null is an empty text; texts of fewer than ``depth`` bytes lose nothing; spans are judged on the input;
rows that repeat a doc_id are texts of their own. Windows are compared by two independent 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, broadcast_if_small, cut
from .hashing import PIECE, arrays, prefix_sums, span_hashes, tidy

GRAM = 32
#: Runs or spans a broadcast side may hold, some 50 MB.
ELEMENTS = 800_000
#: Neighbouring distances from a gram that are told apart together first.
BLOCK = 32


def _window_min(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, from running minima to both sides of every width-th element."""
    blocks = np.full(-(-len(v) // width) * width, np.iinfo(v.dtype).max, v.dtype)
    blocks[: len(v)] = v
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(behind[: len(v) - width + 1], ahead[width - 1 : len(v)])


def runs_of(data: np.ndarray, starts: list[int], lengths: list[int], depth: int) -> tuple[np.ndarray, ...]:
    """(first suffix, last suffix, gram, gram hash, hash of all bytes) of each run; pieces of a text lie at ``starts`` of ``data``."""
    sums = prefix_sums(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = span_hashes(sums, at, at + GRAM)
    low = np.uint64(0xFFFFFFFF)
    least = _window_min((gram & ~low) | (low - at.astype(np.uint64)), depth - GRAM + 1)  # of equal grams the last
    fits = np.zeros(len(least), bool)
    for s, n in zip(starts, lengths, strict=True):
        fits[s : s + n - depth + 1] = True
    suffix = np.flatnonzero(fits)
    led = (low - (least[suffix] & low)).astype(np.int64)
    new = np.r_[True, (np.diff(led) != 0) | (np.diff(suffix) != 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(suffix)] - 1
    a, e, m = suffix[first], suffix[last], led[first]
    return a, e, m, gram[m], span_hashes(prefix_sums(data, 1), a, e + depth, 1)


def _run_rows(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrays(batch.column("text"))
            pieces: list[tuple[int, int, np.ndarray]] = []
            held = 0
            for i in range(len(batch)):
                begin, end = offsets[i], offsets[i + 1]
                for s in range(0, end - begin - depth + 1, PIECE):  # a longer text is read in pieces that overlap by a window
                    piece = data[begin + s : min(end, begin + s + PIECE + depth - 1)]
                    if pieces and held + len(piece) > 2 * PIECE:
                        yield rows(batch, pieces)
                        pieces, held = [], 0
                    pieces.append((i, s, piece))
                    held += len(piece)
            if pieces:
                yield rows(batch, pieces)

    def rows(batch: pa.RecordBatch, pieces: list) -> pa.RecordBatch:
        lengths = [len(x) for _, _, x in pieces]
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        a, e, m, gram, whole = runs_of(np.concatenate([x for _, _, x in pieces]), starts.tolist(), lengths, depth)
        piece = np.searchsorted(starts, a, "right") - 1
        doc = np.array([i for i, _, _ in pieces])[piece]
        shift = np.array([s for _, s, _ in pieces])[piece] - starts[piece]
        take = pa.array(doc)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(take), batch.column("_t").take(take), pa.array(m + shift), pa.array((m - a).astype(np.int32)), pa.array((m - e).astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64))],
            names=["doc_id", "_t", "m", "far", "near", "gram", "whole"],
        )

    return run


CONTEXT = "gram long, far int, near int, whole long, c long, doc_id {id}, _t long, m long, b binary"


def _cut_contexts(batches: Iterator[pd.DataFrame], depth: int) -> Iterator[pd.DataFrame]:
    """The bytes of each run that stands for its class."""
    for pdf in batches:
        out = []
        for doc_id, t, text, runs in zip(pdf["doc_id"], pdf["_t"], pdf["text"], pdf["runs"], strict=True):
            data = text.encode()
            for r in runs:
                m, far, near = r["m"], r["far"], r["near"]
                out.append((r["gram"], far, near, r["whole"], r["c"], doc_id, t, m, data[m - far : m - near + depth]))
                if len(out) >= 2_000:
                    yield pd.DataFrame(out, columns=["gram", "far", "near", "whole", "c", "doc_id", "_t", "m", "b"])
                    out = []
        if out:
            yield pd.DataFrame(out, columns=["gram", "far", "near", "whole", "c", "doc_id", "_t", "m", "b"])


def _hashes(pdf: pd.DataFrame, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the bytes [start, end) of the rows of ``pdf`` numbered ``row``, which ascends."""
    sizes = pdf["b"].map(len).to_numpy()
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    data = np.frombuffer(b"".join(pdf["b"]), np.uint8)
    h0, h1 = np.empty(len(row), np.uint64), np.empty(len(row), np.uint64)
    j = 0
    while j < len(pdf):  # rows of PIECE bytes at a time, as a gram may have more bytes than there are powers
        k = max(j + 1, int(np.searchsorted(starts + sizes, starts[j] + PIECE, "right")))
        own = slice(*np.searchsorted(row, (j, k)))
        base = starts[row[own]] - starts[j]
        held = data[starts[j] : starts[k - 1] + sizes[k - 1]]
        h0[own], h1[own] = (span_hashes(prefix_sums(held, which), base + start[own], base + end[own], which) for which in (0, 1))
        j = k
    return h0, h1


def _both(h0: np.ndarray, h1: np.ndarray) -> np.ndarray:
    return h0 ^ (h1 * np.uint64(0xFF51AFD7ED558CCD))


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place within its row) of ``n`` items a row."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _suffixes(pdf: pd.DataFrame, depth: int, least: str = "near", most: str = "far") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, distance from the gram, two hashes) of the suffixes at distances ``least`` to ``most`` of each row, over whole windows of ``depth`` bytes."""
    lo, hi, far = (pdf[x].to_numpy() for x in (least, most, "far"))
    row, i = _spread(hi - lo + 1)
    distance = hi[row] - i
    at = far[row] - distance
    return row, distance, *_hashes(pdf, row, at, at + depth)


def _blocks(pdf: pd.DataFrame, depth: int) -> pd.DataFrame:
    """The distances of each row cut into blocks: (row, k, lo, hi, core, every), hashes of what all windows of the block share and of what they cover."""
    near, far = pdf["near"].to_numpy(), pdf["far"].to_numpy()
    row, i = _spread(far // BLOCK - near // BLOCK + 1)
    k = near[row] // BLOCK + i
    lo, hi = np.maximum(near[row], k * BLOCK), np.minimum(far[row], k * BLOCK + BLOCK - 1)
    core = _both(*_hashes(pdf, row, far[row] - k * BLOCK, far[row] - k * BLOCK - BLOCK + 1 + depth))
    every = _both(*_hashes(pdf, row, far[row] - hi, far[row] - lo + depth))
    as_int = lambda x: x.astype(np.int32)
    return pd.DataFrame({"row": row, "k": as_int(k), "lo": as_int(lo), "hi": as_int(hi), "core": core.view(np.int64), "every": every.view(np.int64)})


def _spans(pdf: pd.DataFrame, row: np.ndarray, distance: np.ndarray, repeated: np.ndarray, depth: int) -> pd.DataFrame:
    """(doc_id, _t, start, end) of the maximal runs of repeated suffixes, for classes of one row."""
    keep = repeated & (pdf["c"].to_numpy()[row] == 1)
    row, start = row[keep], (pdf["m"].to_numpy()[row] - distance)[keep]
    new = np.r_[True, (np.diff(row) != 0) | (np.diff(start) != 1)] if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(row)] - 1 if len(row) else first
    own = pdf.iloc[row[first]]
    return pd.DataFrame({"doc_id": own["doc_id"].to_numpy(), "_t": own["_t"].to_numpy(), "start": start[first].astype(np.int64), "end": (start[last] + depth).astype(np.int64)})


def _last_pass(batches: Iterator[pd.DataFrame], depth: int) -> Iterator[pd.DataFrame]:
    """Spans from contexts sorted by gram; a gram's contexts are few and may straddle batches."""

    def done(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        pdf = pdf.drop_duplicates(["gram", "far", "near", "whole"], ignore_index=True)
        for part in _parts(pdf):
            row, distance, h0, h1 = _suffixes(part, depth)
            key = np.empty(len(row), [("g", np.int64), ("d", np.int64), ("h", np.uint64)])
            key["g"], key["d"], key["h"] = part["gram"].to_numpy()[row], distance, _both(h0, h1)
            order = np.lexsort((key["h"], key["d"], key["g"]))
            s = key[order]
            group = np.cumsum(np.r_[False, s[1:] != s[:-1]]) if len(s) else np.zeros(0, int)
            total = np.bincount(group, part["c"].to_numpy()[row][order].astype(float))
            repeated = np.zeros(len(row), bool)
            repeated[order] = total[group] >= 2
            yield _spans(part, row, distance, repeated, depth)

    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat((rest, pdf), ignore_index=True)
        own = pdf["gram"].to_numpy() == pdf["gram"].iloc[-1] if len(pdf) else np.zeros(0, bool)
        rest = pdf[own]
        if not own.all():
            yield from done(pdf[~own])
    if rest is not None and len(rest):
        yield from done(rest)


def _parts(pdf: pd.DataFrame, size: int = 500) -> Iterator[pd.DataFrame]:
    """Slices of about ``size`` rows that end where a gram ends, so that few suffixes are held at a time."""
    gram = pdf["gram"].to_numpy()
    ends = np.r_[np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(pdf)]
    at = 0
    while at < len(pdf):
        fits = ends[(ends > at) & (ends <= at + size)]
        end = int(fits[-1]) if len(fits) else int(ends[ends > at][0])
        yield pdf.iloc[at:end].reset_index(drop=True)
        at = end


def repeated_spans(docs: DataFrame, depth: int = 400, group: int = 512) -> DataFrame:
    """(doc_id, _t, spans) of each text in (doc_id, _t, text) that holds bytes of a repeated window; spans are merged and sorted, end exclusive."""
    batches_by_bytes(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, _t long, m long, far int, near int, gram long, whole long"
    rows = cut(docs.mapInArrow(tidy(_run_rows(depth)), schema))
    key = ["gram", "far", "near", "whole"]
    classes = rows.groupBy(key).agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("doc_id", "_t", "m")])
    grams = classes.groupBy("gram").agg(F.sum("c").alias("n"), F.count("*").alias("d")).filter("n >= 2")
    held = cut(classes.join(grams, "gram"))
    whole = broadcast_if_small(held.filter("c >= 2").select(key))
    runs = rows.join(whole, key, "left_semi").select("doc_id", "_t", (F.col("m") - F.col("far")).alias("start"), (F.col("m") - F.col("near") + depth).alias("end"))
    # classes that share their gram with others: their suffixes are compared one by one
    mixed = held.filter("d >= 2")
    by_doc = mixed.groupBy("doc_id", "_t").agg(F.collect_list(F.struct("m", "far", "near", "gram", "whole", "c")).alias("runs")).withColumnsRenamed({"doc_id": "r_id", "_t": "r_t"})
    texts = docs.join(broadcast_if_small(cut(by_doc), ELEMENTS, F.size("runs")), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("_t") == F.col("r_t"))).select("doc_id", "_t", "text", "runs")
    contexts = texts.mapInPandas(tidy(lambda it: _cut_contexts(it, depth)), CONTEXT.format(id=kind))
    hot = broadcast_if_small(cut(held.filter(F.col("d") > group).select("gram").distinct()))
    span = f"doc_id {kind}, _t long, start long, end long"
    few = contexts.join(hot, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram").mapInPandas(tidy(lambda it: _last_pass(it, depth)), span)
    spans = runs.unionByName(few)
    if hot.limit(1).count():
        spans = spans.unionByName(_hot_spans(contexts.join(hot, "gram", "left_semi"), depth, kind))
    merged = spans.groupBy("doc_id", "_t").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    merge = F.pandas_udf(_merge, "array<struct<start:long,end:long>>")
    return merged.select("doc_id", "_t", merge("s").alias("spans"))


def _merge(spans: pd.Series) -> pd.Series:
    def one(own) -> list[dict]:
        out: list[list[int]] = []
        for s, e in sorted((x["start"], x["end"]) for x in own):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return [{"start": s, "end": e} for s, e in out]

    return spans.map(one)


def _sharing_a_half(contexts: DataFrame, key: list[str], depth: int) -> DataFrame:
    """The contexts that may hold a repeated window: a window holds half of its other bytes before its gram or half of them after it, so another context has that half too."""
    half = (depth - GRAM) // 2
    part = lambda start: F.xxhash64(F.substring("b", start + 1, F.lit(half + GRAM)))
    before = F.when(F.col("far") >= half, F.struct(F.lit(0).alias("side"), part(F.col("far") - half).alias("h")))
    after = F.when(F.col("near") <= depth - GRAM - half, F.struct(F.lit(1).alias("side"), part(F.col("far")).alias("h")))
    halves = cut(contexts.select(*key, F.inline(F.array_compact(F.array(before, after)))).distinct())
    side = ["gram", "side", "h"]
    shared = broadcast_if_small(cut(halves.groupBy(side).count().filter("count > 1").select(side)))
    kept = broadcast_if_small(cut(halves.join(shared, side, "left_semi").select(key).distinct()))
    return contexts.join(kept, key, "left_semi")


def _hot_spans(contexts: DataFrame, depth: int, kind: str) -> DataFrame:
    """The last pass for grams of too many contexts for one task, as rows counted and joined back.

    Two more digits come first. Contexts that share neither half with another are put aside. The distances of the others
    are cut into blocks of ``BLOCK``. A block whose core, the bytes all its
    windows share, occurs once holds no repeated window; blocks equal in all their bytes repeat as a whole; only where
    several kinds of block share a core, one of each kind is told apart suffix by suffix.
    """

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                yield pdf.iloc[i : i + 500].reset_index(drop=True)

    def in_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts(batches):
            out = _blocks(part, depth)
            yield pd.concat((part.drop(columns="b").iloc[out.pop("row").to_numpy()].reset_index(drop=True), out), axis=1)

    def in_suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts(batches):
            row, distance, h0, h1 = _suffixes(part, depth, "lo", "hi")
            own = part[["gram", "n", "doc_id", "_t", "m"]].iloc[row].reset_index(drop=True)
            yield own.assign(d=distance.astype(np.int32), h0=h0.view(np.int64), h1=h1.view(np.int64))

    key = ["gram", "far", "near", "whole"]
    once = cut(_sharing_a_half(contexts, key, depth).dropDuplicates(key))
    blocks = once.mapInPandas(tidy(in_blocks), f"gram long, far int, near int, whole long, c long, doc_id {kind}, _t long, m long, k int, lo int, hi int, core long, every long")
    core = ["gram", "k", "core"]
    kind_of = [*core, "lo", "hi", "every"]
    kinds = blocks.groupBy(kind_of).agg(F.sum("c").alias("n"), F.min(F.struct("far", "near", "whole")).alias("one"))
    start = lambda distance: (F.col("m") - F.col(distance)).alias("start")
    alike = blocks.filter("c = 1").join(kinds.filter("n >= 2").select(kind_of), kind_of, "left_semi").select("doc_id", "_t", start("hi"), (F.col("m") - F.col("lo") + depth).alias("end"))
    several = kinds.groupBy(core).agg(F.count("*").alias("_kinds")).filter("_kinds >= 2").select(core)
    ones = kinds.join(several, core, "left_semi").select("gram", "one.far", "one.near", "one.whole", "lo", "hi", "n")
    suffixes = once.join(ones, key).mapInPandas(tidy(in_suffixes), f"gram long, n long, doc_id {kind}, _t long, m long, d int, h0 long, h1 long")
    window = ["gram", "d", "h0", "h1"]
    repeated = suffixes.groupBy(window).agg(F.sum("n").alias("n")).filter("n >= 2").select(window)
    single = suffixes.filter("n = 1").join(repeated, window, "left_semi").select("doc_id", "_t", start("d"), (F.col("m") - F.col("d") + depth).alias("end"))
    return alike.unionByName(single)


def remove_repeats(docs: DataFrame, depth: int = 400, group: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, spans (removed byte ranges, end exclusive) and kept (the bytes that remain)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("_t"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = cut(repeated_spans(d.filter(F.octet_length("text") >= depth), depth, group)).withColumnsRenamed({"doc_id": "s_id", "_t": "s_t"})
    j = d.join(broadcast_if_small(spans, ELEMENTS, F.size("spans")), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("_t") == F.col("s_t")), "left")
    j = j.select("doc_id", F.encode("text", "utf-8").alias("b"), F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"))
    size = F.octet_length("b").cast("long")
    gaps = F.zip_with(F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"])), F.concat(F.transform("spans", lambda s: s["start"]), F.array(size)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = F.aggregate(gaps, F.lit(b"").cast("binary"), lambda acc, g: F.concat(acc, F.substr(F.col("b"), (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int"))))
    return j.select("doc_id", size.alias("n_bytes"), "spans", F.when(F.size("spans") == 0, F.col("b")).otherwise(kept).alias("kept"))
