"""Benchmark decontamination by winnowing.

Every span of ``window`` words shared by a document and a benchmark item is found: from each window both sides keep the
smallest hash of its ``gram``-word grams, so two equal windows always keep the same fingerprint. Documents that hold a
fingerprint of the benchmark are then extended to exact window hits. Items shorter than the window count as one window
of their own length, with a fingerprint window of that length.

Defined results: null or empty texts have no words and no hits; a null item id never appears in a list of items; rows
that repeat a doc_id each give one row, hit by their own text; an empty benchmark hits nothing. Only the named id and
text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_rows, broadcast_if_small, cut, lower_ascii, split_words

#: Whatever is neither digit, a-z nor beyond ASCII, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
SECOND = 7919


def words(text: Column) -> Column:
    return split_words(lower_ascii(text), SEPARATORS)


def _starts(array: Column, width: int) -> Column:
    """1, 2, ... for each start of ``width`` elements, none if there are fewer."""
    return F.when(F.size(array) >= width, F.sequence(F.lit(1), F.size(array) - (width - 1))).otherwise(F.array().cast("array<int>"))


def _fingerprints_of(df: DataFrame, keys: list[str], n: int, gram: int) -> DataFrame:
    k = min(gram, n)
    width = n - k + 1
    grams = F.transform(_starts(F.col("w"), k), lambda i: F.xxhash64(F.lit(n), F.slice("w", i, k)))
    hashed = df.filter(F.size("w") >= n).select(*keys, grams.alias("g"))
    least = F.transform(_starts(F.col("g"), width), lambda i: F.array_min(F.slice("g", i, width))) if width > 1 else F.col("g")
    return hashed.select(*keys, F.explode(F.array_distinct(least)).alias("fp"))


def _fingerprints(df: DataFrame, keys: list[str], lengths: list[int], gram: int) -> DataFrame:
    """(keys, fp): the minimum gram hash of each window, for each window length."""
    return reduce(DataFrame.unionByName, [_fingerprints_of(df, keys, n, gram) for n in lengths])


def _windows(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, pos, n, h1, h2) for each window of ``n`` words; the two hashes stand for the words."""
    hashed = F.transform(_starts(F.col("w"), n), lambda i: F.struct(F.xxhash64(F.slice("w", i, n)).alias("h1"), F.xxhash64(F.lit(SECOND), F.slice("w", i, n)).alias("h2")))
    return df.filter(F.size("w") >= n).select(*keys, F.posexplode(hashed).alias("pos", "h")).select(*keys, "pos", F.lit(n).alias("n"), "h.h1", "h.h2")


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hits, items): hits has (doc_id, _t, pos, n) for each window hit, items (doc_id, _t, item_id) for each item hit; _t is a hash of the text."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("w")).filter(F.size("w") > 0)
    lengths = sorted(r[0] for r in items.select(F.least(F.size("w"), F.lit(window))).distinct().collect())  # at most ``window`` numbers
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("_t"), words(F.col(text)).alias("w"))
    if not lengths:
        none = d.filter(F.lit(False))
        return none.select("doc_id", "_t", F.lit(0).alias("pos"), F.lit(0).alias("n")), none.select("doc_id", "_t", F.lit(None).cast("long").alias("item_id"))
    own = {n: items.filter(F.size("w") == n) if n < window else items.filter(F.size("w") >= n) for n in lengths}
    known = broadcast_if_small(cut(reduce(DataFrame.unionByName, [_fingerprints_of(own[n], [], n, gram) for n in lengths]).distinct()))
    wins = cut(reduce(DataFrame.unionByName, [_windows(own[n], ["item_id"], n).drop("pos") for n in lengths]).distinct())
    cand = cut(_fingerprints(d, ["doc_id", "_t"], lengths, gram).join(known, "fp", "left_semi").select("doc_id", "_t").distinct())
    cand = broadcast_if_small(cand.withColumnsRenamed({"doc_id": "c_id", "_t": "c_t"}))
    near = d.join(cand, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("_t") == F.col("c_t")), "left_semi")
    spans = reduce(DataFrame.unionByName, [_windows(near, ["doc_id", "_t"], n) for n in lengths])
    distinct = wins.select("n", "h1", "h2").distinct()
    hits = cut(spans.join(broadcast_if_small(cut(distinct)), ["n", "h1", "h2"], "left_semi"))
    held = hits.select("doc_id", "_t", "n", "h1", "h2").distinct().join(broadcast_if_small(wins), ["n", "h1", "h2"])
    return hits.select("doc_id", "_t", "pos", "n"), held.select("doc_id", "_t", "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside a hit window), n_items, items (sorted ids as strings), spans (hit word ranges, end exclusive)."""
    hits, held = find_hits(docs, benchmark, window, gram, doc_id, text, item_id, item_text)
    first = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("runs"))

    def add(acc: Column, s: Column) -> Column:
        end = s["pos"] + s["n"]
        start = F.greatest(s["pos"], acc["end"])
        grown = F.when(end > start, F.concat(acc["runs"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["runs"])
        return F.struct(F.greatest(acc["end"], end).alias("end"), grown.alias("runs"))

    # the first element of a run carries on where the last ended; one row of hits is no longer than its document
    runs = hits.groupBy("doc_id", "_t").agg(F.array_sort(F.collect_set(F.struct("pos", "n"))).alias("s")).select("doc_id", "_t", F.aggregate("s", first, add, lambda a: a["runs"]).alias("spans"))
    ids = held.filter(F.col("item_id").isNotNull()).groupBy("doc_id", "_t").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = runs.join(ids, runs["doc_id"].eqNullSafe(ids["doc_id"]) & (runs["_t"] == ids["_t"]), "left").select(runs["doc_id"].alias("f_id"), runs["_t"].alias("f_t"), "spans", "items")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("_t"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    joined = d.join(found, d["doc_id"].eqNullSafe(F.col("f_id")) & (d["_t"] == F.col("f_t")), "left")
    lengths = F.transform("spans", lambda s: (s["end"] - s["start"]).cast("long"))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce(F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no window with any item, columns unchanged."""
    hits, _ = find_hits(docs, benchmark, window, gram, doc_id, text)
    bad = broadcast_if_small(cut(hits.select(F.col("doc_id").alias("_bad_id"), F.col("_t").alias("_bad_t")).distinct()))
    row = F.col("r")
    return as_rows(docs).join(bad, row[doc_id].eqNullSafe(F.col("_bad_id")) & (F.xxhash64(row[text]) == F.col("_bad_t")), "left_anti").select("r.*")
