"""Periodic runs of words, found with Lyndon arrays (Ellert and Fischer).

Words are numbered by their first occurrence; the numbers and their negatives are the two ordered alphabets. For each,
one pass from left to right links every suffix to the next smaller one and keeps the length that both share. A shared
length that was matched before is reused: the last pair of suffixes that reached furthest shows every later pair inside
it an earlier pair whose length is known, so words are compared again only beyond that reach, and the pass is linear.
The distance to the next smaller suffix is the length of a Lyndon word, and the shared length tells how far it repeats.
Each run of four periods or more shows up as the first of its Lyndon roots, extended to the left by less than a period.

A word that occurs once in its text lies in no run, so texts are cut there; stretches shorter than the shortest run are
passed over. Both steps are exact.

Defined results: null and empty texts have no words and no runs; rows that repeat a doc_id, and null doc_ids, each have
their own; columns of ``docs`` named as the new ones are replaced, all others are kept. Texts are read in slices of
bounded bytes, a longer text alone, in memory linear in its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_by_bytes
from .hashing import give_back, slices

SPACES = r"[\x20\x09-\x0D]+"
RUN = "array<struct<start:long,length:long,period:long>>"


def next_smaller(s: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix of ``s`` where the next smaller one starts, and the length both share; the empty suffix is the least."""
    n = len(s)
    after, shared = [n] * n, [0] * n  # the next smaller suffix
    before, common = [-1] * n, [0] * n  # the previous smaller suffix
    left = right = reach = 0  # the pair of suffixes matched furthest: s[left:] and s[right:reach] agree, s[reach] differs

    def extend(a: int, b: int, m: int) -> int:
        """The length that the suffixes at a < b share, known to be ``m`` at least."""
        nonlocal left, right, reach
        if b < reach:
            twin, rest = b - (right - left), reach - b
            if a == twin:
                return rest
            first = a - (right - left) if a >= right else a
            if first >= 0 and first < twin:
                known = shared[first] if after[first] == twin else common[twin] if before[twin] == first else -1
                if a >= right:
                    if 0 <= known < rest:
                        return known
                    if known >= rest:
                        m = max(m, rest)
                elif known >= 0:
                    if known != rest:
                        return min(known, rest)
                    m = max(m, rest)
        while b + m < n and s[a + m] == s[b + m]:
            m += 1
        if b + m > reach:
            left, right, reach = a, b, b + m
        return m

    for b in range(1, n):
        a = b - 1
        m = extend(a, b, 1) if s[a] == s[b] else 0
        while b + m == n or s[a + m] > s[b + m]:
            after[a], shared[a] = b, m
            held, a = common[a], before[a]
            if a < 0:
                m = 0
                break
            if held < m:  # the suffix at a is smaller than the one just left, by a word that the one at b shares
                m = held
                break
            if held == m:
                m = extend(a, b, m)
        before[b], common[b] = a, m
    return after, shared


def runs_of(s: list[int], shortest: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``shortest`` words and ``times`` (2 or more) periods, by start and period."""
    n, found = len(s), set()
    for letters in (s, [-x for x in s]):
        after, shared = next_smaller(letters)
        nss, lce = np.array(after, np.int64), np.array(shared, np.int64)
        period = nss - np.arange(n)
        # a run of ``times`` periods holds a first root with times - 1 periods, less what lies before it, behind it
        for i in np.flatnonzero((lce > 0) & (lce > (times - 2) * period)).tolist():
            p, end = int(period[i]), int(nss[i] + lce[i])
            if i >= p and after[i - p] == i and shared[i - p] >= p:
                continue  # not the first root of its run
            start = i
            while start > 0 and s[start - 1] == s[start - 1 + p]:
                start -= 1
            if end - start >= max(shortest, times * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _codes(part: pa.RecordBatch, text: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a slice, their numbers, and where each document's words start in them (and the last ends)."""
    column = pc.fill_null(part.column(text), "")
    words = pc.split_pattern_regex(column, pattern=SPACES)
    flat, owner = words.flatten(), pc.list_parent_indices(words)
    real = pc.not_equal(flat, "")
    flat, owner = flat.filter(real), owner.filter(real).to_numpy(zero_copy_only=False)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return flat, codes, np.searchsorted(owner, np.arange(len(part) + 1))


def _stretches(codes: np.ndarray, offsets: np.ndarray, shortest: int) -> Iterator[tuple[int, int]]:
    """Stretches of words that each occur twice or more in their document, of at least ``shortest`` words."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    _, which, count = np.unique(owner * (codes.max(initial=0) + 1) + codes, return_inverse=True, return_counts=True)
    again = count[which] > 1
    edge = np.flatnonzero(again & np.r_[True, ~again[:-1] | (owner[1:] != owner[:-1])]) if len(codes) else np.zeros(0, np.int64)
    stop = np.flatnonzero(again & np.r_[~again[1:] | (owner[1:] != owner[:-1]), True]) + 1 if len(codes) else edge
    long = stop - edge >= shortest
    return zip(edge[long].tolist(), stop[long].tolist(), strict=True)


def _found(part: pa.RecordBatch, text: str, shortest: int, times: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """n_words, runs and collapsed of a slice."""
    words, codes, offsets = _codes(part, text)
    kept = np.ones(len(codes), bool)
    rows: list[tuple[int, int, int, int]] = []
    for lo, hi in _stretches(codes, offsets, shortest):
        of = int(np.searchsorted(offsets, lo, "right")) - 1
        for start, length, period in runs_of(codes[lo:hi].tolist(), shortest, times):
            rows.append((of, lo + start - int(offsets[of]), length, period))
            kept[lo + start + period : lo + start + length] = False
    table = np.array(sorted(rows, key=lambda r: (r[0], r[1], r[3])), np.int64).reshape(-1, 4)
    run = pa.StructArray.from_arrays([pa.array(table[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(table[:, 0], np.arange(len(part) + 1)), pa.int32()), run)
    left = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)][offsets], pa.int32()), words.filter(pa.array(kept)))
    return pa.array(np.diff(offsets), pa.int64()), runs, pc.binary_join(left, " ")


def periodic_runs(docs: DataFrame, shortest: int = 6, times: int = 4, text: str = "text") -> DataFrame:
    """``docs`` with n_words, runs (array of start, length, period in words) and collapsed, the text with each run's repeats dropped and its words joined by one space."""
    if times < 2:
        raise ValueError("a run has two periods at least")
    batches_by_bytes(docs.sparkSession)
    new = ["n_words", "runs", "collapsed"]
    rest = [c for c in docs.columns if c not in new]
    at = "text" + "_" * max(map(len, ["", *docs.columns]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in slices(batch, at):
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], *_found(part, at, shortest, times)], [*rest, *new])
        finally:
            give_back()

    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField("n_words", T.LongType()), T.StructField("runs", T._parse_datatype_string(RUN)), T.StructField("collapsed", T.StringType())])
    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text).alias(at)).mapInArrow(run, schema)
