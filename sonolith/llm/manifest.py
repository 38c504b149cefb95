"""Merkle manifest of a table: a tree of SHA-256 digests for each group of rows, and a tree over the groups.

A row's leaf is the digest of its fields. Leaves of a group ascend by the order column and are numbered by a range
partition and counts of its partitions, so that no group comes together in a task. Aligned blocks of ``8**block`` leaves
are the unit of work: their roots are made first, the tree above them is built level by level as grouped rows, and its
paths are handed down again from the root. Then each block is traversed leaf by leaf (fractal traversal): its levels are
cut into stacked subtrees, of which the one above the current leaf exists whole and the next one, the desired, grows by
one leaf a step, so that successive paths need the nodes of two subtrees a stack and never the whole block's.

Defined results: an empty table gives no rows; a null field counts as ``-``; null groups and null orders come first;
rows of one order are told apart by their leaves, and equal rows share the leaf but not the place; columns that aren't
named are neither read nor returned, whatever they are called.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut

ARITY = 8
#: Levels of a block unless told otherwise, and of each subtree of its traversal.
BLOCK, HEIGHT = 4, 2
PATH = "array<struct<left:string,right:string>>"


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of ``fields``: each ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    told = [F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.sha2(F.concat(*told), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` leads to by ``path``."""
    return F.aggregate(path, start, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of ``path``, level by level and left to right, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def digest(children: Sequence[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def root_of(leaves: Sequence[str], levels: int) -> str:
    for _ in range(levels):
        leaves = [digest(leaves[i : i + ARITY]) for i in range(0, len(leaves), ARITY)]
    return leaves[0]


class Subtree:
    """The nodes of levels ``base`` to ``top`` - 1 below one node of level ``top``, fed leaf by leaf."""

    def __init__(self, leaves: Sequence[str], base: int, top: int, start: int) -> None:
        self.leaves, self.base, self.top, self.start = leaves, base, top, start
        self.at, self.end = start, min(start + ARITY**top, len(leaves))
        self.nodes: dict[int, list[str]] = {level: [] for level in range(base, top)}
        self.open: list[list[str]] = [[] for _ in range(top)]  # at each level the children of an unfinished node

    def _add(self, level: int, node: str) -> None:
        if level >= self.base:
            self.nodes[level].append(node)
        self.open[level].append(node)
        if len(self.open[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        own, self.open[level] = self.open[level], []
        if own and level + 1 < self.top:
            self._add(level + 1, digest(own))

    def step(self) -> None:
        """Takes one leaf more, if there is one; the last one closes what is unfinished."""
        if self.at < self.end:
            self._add(0, self.leaves[self.at])
            self.at += 1
            if self.at == self.end:
                for level in range(self.top):
                    self._close(level)

    def whole(self) -> Subtree:
        while self.at < self.end:
            self.step()
        return self


def traverse(leaves: Sequence[str], levels: int, height: int = HEIGHT) -> Iterator[list[tuple[str, str]]]:
    """For each leaf its path: at each of ``levels`` levels its siblings to the left and to the right, each as one text."""
    bands = [(base, min(base + height, levels)) for base in range(0, levels, height)]
    exist = [Subtree(leaves, base, top, 0).whole() for base, top in bands]
    desired = [Subtree(leaves, base, top, ARITY**top) for base, top in bands]
    for i in range(len(leaves)):
        path = []
        for k, (base, top) in enumerate(bands):
            span = ARITY**top
            if i and i % span == 0:
                exist[k], desired[k] = desired[k], Subtree(leaves, base, top, i + span)
            for level in range(base, top):
                own = (i - exist[k].start) // ARITY**level
                first = own - own % ARITY
                run = exist[k].nodes[level][first : first + ARITY]
                path.append(("".join(run[: own - first]), "".join(run[own - first + 1 :])))
            desired[k].step()
        yield path


def _levels(n: int) -> int:
    """How often ``n`` nodes are taken by eights until one remains."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def _numbered(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``rows`` with _pos, the place from 0 among the rows of its ``key`` by ``order``, and _n, their number.

    Keys are not null. Rows are dealt by ranges of (key, order); a partition's rows of a key are counted, and the counts before it added.
    """
    low = F.lit((1 << 33) - 1)
    dealt = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).withColumn("_id", F.monotonically_increasing_id())
    dealt = cut(dealt)
    part = F.shiftrightunsigned("_id", 33)
    counts = dealt.groupBy(key, part.alias("_part")).agg(F.min(F.col("_id").bitwiseAND(low)).alias("_first"), F.count("*").alias("_c"))
    by = Window.partitionBy(key).orderBy("_part")
    counts = counts.select(key, "_part", (F.sum("_c").over(by) - F.col("_c") - F.col("_first")).alias("_shift"), F.sum("_c").over(Window.partitionBy(key)).alias("_n"))
    out = dealt.withColumn("_part", part).join(broadcast_if_small(cut(counts)), [key, "_part"])
    return out.withColumn("_pos", F.col("_id").bitwiseAND(low) + F.col("_shift")).drop("_id", "_part", "_shift")


def _climb(nodes: DataFrame) -> list[tuple[DataFrame, DataFrame | None]]:
    """From nodes (k, pos, n, digest), ``n`` those of k: for each level the nodes that are alone in their k, and the others by eights (k, pos, n, kids)."""
    out = []
    while True:
        nodes = cut(nodes)
        many = nodes.filter("n > 1")
        if many.isEmpty():
            return [*out, (nodes, None)]
        runs = many.groupBy("k", F.floor(F.col("pos") / ARITY).alias("pos")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("kids"))
        runs = cut(runs.select("k", "pos", F.ceil(F.col("n") / ARITY).alias("n"), F.col("kids.digest").alias("kids")))
        out.append((nodes.filter("n = 1"), runs))
        nodes = runs.select("k", "pos", "n", F.sha2(F.array_join("kids", ""), 256).alias("digest"))


def _descend(levels: list[tuple[DataFrame, DataFrame | None]], above: DataFrame) -> DataFrame:
    """(k, pos, path, top, and the other columns of ``above``) of the lowest level's nodes; ``above`` (k, path) is what stands over each k's root, top."""
    rest = [c for c in above.columns if c not in ("k", "path")]
    own, found = ["k", "pos", "path", "top", *rest], None
    for alone, runs in reversed(levels):
        at = alone.select("k", "pos", F.col("digest").alias("top")).join(above, "k").select(own)
        if runs is not None and found is not None:
            side = lambda i, n: F.array_join(F.slice("kids", i, n), "")
            kids = runs.select("k", "pos", "kids").join(found, ["k", "pos"]).select("*", F.posexplode("kids").alias("j", "_kid"))
            step = F.struct(side(F.lit(1), F.col("j")).alias("left"), side(F.col("j") + 2, F.lit(ARITY)).alias("right"))
            kids = kids.withColumn("path", F.concat(F.array(step), F.col("path"))).withColumn("pos", F.col("pos") * ARITY + F.col("j"))
            at = at.unionByName(kids.select(own))
        found = at
    return found


def manifest(table: DataFrame, fields: Sequence[str], group: str, order: str, keep: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """For each row: the columns ``keep`` (``order`` if none), leaf, subroot (of its group), root and path (an array of left and right siblings, from the leaf to the root)."""
    whole = F.struct(*[F.col(f"`{c}`") for c in keep or (order,)]).alias("r")
    rows = cut(table.select(whole, F.col(f"`{group}`").alias("_g"), F.col(f"`{order}`").alias("_o"), leaf([F.col(f"`{c}`") for c in fields]).alias("leaf"), F.monotonically_increasing_id().alias("_row")))
    groups = rows.groupBy("_g").count().select("_g", F.lit(0).cast("long").alias("k"))
    groups = cut(_numbered(groups, "k", [F.col("_g").asc_nulls_first()]).select(F.col("_g").alias("_h"), F.col("_pos").alias("k"), "_n"))
    rows = rows.join(broadcast_if_small(groups.select("_h", "k")), F.col("_g").eqNullSafe(F.col("_h"))).select("k", "_o", "leaf", "r", "_row")
    rows = _numbered(rows, "k", [F.col("_o").asc_nulls_first(), F.col("leaf").asc(), F.col("_row").asc()])
    rows = cut(rows.select("k", F.floor(F.col("_pos") / ARITY**block).alias("pos"), "_pos", "_n", "leaf", "r"))

    def root(at: pa.Table) -> pa.Table:
        at = at.sort_by("_pos")
        n = at.column("_n")[0].as_py()
        return pa.table({"k": at.column("k")[:1], "pos": at.column("pos")[:1], "n": pa.array([-(-n // ARITY**block)], pa.int64()), "digest": [root_of(at.column("leaf").to_pylist(), min(block, _levels(n)))]})

    blocks = rows.select("k", "pos", "_pos", "_n", "leaf").groupBy("k", "pos").applyInArrow(root, "k long, pos long, n long, digest string")
    trees = _climb(blocks)
    alone = [single.select("k", "digest") for single, _ in trees]
    many = groups.agg(F.max("_n")).first()[0] or 0
    over = _climb(functools.reduce(DataFrame.unionByName, alone).select(F.lit(0).cast("long").alias("k"), F.col("k").alias("pos"), F.lit(many).cast("long").alias("n"), "digest"))
    nothing = table.sparkSession.range(1).select(F.col("id").alias("k"), F.array().cast(PATH).alias("path"))
    roots = _descend(over, nothing).select(F.col("pos").alias("k"), "path", F.col("top").alias("root"))
    paths = cut(_descend(trees, cut(roots)).select("k", "pos", "path", F.col("top").alias("subroot"), "root"))

    def traversed(at: pa.Table, over: pa.Table) -> pa.Table:
        at = at.sort_by("_pos")
        levels, n = min(block, _levels(at.column("_n")[0].as_py())), len(at)
        upper = over.column("path")[0].as_py()
        left, right = [], []
        for path in traverse(at.column("leaf").to_pylist(), levels):
            left += [*[a for a, _ in path], *[s["left"] for s in upper]]
            right += [*[b for _, b in path], *[s["right"] for s in upper]]
        steps = levels + len(upper)
        path = pa.ListArray.from_arrays(pa.array(range(0, n * steps + 1, steps) if steps else [0] * (n + 1), pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]))
        same = lambda c: pa.array([over.column(c)[0].as_py()] * n, pa.string())
        return pa.table({"r": at.column("r"), "leaf": at.column("leaf"), "subroot": same("subroot"), "root": same("root"), "path": path})

    kind = rows.schema["r"].dataType.simpleString()
    out = rows.groupBy("k", "pos").cogroup(paths.groupBy("k", "pos")).applyInArrow(traversed, f"r {kind}, leaf string, subroot string, root string, path {PATH}")
    return out.select(*[F.col(f"r.`{c}`") for c in keep or (order,)], "leaf", "subroot", "root", "path")
