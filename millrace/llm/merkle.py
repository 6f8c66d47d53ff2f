"""A Merkle manifest of a dataset: every row gets its leaf digest and the proof that leads to one root.

Rows form trees, one for each value of a column, and the trees' roots form one more.  A tree is worked
off by time-forward processing: nodes are labelled by level and position, a priority queue ordered by
label delivers child digests to their parents, and a reversed sweep delivers proof suffixes from the
root back to the leaves.  Spark's sort is the external part of the queue: nodes are ordered and numbered
by ranges, and ``ARITY ** levels`` neighbours at a time are one block, swept in memory; what a block
sends upwards, its root, is a node of the next round, and what it gets back is one proof suffix.  Texts
never move: only digests are ordered and grouped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain, written

#: Neighbours that become one node of the next level.
ARITY = 2
#: Levels of one block; at two nodes a run, 4096 leaves are swept at a time.
LEVELS = 12

Label = tuple[int, int]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """Digest of one row: each field as UTF-8 byte count, colon, value; ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def height_of(nodes: int, arity: int = ARITY) -> int:
    """Levels above ``nodes`` leaves."""
    height = 0
    while nodes > 1:
        nodes, height = -(-nodes // arity), height + 1
    return height


def lift(leaves: Sequence[str], height: int, arity: int = ARITY) -> dict[Label, str]:
    """Digests of all nodes up to ``height``: messages are popped in label order, a node's all together."""
    queue = [((0, i), 0, d) for i, d in enumerate(leaves)]  # ascending, so a heap already
    known: dict[Label, str] = {}
    while queue:
        label, inbox = queue[0][0], []
        while queue and queue[0][0] == label:
            inbox.append(heappop(queue)[2])
        level, place = label
        known[label] = inbox[0] if level == 0 else digest("".join(inbox))
        if level < height:
            heappush(queue, ((level + 1, place // arity), place % arity, known[label]))
    return known


def proofs(known: dict[Label, str], height: int, suffix: str = "", arity: int = ARITY) -> list[str]:
    """Proof of every leaf, by the reversed sweep: each node hands its suffix, longer by a step, to its children.

    A step is ``left:right``, the joined digests of the run's others before and after; steps end in ``;``.
    """
    queue = [((-height, 0), suffix)]
    out: dict[int, str] = {}
    while queue:
        (level, place), above = heappop(queue)
        if level == 0:
            out[-place] = above
            continue
        first = -place * arity
        run = [known[-level - 1, i] for i in range(first, first + arity) if (-level - 1, i) in known]
        for k in range(len(run)):
            step = f"{''.join(run[:k])}:{''.join(run[k + 1:])};"
            heappush(queue, ((level + 1, -(first + k)), step + above))
    return [out[i] for i in range(len(out))]


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(F.filter(F.split(proof, ";"), lambda s: s != ""), leaf, lambda d, step: F.sha2(F.concat(
        F.substring_index(step, ":", 1), d, F.substring_index(step, ":", -1)), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof, level by level and left to right."""
    return F.translate(proof, ":;", "")


def _placed(nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``place``, the position within ``tree`` in the order of ``by``, and ``total``, the tree's size.

    Rows are sorted by ranges and counted by range and tree; no window runs over rows.  Equal rows are
    told apart by where they were read, so that many copies do not fall into one range.
    """
    keys = ["tree", *by, "read_at"]
    read = written(nodes).withColumn("read_at", F.monotonically_increasing_id())
    ordered = written(read.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("read_at").withColumn(
        "at", F.monotonically_increasing_id())).withColumn("range", F.shiftright("at", 33))
    before = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = ordered.groupBy("range", "tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).select(
        "range", "tree", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    return written(ordered.join(runs, ["range", "tree"]).withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop(
        "range", "at", "first", "before"))


def _swept(block: pa.Table, arity: int, levels: int) -> tuple[pa.Table, dict[Label, str], int]:
    block = block.sort_by("place")
    total = block.column("total")[0].as_py()
    height = levels if total > arity ** levels else height_of(block.num_rows, arity)
    return block, lift(block.column("digest").to_pylist(), height, arity), height


def _deliverer(keep: list[str], arity: int, levels: int):
    def deliver(block: pa.Table, sent: pa.Table) -> pa.Table:
        block, known, height = _swept(block, arity, levels)
        out = block.select(keep)
        for c in ("subroot", "root"):
            out = out.append_column(c, pa.array([sent.column(c)[0].as_py()] * len(out), pa.string()))
        return out.append_column("proof", pa.array(proofs(known, height, sent.column("proof")[0].as_py(), arity), pa.string()))
    return deliver


class Forest:
    """Trees over nodes ``tree, place, total, digest`` and further columns, lifted round by round."""

    def __init__(self, nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> None:
        self.arity, self.levels, self.size = arity, levels, arity ** levels
        self.rounds = [nodes]
        most = nodes.agg(F.max("total")).first()[0] or 0
        while True:
            self.rounds.append(self._lifted(self.rounds[-1]))
            most = -(-most // self.size)
            if most <= 1:
                return

    def _blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.expr(f"place div {self.size}"))

    def _lifted(self, nodes: DataFrame) -> DataFrame:
        arity, levels, size = self.arity, self.levels, self.size

        def root(block: pa.Table) -> pa.Table:
            block, known, height = _swept(block, arity, levels)
            first = block.slice(0, 1)
            return pa.table({
                "tree": first.column("tree"), "place": first.column("block"),
                "total": pa.array([-(-first.column("total")[0].as_py() // size)], pa.int64()), "digest": [known[height, 0]]})

        narrow = self._blocks(nodes.select("tree", "place", "total", "digest"))
        return written(narrow.groupBy("tree", "block").applyInArrow(root, "tree string, place long, total long, digest string"))

    @property
    def roots(self) -> DataFrame:
        """``tree, digest``: the root of every tree."""
        return self.rounds[-1].select("tree", "digest")

    def proofs(self, told: DataFrame) -> DataFrame:
        """The nodes with ``subroot, root, proof``, from ``told``: ``tree, subroot, root, proof`` of every tree's root."""
        arity, levels = self.arity, self.levels
        told = told.withColumn("block", F.lit(0).cast("long"))
        for nodes in reversed(self.rounds[:-1]):
            keep = [c for c in nodes.columns if nodes is self.rounds[0] or c in ("tree", "place")]
            schema = T.StructType([nodes.schema[c] for c in keep] + [T.StructField(c, T.StringType()) for c in ("subroot", "root", "proof")])

            below = self._blocks(nodes).groupBy("tree", "block").cogroup(told.groupBy("tree", "block")).applyInArrow(
                _deliverer(keep, arity, levels), schema)
            if nodes is self.rounds[0]:
                return below
            told = below.withColumnRenamed("place", "block")


def manifest(documents: DataFrame, tree: str, order: str, fields: Sequence[str], keep: Sequence[str] = (),
             arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """``order, tree, *keep, leaf, subroot, root, proof`` of every row.

    Rows with one value of ``tree`` (null is a value, and the first) form a tree, in ascending
    ``order``, nulls first; rows that share it are ordered by their leaf digests, and equal rows are
    leaves of their own.  ``keep`` names columns that travel along; they should be small.  A row's
    text, however long, is read once and not moved.  An empty table has no rows and no root.
    Columns of the result go by the names ``order_key`` and ``tree_key``.
    """
    named = {f"kept_{i}": c for i, c in enumerate(keep)} | {f"field_{i}": c for i, c in enumerate(fields)}
    rows = plain(documents, order_key=order, tree_key=tree, **named)
    # A null tree sorts before all others, "" included; bytes decide as in Spark's own text order.
    key = F.coalesce(F.concat(F.lit("="), F.col("tree_key").cast("string")), F.lit(""))
    leaves = rows.select("order_key", "tree_key", *[f"kept_{i}" for i in range(len(keep))], key.alias("tree"),
                         leaf_digest(*[F.col(f"field_{i}") for i in range(len(fields))]).alias("digest"))
    forest = Forest(_placed(leaves, ["order_key", "digest"]), arity, levels)
    subroots = forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    crown = Forest(_placed(subroots, ["name"]), arity, levels)
    root = crown.roots.select("tree", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.lit("").alias("proof"))
    told = crown.proofs(root).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "proof")
    return forest.proofs(written(told)).select(
        "order_key", "tree_key", *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)],
        F.col("digest").alias("leaf"), "subroot", "root", "proof")
