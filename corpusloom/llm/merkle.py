"""Merkle manifest of a dataset: a digest a row, one root a group, one root of all, and a proof for every row.

Rows are numbered within their group by a range sort and counts per range, so no group is
gathered. Aligned blocks of consecutive nodes are single tasks' work: first each block's
root, level by level of blocks until a group is one block; then, downwards, the proofs. A
block's proofs come from Merkle traversal in logarithmic memory (Szydlo's scheduling):
one treehash stack a height prepares the next authentication node while the leaves are
passed one by one. The part of a proof above the block is the same for all its leaves,
comes with the block once, and is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.scratch import Scratch, partitions

#: A block has two to this power leaves; a task holds one block.
HEIGHT = 10


def leaf_digest(*columns: Column) -> Column:
    """Lower-case hex SHA-256 of the columns one after another: ``-`` for null, else number of UTF-8 bytes, ``:`` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""
    hashed = lambda x: F.sha2(x.cast("binary"), 256)
    rest = lambda s: F.substring(s, 2, 64)
    return F.aggregate(proof, leaf, lambda h, s: hashed(F.when(s.startswith("L"), F.concat(rest(s), h)).when(s.startswith("R"), F.concat(h, rest(s))).otherwise(h)))


def siblings(proof: Column) -> Column:
    """All sibling digests of a proof as one text, from the leaf upwards."""
    return F.array_join(F.transform(F.filter(proof, lambda s: s != "-"), lambda s: F.substring(s, 2, 64)), "")


def _parent(a: str | None, b: str | None) -> str | None:
    return None if a is None else hashlib.sha256((a + (b or "")).encode()).hexdigest()


def _height(n: int, block: int, most: int) -> int:
    """Height of a block's tree of n leaves; only the one block of a group is lower than a whole one."""
    return most if block > 0 else (n - 1).bit_length()


def block_root(leaves: list[str], height: int) -> str:
    nodes = leaves
    for _ in range(height):
        nodes = [_parent(nodes[k], nodes[k + 1] if k + 1 < len(nodes) else None) for k in range(0, len(nodes), 2)]
    return nodes[0]


class _Stack:
    """Treehash: computes one node of a given height, one step at a time, keeping a node a height at most."""

    def __init__(self, leaves: list[str], height: int):
        self.leaves, self.height = leaves, height
        self.nodes: list[tuple[int, str | None]] = []
        self.at = self.left = 0

    def start(self, leaf: int) -> None:
        self.nodes, self.at, self.left = [], leaf, 1 << self.height
        if leaf >= len(self.leaves):  # nothing is there
            self.nodes, self.left = [(self.height, None)], 0

    def low(self) -> float:
        if not self.left and len(self.nodes) < 2:
            return float("inf")
        return self.nodes[-1][0] if self.nodes else self.height

    def step(self) -> None:
        nodes = self.nodes
        if len(nodes) > 1 and nodes[-1][0] == nodes[-2][0]:
            h, b = nodes.pop()
            nodes[-1] = h + 1, _parent(nodes[-1][1], b)
        elif self.left:
            nodes.append((0, self.leaves[self.at] if self.at < len(self.leaves) else None))
            self.at, self.left = self.at + 1, self.left - 1


def traverse(leaves: list[str], height: int) -> Iterator[list[str]]:
    """The proof of each leaf of a block in turn: its sibling at each height with its side, L or R, or ``-`` for none."""
    # one treehash pass leaves the first two nodes of each height
    auth: list[str | None] = [None] * height
    stacks = [_Stack(leaves, h) for h in range(height)]
    tail: list[tuple[int, str | None]] = []
    for at in range(1 << height):
        tail.append((0, leaves[at] if at < len(leaves) else None))
        while True:
            h, node = tail[-1]
            if h < height and at >> h == 0:
                stacks[h].nodes = [(h, node)]
            elif h < height and at >> h == 1:
                auth[h] = node
            if len(tail) < 2 or tail[-2][0] != h:
                break
            tail.pop()
            tail[-1] = h + 1, _parent(tail[-1][1], node)
    for leaf in range(len(leaves)):
        yield ["-" if a is None else ("L" if leaf >> h & 1 else "R") + a for h, a in enumerate(auth)]
        for h in range(height):
            if (leaf + 1) % (1 << h) == 0:
                auth[h] = stacks[h].nodes[0][1]
                stacks[h].start((leaf + 1 + (1 << h)) ^ (1 << h))
        for _ in range(2 * height - 1):
            lows = [s.low() for s in stacks]
            least = min(lows)
            if least == float("inf"):
                break
            stacks[lows.index(least)].step()


def _blocks(batches: Iterator[pa.RecordBatch], opens: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.Table]:
    """Sorted rows block by block; ``opens`` marks a block's first row."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cuts = [*np.flatnonzero(opens(batch)).tolist(), batch.num_rows]
        if held and cuts[0] > 0:
            held.append(batch.slice(0, cuts[0]))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
    if held:
        yield pa.Table.from_batches(held)


def numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """The rows with index, from 0 in their group g, in the given order; groups are never gathered."""
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), "g", *order).sortWithinPartitions("g", *order)
    at = scratch.table(dealt.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    spans = at.groupBy("g", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # as many rows a group as ranges
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select("g", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return at.withColumn("part", part).join(starts, ["g", "part"]).withColumn("index", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _dealt(rows: DataFrame) -> DataFrame:
    """Blocks by hash, each in the order of its nodes."""
    return rows.repartition(partitions(rows.sparkSession), "g", "block").sortWithinPartitions("g", "block", "index")


def _roots(nodes: DataFrame, height: int) -> DataFrame:
    """(g, index, digest): the root of every block; its index is the block's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, lambda b: np.asarray(b.column("index")) % (1 << height) == 0):
            leaves = block.column("digest").to_pylist()
            at = block.column("block")[0].as_py()
            root = block_root(leaves, _height(len(leaves), at, height))
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((block.column("g")[0].as_py(), pa.string()), (at, pa.int64()), (root, pa.string()))], names=["g", "index", "digest"])

    return _dealt(nodes.select("g", F.shiftright("index", height).alias("block"), "index", "digest")).mapInArrow(run, "g string, index long, digest string")


def _tower(nodes: DataFrame, height: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """All levels of blocks' roots over the nodes, and (g, digest) of each group's root. The driver learns the largest index of a level."""
    levels = [nodes]
    while (levels[-1].agg(F.max("index")).first()[0] or 0) >> height:
        levels.append(scratch.table(_roots(levels[-1], height), "level"))
    return levels, scratch.table(_roots(levels[-1], height).select("g", "digest"), "roots")


def _proofs(nodes: DataFrame, above: DataFrame, kept: str, height: int) -> DataFrame:
    """Downwards: (g, index, digest, proof, roots, kept) of nodes from above (g, index, proof, roots), one row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, lambda b: np.asarray(b.column("index")) < 0):
            shared, roots = block.column("proof")[0].as_py(), block.column("roots")[0].as_py()
            own = block.slice(1).combine_chunks()
            leaves = own.column("digest").to_pylist()
            own_height = _height(len(leaves), block.column("block")[0].as_py(), height)
            proofs = [p + shared for p in traverse(leaves, own_height)]
            lists = [pa.array(proofs, pa.list_(pa.string())), pa.array([roots] * len(leaves), pa.list_(pa.string()))]
            made = pa.Table.from_arrays([own.column("g"), own.column("index"), own.column("digest"), *lists, own.column("kept")], names=["g", "index", "digest", "proof", "roots", "kept"])
            yield from made.to_batches()

    none = F.lit(None)
    lists = "array<string>"
    leaves = nodes.select("g", F.shiftright("index", height).alias("block"), "index", "digest", none.cast(lists).alias("proof"), none.cast(lists).alias("roots"), "kept")
    heads = above.select("g", F.col("index").alias("block"), F.lit(-1).cast("long").alias("index"), none.cast("string").alias("digest"), "proof", "roots", none.cast(kept).alias("kept"))
    return _dealt(leaves.union(heads)).mapInArrow(run, f"g string, index long, digest string, proof {lists}, roots {lists}, kept {kept}")


def _descend(levels: list[DataFrame], above: DataFrame, kept: str, height: int, scratch: Scratch) -> DataFrame:
    """Proofs of the lowest level's nodes."""
    for level in reversed(levels[1:]):
        above = scratch.table(_proofs(level.withColumn("kept", F.lit(None).cast("struct<x:int>")), above, "struct<x:int>", height).select("g", "index", "proof", "roots"), "proofs")
    return _proofs(levels[0], above, kept, height)


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", keep: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per input row: id, leaf, subroot, root, proof, and ``keep``'s columns of the row.

    A row's leaf is the digest of its fields. Leaves of equal group ascend by id, null first,
    and by digest where ids repeat, so repeated rows are leaves each and the result doesn't
    depend on the order of the input. While a group has several nodes every two consecutive
    ones, or a last single one, become the digest of their texts; the groups' roots, null
    first and then by bytes, likewise. proof lists a leaf's siblings upwards, each after its
    side (L or R), ``-`` where a node was alone; ``fold`` gives the root back. Null and empty
    texts have different digests. A block has two to the power of ``height`` leaves, which
    changes no result. Columns that are no field are ignored, whatever their
    names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    keep = keep or {}
    held = F.struct(F.col(f"`{id_col}`").cast("long").alias("id"), *[c.alias(f"k{k}") for k, c in enumerate(keep.values())]).alias("kept")
    group = F.col(f"`{group_col}`").cast("string")
    # null comes first, and no other group is named like it
    g = F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), group)).alias("g")
    leaves = docs.select(g, held, leaf_digest(*[F.col(f"`{c}`") for c in fields]).alias("digest")).withColumn("id", F.col("kept.id"))
    kept = leaves.schema["kept"].dataType.simpleString()
    # the range sort samples its input, so texts are read and hashed before
    hashed = scratch.table(leaves, "hashed")
    nodes = scratch.table(numbered(hashed, ["id", "digest"], scratch).select("g", "index", "digest", "kept"), "leaves")
    levels, subroots = _tower(nodes, height, scratch)
    # the groups' roots are the leaves of one more tree
    tops = scratch.table(numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), ["name"], scratch), "tops")
    high, root = _tower(tops.select("g", "index", "digest", F.struct("name").alias("kept")), height, scratch)
    none = F.array().cast("array<string>")
    above = _descend(high, root.select("g", F.lit(0).cast("long").alias("index"), none.alias("proof"), F.array("digest").alias("roots")), "struct<name:string>", height, scratch)
    heads = scratch.table(above.select(F.col("kept.name").alias("g"), F.lit(0).cast("long").alias("index"), "proof", F.array("digest", F.col("roots")[0]).alias("roots")), "heads")
    rows = _descend(levels, heads, kept, height, scratch)
    return rows.select(
        F.col("kept.id").alias(id_col),
        F.col("digest").alias("leaf"),
        F.col("roots")[0].alias("subroot"),
        F.col("roots")[1].alias("root"),
        "proof",
        *[F.col(f"kept.k{k}").alias(name) for k, name in enumerate(keep)],
    )


def verified(rows: DataFrame, claimed: Column) -> DataFrame:
    """The manifest's rows with folded_root, from a claimed leaf and the row's proof, and whether it is the root."""
    return rows.withColumn("folded_root", fold(claimed, F.col("proof"))).withColumn("verified", F.col("folded_root") == F.col("root"))
