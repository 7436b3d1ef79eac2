"""Connected components of an edge table by randomised contraction.

Each round maps every node to the neighbour (or itself) of least random priority and
replaces edges by edges between those, so the edge table shrinks by a constant factor a
round whatever the ids look like; long chains of consecutive ids take no longer than
other graphs. All state is in tables in the shared folder; the driver only learns whether
edges are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.order import numbered
from corpusloom.plans.scratch import Scratch


def _priority(node, turn: int):
    return F.struct(F.xxhash64(node, F.lit(turn)).alias("h"), node.alias("node"))


#: Edges of a graph that one task may take whole.
WHOLE_EDGES = 1 << 18


def components(edges: DataFrame, scratch: Scratch, whole: int = 0) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    ``edges`` has the columns a and b, of one type that has an order. Self loops, repeated edges, either direction
    and rows with a null end are allowed; they add nothing. No edges give no rows. Where no
    more than ``whole`` edges are left one task takes them all, with the same result; the
    nodes are whole numbers then.
    """
    left = scratch.table(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    if whole and left.limit(whole + 1).count() <= whole:
        return left.coalesce(1).mapInPandas(_united, "node long, component long")
    levels: list[DataFrame] = []
    turn = 0
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        level = scratch.table(
            both.groupBy("a")
            .agg(F.min(_priority(F.col("b"), turn)).alias("best"))
            .select(F.col("a").alias("node"), F.least(F.col("best"), _priority(F.col("a"), turn)).getField("node").alias("parent")),
            "level",
        )
        levels.append(level)
        to_a = level.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        to_b = level.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        new = scratch.table(
            left.join(to_a, "a")
            .join(to_b, "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            "edges",
        )
        scratch.drop(left)
        left = new
        turn += 1
    if not levels:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    scratch.drop(left)
    roots = levels[0].withColumnRenamed("parent", "root")
    for level in levels[1:]:
        step = level.select(F.col("node").alias("root"), F.col("parent").alias("next"))
        roots = roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    if len(levels) > 1:
        roots = scratch.table(roots, "roots")
        scratch.drop(*levels)
    least = scratch.table(roots.groupBy("root").agg(F.min("node").alias("component")), "least")
    return roots.join(least, "root").select("node", "component")


def _united(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, component) of all edges that come."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "component": pd.Series([root(i) for i in nodes], dtype="int64")})


def groups(pairs: DataFrame, scratch: Scratch, ranked: bool = True) -> tuple[DataFrame, DataFrame]:
    """Similarity groups of more than one member from pairs (a, b, sim): (groups, members).

    groups: group_id (smallest member), n_members, max_sim. members: group_id, member, degree
    and rank (by falling number of connections, then by id), a row each, so that no group is
    gathered in one place; without ``ranked`` members have no rank. Pairs in both directions
    or repeated count once.
    """
    pairs = scratch.table(
        pairs.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sim").alias("sim")), "pairs"
    )
    found = scratch.table(components(pairs.select("a", "b"), scratch, WHOLE_EDGES), "found")
    members = found.join(degrees(pairs), "node").select(F.col("component").alias("group_id"), F.col("node").alias("member"), "degree")
    best = pairs.join(found, pairs["a"] == found["node"]).groupBy("component").agg(F.max("sim").alias("max_sim"))
    sizes = found.groupBy("component").agg(F.count("*").alias("n_members")).join(best, "component")
    found_groups = sizes.select(F.col("component").alias("group_id"), "n_members", "max_sim")
    if not ranked:
        return found_groups, members
    placed = numbered(members.withColumn("down", -F.col("degree")), ["group_id"], ["down", "member"], "rank", scratch)
    return found_groups, placed.withColumn("rank", F.col("rank") + 1).drop("down")


def greedy_groups(pairs: DataFrame, scratch: Scratch, most: int | None = 1000) -> DataFrame:
    """(group_id, member): groups taken in the order of ids, each a node and all its neighbours.

    pairs (a, b) in any direction; a pair of a node with itself makes it a group where it has
    no other neighbour. A node makes a group unless one of its neighbours, or the node
    itself, is in a group that a smaller node made; so a node waits for smaller ones at most
    two steps away, and a round decides all that wait for none. Middle nodes hold the least
    waiting neighbour, so no pair at two steps is made. The first ``most`` groups are given, or all.
    """
    both = pairs.where("a IS NOT NULL AND b IS NOT NULL").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")
    every = scratch.table(both.union(both.select("a", F.col("a").alias("b"))).distinct(), "neighbours")
    waiting, heads = every, None
    while not waiting.isEmpty():
        least = waiting.groupBy("b").agg(F.min("a").alias("least"))
        new = scratch.table(waiting.join(least, "b").groupBy("a").agg(F.min("least").alias("least")).where("least = a").select("a"), "heads")
        heads = new if heads is None else heads.union(new)
        taken = waiting.join(new, "a", "left_semi").select("b").distinct()
        out = waiting.join(taken, "b", "left_semi").select("a").distinct()
        left = scratch.table(waiting.join(out, "a", "left_anti"), "waiting")
        if waiting is not every:
            scratch.drop(waiting)
        waiting = left
    if heads is None:
        return every.select(F.col("a").alias("group_id"), F.col("b").alias("member"))
    first = heads if most is None else heads.orderBy("a").limit(most)
    return every.join(first, "a").select(F.col("a").alias("group_id"), F.col("b").alias("member"))


def degrees(pairs: DataFrame) -> DataFrame:
    """(node, degree): how many pairs a node is in."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
