"""Hierarchical density clusters (excess of mass) of groups of any size, exactly.

Edges are ordered by mutual reachability, then by the smaller and the larger id, so the
spanning tree, and with it the result, is unique. A group of few rows is one task's work.
In larger ones pairs of blocks give the nearest others of each point. Boruvka rounds over
those, edges only, are one task's while the group is of middle size: a part of the tree
grows while its lightest way out is lighter than all that its points do not know; only
where none grows any more, the points of all parts but the largest are measured again
with the others outside. Beyond that size spanning trees come from pairs of blocks (the
tree of the whole is within the union of the trees of all pairs), the tree is found by
Boruvka rounds over the edge table, the merges by halving ranges of the sorted edges
and contracting the lighter half, and the clusters as components of the merges.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators.graph import components
from corpusloom.operators.order import numbered
from corpusloom.operators.vector import block_pairs, matrix
from corpusloom.plans.scratch import Scratch


@dataclass(frozen=True)
class Sizes:
    """Bounds of a task: rows of a group that it takes whole, rows of a group whose edges it takes, and merges of a range. They change no result."""

    rows: int = 2048
    edges: int = 1 << 18
    merges: int = 1 << 16


#: Vectors of a block; a task spans a tree over two.
BLOCK_ROWS = 2048
#: Level of merges at distance zero.
AT_ONCE = 1e12
#: Rows of a block that are measured at a time.
STRIP = 256
#: Vectors of a block where only nearest ones leave a task, and how many of them each vector keeps.
WIDE_ROWS = 16_384
NEAR = 16
#: Stabilities within this share of each other are equal, in whatever order they were summed.
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances to nine decimals; near ones by differences, so that equal vectors are at zero."""
    x, y = (a**2).sum(1)[:, None], (b**2).sum(1)[None, :]
    square = np.maximum(x + y - 2 * a @ b.T, 0)
    i, j = np.nonzero(square < 1e-5 * (x + y))
    square[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    return np.round(np.sqrt(square), 9)


def spanning_tree(points: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, a, b), a < b, of the tree over all points by mutual reachability, ties by a and b; memory follows the square of the points."""
    n = len(points)
    inside, near, key = np.zeros(n, bool), np.full(n, np.inf), np.full(n, n * n)
    every = np.arange(n)
    reaches = np.empty((n, n))
    for s in range(0, n, STRIP):
        part = slice(s, s + STRIP)
        reaches[part] = np.maximum(np.maximum(core[part, None], core), distances(points[part], points))
    out, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        near[at] = np.inf
        reach = reaches[at]
        closer = np.flatnonzero((reach <= near) & ~inside)
        own = np.minimum(at, closer) * n + np.maximum(at, closer)
        better = (reach[closer] < near[closer]) | (own < key[closer])
        closer, own = closer[better], own[better]
        near[closer], key[closer] = reach[closer], own
        ties = np.flatnonzero(near == near.min())
        at = int(ties[np.argmin(key[ties])])
        out.append((near[at], key[at] // n, key[at] % n))
    w, a, b = zip(*out, strict=True) if out else ((), (), ())
    return np.array(w, float), np.array(a, int), np.array(b, int)


def core_distances(points: np.ndarray, samples: int) -> np.ndarray:
    """Distance to the ``samples``-th nearest point, the point itself counted."""
    k = min(samples, len(points)) - 1
    return np.concatenate([np.partition(distances(points[s : s + 256], points), k, axis=1)[:, k] for s in range(0, len(points), 256)])


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def chosen_clusters(up: list[int], stability: list[float]) -> list[int]:
    """The most stable antichain of a cluster tree: for each cluster the chosen one at or above it, or -1.

    A cluster comes after its parent; the first is the root, which is never chosen.
    """
    below, kids = [0.0] * len(up), [0] * len(up)
    own = [False] * len(up)
    for c in reversed(range(len(up))):
        own[c] = c > 0 and (not kids[c] or stability[c] >= below[c] * (1 - SLACK))
        if c > 0:
            below[up[c]] += stability[c] if own[c] else below[c]
            kids[up[c]] += 1
    above = [-1] * len(up)
    for c in range(1, len(up)):
        above[c] = above[up[c]] if above[up[c]] >= 0 else c if own[c] else -1
    return above


def level_of(height: float) -> float:
    return 1 / height if height > 0 else AT_ONCE


def tree_labels(n: int, w: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Cluster of each point from the sorted edges of its spanning tree, numbered by first members; -1 is noise."""
    parent, top = list(range(n)), list(range(n))
    size, left, right = [1] * n, [0] * n, [0] * n
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = _root(parent, x), _root(parent, y)
        left.append(top[x])
        right.append(top[y])
        size.append(size[top[x]] + size[top[y]])
        parent[x], top[y] = y, n + k
    cluster, born, stability, up = [0] * len(size), [0.0], [0.0], [-1]
    for node in reversed(range(n, len(size))):
        c, level = cluster[node], level_of(w[node - n])
        x, y = left[node], right[node]
        big = [k for k in (x, y) if size[k] >= least]
        if len(big) == 2:
            stability[c] += size[node] * (level - born[c])
            for k in big:
                cluster[k] = len(up)
                up.append(c)
                born.append(level)
                stability.append(0.0)
        else:
            if size[node] >= least:  # smaller ones have left already
                stability[c] += (size[node] - sum(size[k] for k in big)) * (level - born[c])
            cluster[x] = cluster[y] = c
    above = chosen_clusters(up, stability)
    found = [above[c] for c in cluster[:n]]
    number = {c: k for k, c in enumerate(dict.fromkeys(c for c in found if c >= 0))}
    return np.array([number.get(c, -1) for c in found], int)


def hdbscan(points: np.ndarray, least: int = 5, samples: int = 3) -> np.ndarray:
    """Labels of one group of points in order of their ids; a single root cluster is none, -1 is noise."""
    n = len(points)
    if n < max(least, 2):
        return np.full(n, -1)
    w, a, b = spanning_tree(points, core_distances(points, samples))
    order = np.lexsort((b, a, w))
    return tree_labels(n, w[order], a[order], b[order], least)


def _apart(points: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows to nine decimals, the same whatever they are measured with."""
    parts = range(0, len(x), 1 << 16)
    return np.concatenate([np.zeros(0), *(np.round(np.sqrt(((points[x[s : s + (1 << 16)]] - others[y[s : s + (1 << 16)]]) ** 2).sum(1)), 9) for s in parts)])


def _squares(points: np.ndarray, others: np.ndarray):
    """Strips (start, squared distances, what they may be off by) of the points against all others."""
    x, y = (points**2).sum(1), (others**2).sum(1)
    left = np.column_stack([points, np.ones(len(points)), x])
    right = np.ascontiguousarray(np.column_stack([-2 * others, y, np.ones(len(others))]).T)
    for s in range(0, len(points) if len(others) else 0, STRIP):
        yield s, left[s : s + STRIP] @ right, 1e-12 * (x[s : s + STRIP] + y.max())


def _up_to(square: np.ndarray, most: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose distance may be at most the root of ``most`` to nine decimals."""
    limit = (np.sqrt(np.maximum(np.minimum(most, np.finfo(float).max / 4) + off, 0)) + 2e-9) ** 2 + off
    return np.divmod(np.flatnonzero(square <= limit[:, None]), square.shape[1])


def _first_copies(keys: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of equal rows, in order."""
    rows = np.ascontiguousarray(keys)
    _, of = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(of, kind="stable")
    return np.sort(order[np.arange(len(of)) - np.searchsorted(of[order], of[order]) < most])


def nearest_others(ids: np.ndarray, points: np.ndarray, other_ids: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, id, distance): the k nearest others of each point but itself, by distance and id; ``other_ids`` ascend."""
    found = [(np.zeros(0, int), other_ids[:0], np.zeros(0))]
    # of more copies than that none is among the nearest
    kept = _first_copies(others, k + 1)
    other_ids, others = other_ids[kept], others[kept]
    for s, square, off in _squares(points, others):
        own = ids[s : s + STRIP]
        place = np.minimum(np.searchsorted(other_ids, own), len(other_ids) - 1)
        same = np.flatnonzero(other_ids[place] == own)
        square[same, place[same]] = np.inf
        # the k-th of the least of runs is no less than the k-th of all
        lows = np.minimum.reduceat(square, np.arange(0, len(others), 64), axis=1)
        lows = lows if k <= lows.shape[1] else square
        most = np.partition(lows, k - 1, axis=1)[:, k - 1] if k <= lows.shape[1] else np.full(len(own), np.inf)
        x, y = _up_to(square, most, off)
        d = _apart(points, s + x, others, y)
        order = np.lexsort((y, d, x))
        order = order[np.arange(len(x)) - np.searchsorted(x, x) < k]
        found.append((s + x[order], other_ids[y[order]], d[order]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def ways_out(
    ids: np.ndarray, points: np.ndarray, core: np.ndarray, part: np.ndarray, other_ids: np.ndarray, others: np.ndarray, other_core: np.ndarray, other_part: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, weight, a, b), a < b: the lightest edge of each point to one of the others in another part, the first by a and b; ``other_ids`` ascend."""
    # the first of copies in a part has the first edge
    kept = _first_copies(np.column_stack([others, other_core, other_part.astype(float)]), 1)
    kept = kept[np.argsort(other_part[kept], kind="stable")]
    other_ids, others, other_core, other_part = other_ids[kept], others[kept], other_core[kept], other_part[kept]
    first, last = np.searchsorted(other_part, part, "left"), np.searchsorted(other_part, part, "right")
    found = [(np.zeros(0, int), np.zeros(0), ids[:0], ids[:0])]
    for s, square, off in _squares(points, others):
        np.maximum(square, other_core**2, out=square)
        for row in range(len(square)):
            square[row, first[s + row] : last[s + row]] = np.inf
        x, y = _up_to(square, np.maximum(square.min(1), core[s : s + STRIP] ** 2), off)
        x = s + x
        w = np.maximum(np.maximum(core[x], other_core[y]), _apart(points, x, others, y))
        a, b = np.minimum(ids[x], other_ids[y]), np.maximum(ids[x], other_ids[y])
        order = np.lexsort((b, a, w, x))
        order = order[np.unique(x[order], return_index=True)[1]]
        found.append((x[order], w[order], a[order], b[order]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def grown(part: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray, bound: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, edges, asked) after Boruvka rounds over known edges while a part's lightest way out is certain.

    Edges out of a point's part that are not known weigh its ``bound`` at least; where the
    known edge to point ``to`` (-1: none) leads out, it is the point's lightest. edges are
    places of what joins the tree, asked the points whose lightest way out must be sought,
    none of the largest part.
    """
    order = np.lexsort((b, a, w))
    taken = []
    while True:
        names, part = np.unique(part, return_inverse=True)
        m = len(names)
        order = order[part[a[order]] != part[b[order]]]
        x, y, down = part[a[order]], part[b[order]], np.arange(len(order))[::-1]
        best = np.full((2, m), len(order))
        # of equal places the last is written
        best[0, x[::-1]], best[1, y[::-1]] = down, down
        best = best.min(0)
        weight = np.append(w[order], np.inf)[best]
        unsure = np.where((to >= 0) & (part[to] != part), np.inf, bound)
        least = np.full(m, np.inf)
        np.minimum.at(least, part, unsure)
        sure = np.flatnonzero(weight < least)
        if m == 1 or not len(sure):
            asked = np.isfinite(unsure) & (unsure <= weight[part]) & (part != np.argmax(np.bincount(part)))
            return part, np.concatenate([*taken, order[:0]]), np.flatnonzero(asked)
        taken.append(order[np.unique(best[sure])])
        every, up = np.arange(m), np.arange(m)
        up[sure] = x[best[sure]] + y[best[sure]] - sure
        # two parts may choose the same edge
        up = np.where((up[up] == every) & (every < up), every, up)
        while (up[up] != up).any():
            up = up[up]
        part = up[part]


def _matrix(table: pa.Table, name: str = "vec") -> np.ndarray:
    return matrix(table.column(name))


def _nearest(rows: DataFrame) -> DataFrame:
    """The rows with near, the nearest others (d, b) in their group, core, and bound, which no distance to another that is not in near is below."""

    def nearest(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        side, k = np.asarray(table.column("side")), max(NEAR, table.column("samples")[0].as_py())
        points, ids = _matrix(table), np.asarray(table.column("id"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        place, b, d = nearest_others(ids[left], points[left], ids[right], points[right], k)
        starts = pa.array(np.searchsorted(place, np.arange(len(left) + 1)), pa.int32())
        return pa.table({"id": ids[left], "near": pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays([pa.array(d), pa.array(b)], names=["d", "b"]))})

    found = block_pairs(rows, "g", False, ("samples",), WIDE_ROWS).groupBy("g", "i", "j").applyInArrow(nearest, "id long, near array<struct<d: double, b: long>>")
    merged = rows.join(found.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("near")), "id")
    kept = merged.withColumn("near", F.slice("near", F.lit(1), F.greatest(F.lit(NEAR), F.col("samples").cast("int"))))
    core = F.when(F.col("samples") > 1, F.try_element_at("near", (F.least("samples", "n") - 1).cast("int"))["d"]).otherwise(0.0)
    bound = F.when(F.size("near") >= F.col("n") - 1, float("inf")).otherwise(F.try_element_at("near", F.lit(-1))["d"])
    return kept.withColumns({"core": core, "bound": bound})


def _trees(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, w, a, b): the spanning tree of each group, from the nearest others, and from all others only for points whose part finds no way out among those."""

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, core, bound, part, other = (np.asarray(table.column(c)) for c in ("id", "core", "bound", "part", "other"))
        n, g = len(ids), table.column("g")[0].as_py()
        lists = table.column("near").combine_chunks()
        x = np.repeat(np.arange(n), np.asarray(pc.list_value_length(lists), np.int64))
        y = np.searchsorted(ids, np.asarray(lists.flatten().field("b")))
        w = np.maximum(np.maximum(core[x], core[y]), np.asarray(lists.flatten().field("d")))
        known = np.flatnonzero(other >= 0)
        to = np.full(n, -1)
        to[known] = np.searchsorted(ids, other[known])
        x, y, w = np.append(x, known), np.append(y, to[known]), np.append(w, bound[known])
        a, b = np.minimum(x, y), np.maximum(x, y)
        part, edges, asked = grown(part, w, a, b, bound, to)
        m = n if part.max() else 0
        if m and not len(asked):
            raise ValueError("vectors of a group have components that are not finite")
        ask, blank = np.zeros(n, bool), [None] * m
        ask[asked] = True
        node = {"id": [*ids[:m].tolist(), *[None] * len(edges)], "part": [*part[:m].tolist(), *[None] * len(edges)], "asked": [*ask[:m].tolist(), *[None] * len(edges)]}
        edge = {"w": blank + w[edges].tolist(), "a": blank + ids[a[edges]].tolist(), "b": blank + ids[b[edges]].tolist()}
        kinds = {"id": pa.int64(), "part": pa.int64(), "asked": pa.bool_(), "w": pa.float64(), "a": pa.int64(), "b": pa.int64()}
        return pa.table({"g": pa.array([g] * (m + len(edges)), pa.string()), **{c: pa.array(v, kinds[c]) for c, v in (node | edge).items()}})

    def seek(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        side, points = np.asarray(table.column("side")), _matrix(table)
        ids, core, part = (np.asarray(table.column(c)) for c in ("id", "core", "part"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        place, w, a, b = ways_out(ids[left], points[left], core[left], part[left], ids[right], points[right], core[right], part[right])
        return pa.table({"id": ids[left][place], "w": w, "a": a, "b": b})

    told = rows.select("g", "id", "core", "near", "bound", F.col("id").alias("part"), F.lit(-1).cast("long").alias("other"))
    tree: DataFrame | None = None
    while True:
        found = scratch.table(told.groupBy("g").applyInArrow(grow, "g string, id long, part long, asked boolean, w double, a long, b long"), "forest")
        new = found.where("a IS NOT NULL").select("g", "w", "a", "b")
        tree = new if tree is None else tree.unionByName(new)
        parts = found.where("id IS NOT NULL").select("id", "part", "asked")
        if parts.isEmpty():
            return tree
        dealt = block_pairs(rows.join(parts, "id"), "g", False, ("core", "part", "asked"), WIDE_ROWS).where("side = 1 OR asked")
        out = dealt.groupBy("g", "i", "j").applyInArrow(seek, "id long, w double, a long, b long").groupBy("id").agg(F.min(F.struct("w", "a", "b")).alias("e"))
        sought = told.drop("part").join(parts, "id").join(out, "id", "left")
        bound, other = F.coalesce("e.w", "bound"), F.coalesce(F.col("e.a") + F.col("e.b") - F.col("id"), "other")
        told = scratch.table(sought.select("g", "id", "core", "near", bound.alias("bound"), "part", other.alias("other")), "sought")


def _pair_trees(rows: DataFrame) -> DataFrame:
    """(g, w, a, b): edges of the spanning trees of all pairs of blocks of a group, each once."""

    def tree(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = np.asarray(table.column("id"))
        w, a, b = spanning_tree(_matrix(table), np.asarray(table.column("core")))
        return pa.table({"g": pa.array([table.column("g")[0].as_py()] * len(w), pa.string()), "w": w, "a": ids[a], "b": ids[b]})

    return block_pairs(rows, "g", True, ("core",), BLOCK_ROWS).groupBy("g", "i", "j").applyInArrow(tree, "g string, w double, a long, b long").distinct()


def _boruvka(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The spanning trees of large edge tables (g, w, a, b): each round takes the lightest edge out of every component."""
    left = scratch.table(edges.withColumns({"x": F.col("a"), "y": F.col("b")}), "edges")
    tree: DataFrame | None = None
    while not left.isEmpty():
        ends = left.select(F.explode(F.array("x", "y")).alias("c"), F.struct("w", "a", "b", "g", "x", "y").alias("e"))
        best = scratch.table(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "lightest")
        tree = best.select("g", "w", "a", "b") if tree is None else tree.union(best.select("g", "w", "a", "b"))
        found = scratch.table(components(best.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch), "components")
        x, y = (found.select(F.col("node").alias(c), F.col("component").alias(f"{c}2")) for c in ("x", "y"))
        moved = left.join(x, "x").join(y, "y").where("x2 <> y2").select("g", "w", "a", "b", F.col("x2").alias("x"), F.col("y2").alias("y"))
        new = scratch.table(moved, "edges")
        scratch.drop(left)
        left = new
    return tree if tree is not None else left.select("g", "w", "a", "b")


def _merges(tree: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """(g, node, w, left, left_size, right, right_size): the merges of single linkage, from sorted edges.

    A node's number is its group's and its edge's place; a point's is -1 - id. Ranges of
    places are halved until ``most`` edges are left; the components of the lighter half are
    the points of the heavier one, so each range can then be merged on its own.
    """
    groups = scratch.table(numbered(tree.select("g").distinct().withColumn("all", F.lit(0)), ["all"], ["g"], "no", scratch).drop("all"), "groups")
    placed = numbered(tree, ["g"], ["w", "a", "b"], "place", scratch).join(groups, "g")
    one = F.lit(1).cast("long")
    point = lambda c: (F.lit(-1) - F.col(c)).alias(f"{c}_ref")
    edges = scratch.table(placed.select("g", "no", "place", "w", point("a"), one.alias("a_size"), point("b"), one.alias("b_size")), "placed")
    node = F.shiftleft("no", 36) + F.col("place")
    largest = edges.agg(F.max("place")).first()[0] or 0
    span = most
    while span <= largest:
        span *= 2
    while span > most:
        half = span // 2
        sub = (F.shiftleft("no", 36) + F.floor(F.col("place") / span)).alias("sub")
        cut = edges.withColumn("sub", sub).withColumn("light", F.col("place") % span < half)
        light = scratch.table(cut.where("light"), "light")
        key = lambda c: F.struct(F.col("sub"), F.col(c).alias("ref"))
        found = scratch.table(components(light.select(key("a_ref").alias("a"), key("b_ref").alias("b")), scratch), "halves")
        ends = light.select(F.explode(F.array(*[F.struct(key(f"{c}_ref").alias("node"), F.col(f"{c}_size").alias("size")) for c in "ab"])).alias("e")).select("e.*").distinct()
        sizes = ends.join(found, "node").groupBy("component").agg(F.sum("size").alias("size"))
        tops = light.select(key("a_ref").alias("node"), node.alias("at")).join(found, "node").groupBy("component").agg(F.max("at").alias("top"))
        held = scratch.table(found.join(sizes.join(tops, "component"), "component").select("node", "top", "size"), "contracted")
        heavy = cut.where("NOT light")
        for c in "ab":
            heavy = heavy.withColumn("node", key(f"{c}_ref")).join(held, "node", "left")
            heavy = heavy.withColumns({f"{c}_ref": F.coalesce("top", f"{c}_ref"), f"{c}_size": F.coalesce("size", f"{c}_size")}).drop("node", "top", "size")
        edges = scratch.table(light.unionByName(heavy).drop("sub", "light"), "edges")
        span = half

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        up: dict[int, int] = {}
        held: dict[int, tuple[int, int]] = {}

        def root(i: int) -> int:
            while up.setdefault(i, i) != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        out = []
        for at, a, m, b, n in zip(*(table.column(c).to_pylist() for c in ("node", "a_ref", "a_size", "b_ref", "b_size")), strict=True):
            held.setdefault(a, (a, m))
            held.setdefault(b, (b, n))
            x, y = root(a), root(b)
            out.append((*held[x], *held[y]))
            up[x] = y
            held[y] = at, held[x][1] + held[y][1]
        columns = list(zip(*out, strict=True))
        return pa.table({"g": table.column("g"), "node": table.column("node"), "w": table.column("w"), **{c: pa.array(v, pa.int64()) for c, v in zip(("left", "left_size", "right", "right_size"), columns, strict=True)}})

    ranges = edges.withColumn("node", node).groupBy("no", F.floor(F.col("place") / most).alias("range"))
    return ranges.applyInArrow(merge, "g string, node long, w double, left long, left_size long, right long, right_size long")


def _cut_labels(merges: DataFrame, ids: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """(g, id, cluster) of groups from their merges: a cluster is a component of merges that split off fewer than ``least`` points."""
    merges = scratch.table(merges, "merges")
    big = lambda side: F.col(f"{side}_size") >= least
    size = F.col("left_size") + F.col("right_size")
    split = big("left") & big("right")
    level = F.when(F.col("w") > 0, 1 / F.col("w")).otherwise(AT_ONCE)
    kept = F.when(split, 0).when(big("left"), F.col("left_size")).when(big("right"), F.col("right_size")).otherwise(0)
    nodes = merges.withColumns({"split": split, "level": level, "gone": F.when(size >= least, size - kept).otherwise(0)})
    ends = nodes.select("g", "node", "split", "level", F.explode(F.array("left", "right")).alias("child"))
    found = scratch.table(components(ends.where("NOT split").select(F.col("node").alias("a"), F.col("child").alias("b")), scratch), "clusters")
    # a merge whose both sides are clusters ends its own; alone it is in no component
    of_node = scratch.table(nodes.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")), "nodes")
    sums = of_node.groupBy("g", "c").agg(F.max("node").alias("head"), F.sum(F.col("gone") * F.col("level")).alias("mass"), F.sum("gone").alias("gone"))
    births = of_node.where("split").select(F.col("c").alias("up"), "level", F.explode(F.array("left", "right")).alias("head"))
    tree = sums.join(births, "head", "left").select("g", "c", "head", "up", (F.col("mass") - F.coalesce("level", F.lit(0.0)) * F.col("gone")).alias("stability"))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        # a cluster's first merge is heavier than those below it
        frame = frame.sort_values("head", ascending=False)
        place = {c: k for k, c in enumerate(frame["c"])}
        above = chosen_clusters([-1 if pd.isna(u) else place[int(u)] for u in frame["up"]], frame["stability"].tolist())
        names = frame["c"].tolist()
        return pd.DataFrame({"c": names, "chosen": pd.array([names[a] if a >= 0 else None for a in above], "Int64")})

    # at most 2 n / least rows of four numbers a group of n
    chosen = scratch.table(tree.groupBy("g").applyInPandas(choose, "c long, chosen long"), "chosen")
    points = ids.select("g", "id", (F.lit(-1) - F.col("id")).alias("node")).join(found, "node").join(chosen, F.col("component") == F.col("c"), "left").select("g", "id", "chosen")
    first = scratch.table(points.where("chosen IS NOT NULL").groupBy("g", "chosen").agg(F.min("id").alias("first")), "first")
    number = numbered(first, ["g"], ["first"], "cluster", scratch).select("chosen", "cluster")
    return points.join(number, "chosen", "left").select("g", "id", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def density_labels(rows: DataFrame, scratch: Scratch, sizes: Sizes | None = None) -> DataFrame:
    """(g, id, cluster) of each row of its group g: clusters numbered by smallest ids, -1 for noise.

    rows: g (string), id (long, unique in the table and not negative), vec, least and
    samples (equal within a group). A group with fewer rows than ``least`` is all noise.
    """
    sizes = sizes or Sizes()
    counted = rows.join(rows.groupBy("g").agg(F.count("*").alias("n")), "g").select("g", "id", V.doubles(F.col("vec")).alias("vec"), "least", "samples", "n")
    kept = scratch.table(counted, "vectors")
    label = "g string, id long, cluster int"

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        found = hdbscan(_matrix(table), table.column("least")[0].as_py(), table.column("samples")[0].as_py())
        return pa.table({"g": table.column("g"), "id": table.column("id"), "cluster": pa.array(found, pa.int32())})

    small = kept.where(F.col("n") <= sizes.rows).groupBy("g").applyInArrow(whole, label)
    large = kept.where(F.col("n") > sizes.rows)
    if large.isEmpty():
        return small
    cores = scratch.table(_nearest(large), "cores")
    trees = _trees(cores.where(F.col("n") <= sizes.edges), scratch).join(large.groupBy("g").agg(F.first("least").alias("least")), "g")

    def rest(table: pa.Table) -> pa.Table:
        w, a, b = (np.asarray(table.column(c)) for c in ("w", "a", "b"))
        ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        order = np.lexsort((b, a, w))
        a, b = place[: len(w)][order], place[len(w) :][order]
        found = tree_labels(len(ids), w[order], a, b, table.column("least")[0].as_py())
        return pa.table({"g": pa.array([table.column("g")[0].as_py()] * len(ids), pa.string()), "id": ids, "cluster": pa.array(found, pa.int32())})

    done = small.unionByName(trees.groupBy("g").applyInArrow(rest, label))
    huge = cores.where(F.col("n") > sizes.edges)
    for least in [r.least for r in huge.select("least").distinct().collect()]:  # as many as callers ask for
        own = huge.where(F.col("least") == least)
        tree = scratch.table(_boruvka(_pair_trees(own), scratch), "tree")
        done = done.unionByName(_cut_labels(_merges(tree, sizes.merges, scratch), own, least, scratch))
    return done
