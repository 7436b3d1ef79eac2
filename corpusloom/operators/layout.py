"""A map of vectors in two dimensions that keeps neighbourhoods, from their graph of nearest neighbours.

The graph is that of exact search, with weights that fall from each vector's nearest
neighbour on and sum to the same for all. Positions are a table. In a round every block of
vectors moves against where all others were: along its edges towards neighbours, and away
from vectors drawn anew by a hash, so a round is two joins and bounded groups whatever the
number of vectors, and a run can be repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.order import numbered
from corpusloom.operators.vector import top_neighbours
from corpusloom.plans.scratch import Scratch

# The curve 1 / (1 + A * d**(2 * B)) for a least distance of 0.1.
A, B = 1.577, 0.895
#: Vectors of a block.
BLOCK_ROWS = 4096


def neighbour_weights(far: np.ndarray) -> np.ndarray:
    """Weights of each row of ascending distances: 1 for the nearest, falling so that they sum to log2 of their number."""
    rest = np.maximum(far - far[:, :1], 0)
    target = np.log2(max(far.shape[1], 2))
    low, high = np.zeros(len(far)), np.full(len(far), np.inf)
    width = np.ones(len(far))
    for _ in range(64):
        total = np.exp(-rest / width[:, None]).sum(1)
        much = total > target
        high, low = np.where(much, width, high), np.where(much, low, width)
        width = np.where(much, (low + high) / 2, np.where(np.isinf(high), width * 2, (low + high) / 2))
        width = np.clip(width, 1e-9, 1e9)
    return np.exp(-rest / width[:, None])


def fuzzy_graph(vectors: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(a, b, w), each pair in both directions: how much either is a neighbour of the other."""
    near = top_neighbours(vectors, k).groupBy("a").agg(F.sort_array(F.collect_list(F.struct((1 - F.col("sim")).alias("d"), "b"))).alias("n"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("n").to_pylist()
            for size in {len(r) for r in rows}:
                own = [i for i, r in enumerate(rows) if len(r) == size]
                w = neighbour_weights(np.array([[x["d"] for x in rows[i]] for i in own]))
                a = batch.column("a").take(pa.array(np.repeat(own, size)))
                yield pa.RecordBatch.from_arrays([a, pa.array([x["b"] for i in own for x in rows[i]], pa.int64()), pa.array(w.ravel())], names=["a", "b", "w"])

    one = scratch.table(near.mapInArrow(weigh, "a long, b long, w double"), "directed")
    both = one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    # a pair has one row or two
    return scratch.table(both.groupBy("a", "b").agg((F.sum("w") - F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(0.0)).alias("w")), "graph")


def _moved(at: np.ndarray, of: np.ndarray, to: np.ndarray, weight: np.ndarray, away: np.ndarray, from_: np.ndarray, rate: float, steps: int) -> np.ndarray:
    """New positions after some steps with all others where they are. of and away name the rows of ``at`` that edges and draws belong to."""
    at = at.copy()
    degree = np.maximum(np.bincount(of, weight, len(at)), 1e-9)
    drawn = np.maximum(np.bincount(away, minlength=len(at)), 1)
    for _ in range(steps):
        gap = at[of] - to
        square = (gap**2).sum(1)
        pull = -2 * A * B * np.where(square > 0, square, 1) ** (B - 1) / (1 + A * square**B) * (square > 0) * weight
        off = at[away] - from_
        apart = (off**2).sum(1)
        push = 2 * B / ((0.001 + apart) * (1 + A * apart**B))
        total = np.empty_like(at)
        for c in range(2):
            total[:, c] = np.bincount(of, np.clip(pull * gap[:, c], -4, 4), len(at)) / degree + 5 * np.bincount(away, np.clip(push * off[:, c], -4, 4), len(at)) / drawn
        at += rate * np.clip(total, -4, 4)
    return at


def _mover(rate: float, steps: int):
    """A block's round: its own rows (kind 0), its edges with where they lead (1), and what it is pushed from (2)."""

    def move(table: pa.Table) -> pa.Table:
        table = table.sort_by([("kind", "ascending"), ("a", "ascending"), ("tx", "ascending"), ("ty", "ascending")])
        kind, a, w = (np.asarray(table.column(c)) for c in ("kind", "a", "w"))
        to = np.stack([np.asarray(table.column(c)) for c in ("tx", "ty")], axis=1)
        mine, pulled, pushed = (kind == k for k in range(3))
        row = np.searchsorted(a[mine], a)
        new = _moved(to[mine], row[pulled], to[pulled], w[pulled], row[pushed], to[pushed], rate, steps)
        return pa.table({"id": a[mine], "place": table.column("place").filter(pa.array(mine)), "x": new[:, 0], "y": new[:, 1]})

    return move


def layout(start: DataFrame, graph: DataFrame, scratch: Scratch, rounds: int = 14, steps: int = 5, draws: int = 8, seed: int = 42) -> DataFrame:
    """(id, x, y) after rounds of moves from ``start`` (id, x, y); ids are unique."""
    placed = scratch.table(numbered(start.withColumn("all", F.lit(0)), ["all"], ["id"], "place", scratch).select("id", "place", "x", "y"), "start")
    n = placed.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).alias("block")
    for turn in range(rounds):
        rate = 1.0 - turn / rounds
        where = placed.select(F.col("id").alias("b"), F.col("x").alias("tx"), F.col("y").alias("ty"))
        edges = graph.join(where, "b").select("a", F.lit(1).alias("kind"), "w", "tx", "ty", F.lit(0).cast("long").alias("place"))
        picks = placed.select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("k"))
        picks = picks.withColumn("place", F.pmod(F.xxhash64("a", "k", F.lit(turn), F.lit(seed)), F.lit(max(n, 1))))
        other = placed.select("place", F.col("id").alias("b"), F.col("x").alias("tx"), F.col("y").alias("ty"))
        pushes = picks.join(other, "place").where("a <> b").select("a", F.lit(2).alias("kind"), F.lit(1.0).alias("w"), "tx", "ty", F.lit(0).cast("long").alias("place"))
        own = placed.select(F.col("id").alias("a"), F.lit(0).alias("kind"), F.lit(0.0).alias("w"), F.col("x").alias("tx"), F.col("y").alias("ty"), "place")

        moved = own.unionByName(edges).unionByName(pushes).groupBy(block("a")).applyInArrow(_mover(rate, steps), "id long, place long, x double, y double")
        new = scratch.table(moved, "positions")
        scratch.drop(placed)
        placed = new
    return placed.select("id", "x", "y")


def kept_neighbours(points: np.ndarray, flat: np.ndarray, k: int = 10) -> float:
    """Share of each point's k nearest by cosine that are among its k nearest on the map; for tests of small sets."""
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    sims = units @ units.T
    np.fill_diagonal(sims, -np.inf)
    far = ((flat[:, None] - flat[None]) ** 2).sum(2)
    np.fill_diagonal(far, np.inf)
    one, two = np.argsort(-sims, axis=1)[:, :k], np.argsort(far, axis=1)[:, :k]
    return float(np.mean([len(set(a) & set(b)) / k for a, b in zip(one, two, strict=True)]))
