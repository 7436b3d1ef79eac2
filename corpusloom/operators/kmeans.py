"""k-means over unit vectors, by rounds over all rows and by batches in a fixed order; both can be repeated exactly.

Centres are few: k rows go to the driver each round, however many rows there are. Sums of
components are whole numbers of 2**-SCALE, so they don't depend on the order of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators.order import numbered
from corpusloom.plans.scratch import Scratch

#: Components are summed in steps of two to the power of minus this; a task can add eight million unit vectors.
SCALE = 40
#: Rows a centre, the first by a hash of their ids, that the starting centres are chosen from.
CANDIDATES = 20


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each point, the first of equally near ones, and its squared distance, to twelve decimals."""
    square = (points**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * points @ centres.T
    square = np.round(np.maximum(square, 0), 12)
    at = square.argmin(1)
    return at, square[np.arange(len(points)), at]


def spread(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k starting centres: each drawn with the square of its distance to those before as weight."""
    rng = np.random.default_rng(seed)
    out = [points[0]]
    left = nearest(points, points[:1])[1]
    for _ in range(k - 1):
        total = np.cumsum(left)
        at = int(np.searchsorted(total, rng.random() * total[-1], "right")) if total[-1] > 0 else 0
        out.append(points[min(at, len(points) - 1)])
        left = np.minimum(left, nearest(points, out[-1][None])[1])
    return np.array(out)


def whole(points: np.ndarray) -> np.ndarray:
    return np.rint(points * (1 << SCALE)).astype(np.int64)


def moved(centres: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means of the clusters; an empty one keeps its centre."""
    return np.where(counts[:, None] > 0, sums / (1 << SCALE) / np.maximum(counts, 1)[:, None], centres)


def _sums(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum and number of the vectors nearest to each of several sets of centres (set, k, dimension), and each set's objective."""
    sets, k, d = centres.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, cost = np.zeros((sets * k, d), np.int64), np.zeros(sets * k, np.int64), np.zeros(sets * k)
        for batch in batches:
            if batch.num_rows:
                points = _matrix(batch.column("vec"))
                for s in range(sets):
                    at, far = nearest(points, centres[s])
                    np.add.at(sums, at + s * k, whole(points))
                    counts += np.bincount(at + s * k, minlength=sets * k)
                    cost += np.bincount(at + s * k, far, sets * k)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used]), pa.array(cost[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["c", "n", "cost", "sums"])

    parts = rows.select("vec").mapInArrow(add, "c long, n long, cost double, sums array<long>")
    found = parts.select("c", "n", "cost", F.posexplode("sums").alias("at", "x")).groupBy("c", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"), F.sum("cost").alias("cost"))
    sums, counts, cost = np.zeros((sets * k, d)), np.zeros(sets * k, np.int64), np.zeros(sets * k)
    for r in found.collect():  # a row a component of a centre
        sums[r.c, r["at"]], counts[r.c], cost[r.c] = float(r.x), r.n, r.cost
    return sums.reshape(sets, k, d), counts.reshape(sets, k), cost.reshape(sets, k).sum(1)


def _units(rows: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """(id, vec, place): unit vectors, and a place by a hash of the id."""
    return scratch.table(rows.select("id", V.normalize(F.col("vec")).alias("vec"), F.xxhash64("id", F.lit(seed)).alias("h")), "units")


def _candidates(units: DataFrame, n: int) -> np.ndarray:
    return np.array([r.vec for r in units.orderBy("h", "id").limit(n).select("vec").collect()], dtype=np.float64)


def _assigned(units: DataFrame, centres: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(nearest(_matrix(batch.column("vec")), centres)[0], pa.int32())], names=["id", "cluster"])

    return units.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, "id long, cluster int")


def kmeans(rows: DataFrame, k: int, scratch: Scratch, steps: int = 50, starts: int = 3, seed: int = 42) -> DataFrame:
    """(id, cluster) of k-means over unit vectors of rows (id, vec); k is lowered to half the rows where there are few.

    Several starts run side by side over each reading of the rows; the one whose rounds end
    with the least sum of squared distances is kept. A start ends when its centres stay.
    """
    n = rows.count()
    k = max(2, min(k, n // 2))
    if n < 2:
        return rows.select("id", F.lit(0).alias("cluster"))
    units = _units(rows, seed, scratch)
    some = _candidates(units, CANDIDATES * k)
    centres = np.stack([spread(some, k, seed + s) for s in range(starts)])
    for _ in range(steps):
        sums, counts, cost = _sums(units, centres)
        new = np.stack([moved(c, s, m) for c, s, m in zip(centres, sums, counts, strict=True)])
        if (new == centres).all():
            break
        centres = new
    _, _, cost = _sums(units, centres)
    return _assigned(units, centres[int(np.round(cost, 9).argmin())])


def content_k(n: int) -> int:
    """Number of clusters of a collection."""
    return min(40, max(n // 10, 5))


def batch_rounds(points: np.ndarray, centres: np.ndarray, batch: int, rounds: int) -> np.ndarray:
    """Centres after rounds of batches in order: each is drawn to its points of the batch by their share of all that it has had."""
    centres, had = centres.copy(), np.zeros(len(centres), np.int64)
    for _ in range(rounds):
        for a in range(0, len(points), batch):
            part = points[a : a + batch]
            at = nearest(part, centres)[0]
            sums, counts = np.zeros(centres.shape, np.int64), np.bincount(at, minlength=len(centres))
            np.add.at(sums, at, whole(part))
            had += counts
            step = np.where(had > 0, counts / np.maximum(had, 1), 0)[:, None]
            centres += step * (moved(centres, sums, counts) - centres)
    return centres


def mini_batch(rows: DataFrame, k: int, scratch: Scratch, batch: int = 1000, batches: int = 100, rounds: int = 10, starts: int = 3, seed: int = 42) -> DataFrame:
    """(id, cluster) by centres that are learned from batches in the order of a hash of the ids.

    The first ``batches`` batches of ``batch`` rows are what is learned from, in one task; all
    rows then go to their nearest centre.
    """
    units = _units(rows, seed, scratch)
    sample = units.orderBy("h", "id").limit(batch * batches)

    def fit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_matrix(p.column("vec")) for p in parts if p.num_rows]
        if held:
            points = np.concatenate(held)
            made = [batch_rounds(points, spread(points[: CANDIDATES * k], k, seed + s), batch, rounds) for s in range(starts)]
            cost = [round(float(nearest(points, c)[1].sum()), 9) for c in made]
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(made[cost.index(min(cost))]), pa.list_(pa.float64()))], names=["c", "centre"])

    one = sample.coalesce(1).sortWithinPartitions("h", "id").select("vec")
    centres = np.array([r.centre for r in one.mapInArrow(fit, "c int, centre array<double>").orderBy("c").collect()])
    return _assigned(units, centres) if len(centres) else rows.select("id", F.lit(0).alias("cluster")).limit(0)


def sequential(rows: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(id, cluster): runs of equal length in the order of ids, for where nothing can be learned."""
    n = rows.count()
    placed = numbered(rows.select("id", F.lit(0).alias("all")), ["all"], ["id"], "place", scratch)
    return placed.select("id", F.floor(F.col("place") / F.lit(n // max(k, 1) + 1)).cast("int").alias("cluster"))
