"""Packing of documents into sequences of bounded length by a grouping genetic algorithm.

Documents are tokenized once; pieces of full length are sequences of their own. The others
are dealt by hash into groups of a few thousand. A group is solved by several islands,
each a task: an individual is a set of bins; crossover injects whole well-filled bins of
one parent into the other, removes the bins that then hold an item twice, and best-fits
the displaced items; mutation dissolves poorly filled bins. After an epoch the elites of
each island migrate to the next. The least filled bins of all groups are dissolved and
their items packed again in fewer groups, until one group is left.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.byte_bpe import model_at
from corpusloom.plans.scratch import Scratch, partitions
from corpusloom.llm.wordhash import together

GROUP_ITEMS = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 6
GENERATIONS = 8
OFFSPRING = 4
#: Share of each group's bins, the least filled, whose items are packed again.
REPACK = 0.02

Bins = list[list[int]]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str, text_col: str, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's ids and its end id; only longer ones are cut, the first piece is the shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in together(batches, 1, 2 << 20):
            columns: list[list] = [[], [], [], [], []]
            ids = batch.column(0).to_pylist()
            for doc, raw in zip(ids, model.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                raw += end
                n = len(raw) // 4
                start, piece = 0, 0
                length = n % capacity or capacity
                while start < n:
                    for c, v in zip(columns, (doc, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])), strict=True):
                        c.append(v)
                    start, piece, length = start + length, piece + 1, capacity
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


class _Free:
    """Bins by free space; the tightest that takes an item is found from a bitmap of free sizes."""

    def __init__(self, capacity: int, sizes: list[int], bins: Bins):
        self.capacity, self.sizes, self.bins = capacity, sizes, bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        for k, items in enumerate(bins):
            self._add(capacity - sum(sizes[i] for i in items), k)

    def _add(self, free: int, k: int) -> None:
        self.by_free[free].append(k)
        self.mask |= 1 << free

    def place(self, item: int) -> None:
        size = self.sizes[item]
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            k = self.by_free[free].pop()
            if not self.by_free[free]:
                self.mask &= ~(1 << free)
        else:
            free, k = self.capacity, len(self.bins)
            self.bins.append([])
        self.bins[k].append(item)
        self._add(free - size, k)


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: Bins | None = None) -> Bins:
    """Puts the items, in their order, each into the fullest bin that takes it."""
    state = _Free(capacity, sizes, [list(b) for b in bins or []])
    for item in items:
        state.place(item)
    return state.bins


def _fills(bins: Bins, sizes: list[int]) -> list[int]:
    return [sum(sizes[i] for i in b) for b in bins]


def fitness(bins: Bins, sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: less is better."""
    return len(bins), -sum((f / capacity) ** 2 for f in _fills(bins, sizes))


def crossover(into: Bins, donor: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Injects about half of the donor's well-filled bins whole; what they displace is best-fitted by falling size."""
    fills = _fills(donor, sizes)
    least = sorted(fills)[len(fills) // 3]
    injected = [b for b, f in zip(donor, fills, strict=True) if f >= least and rng.random() < 0.5]
    held = {i for b in injected for i in b}
    clean = [b for b in into if held.isdisjoint(b)]
    displaced = [i for b in into if not held.isdisjoint(b) for i in b if i not in held]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(displaced, sizes, capacity, injected + clean)


def mutate(bins: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Dissolves the least filled bins and some others, and best-fits their items."""
    order = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    gone = set(order[: 1 + len(order) // 50]) | {k for k in order if rng.random() < 0.03}
    items = [i for k in gone for i in bins[k]]
    items.sort(key=lambda i: -sizes[i] * (1 + 0.05 * rng.random()))
    return best_fit(items, sizes, capacity, [b for k, b in enumerate(bins) if k not in gone])


def least_bins(sizes: list[int], capacity: int) -> int:
    """No packing has fewer bins."""
    return max(math.ceil(sum(sizes) / capacity), sum(s > capacity // 2 for s in sizes))


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[Bins]) -> list[Bins]:
    """The two best individuals of an island after an epoch."""
    rng = random.Random(seed)
    by_size = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bound = least_bins(sizes, capacity)
    score = lambda b: (fitness(b, sizes, capacity), b)
    by_score = lambda x: x[0]
    population = [score(b) for b in elites] or [score(best_fit(by_size, sizes, capacity))]
    if min(len(b) for _, b in population) > bound:
        while len(population) < POPULATION:
            noise = 0.02 * (len(population) + 1)
            order = sorted(by_size, key=lambda i: -sizes[i] * (1 + noise * rng.random()))
            population.append(score(best_fit(order, sizes, capacity)))
        for _ in range(GENERATIONS):
            population.sort(key=by_score)
            if len(population[0][1]) <= bound:
                break
            for _ in range(OFFSPRING):
                one, other = rng.sample(range(len(population)), 2)
                child = crossover(population[max(one, other)][1], population[min(one, other)][1], sizes, capacity, rng)
                population.append(score(mutate(child, sizes, capacity, rng) if rng.random() < 0.5 else child))
            population.sort(key=by_score)
            del population[POPULATION:]
    return [b for _, b in sorted(population, key=by_score)[:2]]


def _labels(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, items in enumerate(bins):
        for i in items:
            out[i] = k
    return out


def _bins(labels: list[int]) -> Bins:
    out: Bins = [[] for _ in range(max(labels, default=-1) + 1)]
    for i, k in enumerate(labels):
        out[k].append(i)
    return [b for b in out if b]


def _solve(groups: DataFrame, capacity: int, scratch: Scratch, count: int) -> DataFrame:
    """Islands, epochs and migration over (grp, rows, sizes); gives (grp, island, rows, sizes, elites)."""
    schema = "grp long, island int, rows array<long>, sizes array<int>, elites array<array<int>>"
    state = groups.select("grp", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "rows", "sizes", F.array().cast("array<array<int>>").alias("elites"))
    for epoch in range(EPOCHS):

        def run(frames: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.itertuples(index=False):
                    sizes = [int(x) for x in r.sizes]
                    best = evolve(sizes, capacity, hash((int(r.grp), int(r.island), epoch)), [_bins([int(x) for x in e]) for e in r.elites])
                    yield pd.DataFrame({"grp": [r.grp], "island": [r.island], "rows": [r.rows], "sizes": [r.sizes], "elites": [[_labels(b, len(sizes)) for b in best]]})

        state = scratch.table(state.repartition(count, "grp", "island").mapInPandas(run, schema), "islands")
        if epoch + 1 < EPOCHS:
            moved = state.select("grp", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("elites", 1, 1).alias("moved"))
            state = state.join(moved, ["grp", "island"]).select("grp", "island", "rows", "sizes", F.concat("elites", "moved").alias("elites"))
    return state


def _place(states: DataFrame, capacity: int, last: bool) -> DataFrame:
    """(row, length, grp, bin, at, again) from each group's best island; again marks items to pack once more."""
    best = states.groupBy("grp").agg(F.min_by(F.struct("rows", "sizes", F.col("elites")[0].alias("labels")), F.struct(F.array_max(F.col("elites")[0]), F.col("island"))).alias("b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                sizes = [int(x) for x in r.sizes]
                bins = _bins([int(x) for x in r.labels])
                fills = _fills(bins, sizes)
                order = sorted(range(len(bins)), key=lambda k: fills[k])
                again = set() if last else {k for k in order[: max(1, int(REPACK * len(bins)))] if fills[k] < capacity}
                out = []
                for k, items in enumerate(bins):
                    at = 0
                    for i in items:
                        out.append((int(r.rows[i]), sizes[i], int(r.grp), k, at, k in again))
                        at += sizes[i]
                yield pd.DataFrame(out, columns=["row", "length", "grp", "bin", "at", "again"])

    return best.select("grp", "b.rows", "b.sizes", "b.labels").mapInPandas(run, "row long, length long, grp long, bin long, at long, again boolean")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty: one piece of the end id alone. Null ids are kept; repeated
    rows are packed each for itself; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch, count = Scratch(spark, "packing"), partitions(spark)
    pieces = scratch.table(token_pieces(docs, tokenizer_path, capacity, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    items = pieces.where(F.col("length") < capacity).select("row", "length")
    placed: DataFrame | None = None
    level = 0
    while True:
        n_groups = max(1, math.ceil(items.count() / GROUP_ITEMS))
        last = n_groups == 1
        grouped = items.groupBy(F.pmod(F.xxhash64("row", F.lit(level)), F.lit(n_groups)).alias("grp")).agg(F.sort_array(F.collect_list(F.struct("row", F.col("length").cast("int").alias("size")))).alias("i"))
        states = _solve(grouped.select("grp", F.col("i.row").alias("rows"), F.col("i.size").alias("sizes")), capacity, scratch, count)
        result = scratch.table(_place(states, capacity, last), "placed")
        scratch.drop(states)
        done = result.where("NOT again").select("row", (F.lit(level << 56) + F.col("grp") * F.lit(1 << 20) + F.col("bin")).alias("sequence_id"), F.col("at").alias("offset"))
        placed = done if placed is None else placed.union(done)
        if last:
            break
        items = result.where("again").select("row", "length")
        level += 1
    whole = pieces.where(F.col("length") >= capacity).select("*", (F.lit(-1) - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).drop("row")
    part = pieces.where(F.col("length") < capacity).join(placed, "row").drop("row")
    return whole.unionByName(part).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
