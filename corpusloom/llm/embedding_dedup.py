"""Near-duplicate vectors by sorted projection passes.

Equal vectors are one class. In each pass the classes of a label are ordered
lexicographically by a key of concatenated random hyperplane hashes, and each is compared
with a bounded window of its successors, across partition borders too. What travels with a
key is the vector in 8 bits a component and a bound on the error that this makes, so no
pair of a window that reaches the threshold is lost; the pairs that may reach it are
united over all passes. Inside the groups that come out, all pairs are compared by their
whole vectors, tile by tile: that settles every link between members, also where a
window is smaller than a group of near copies.

Passes are as many as the chance of a pair at the threshold to share a window asks for:
they grow with the size of the largest label, so that the share of pairs found does not
fall (RECALL, of isolated pairs at the threshold itself; closer pairs and larger groups
are found more surely).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.graph import components
from corpusloom.plans.scratch import Scratch, partitions

#: Share of the pairs at the threshold that the passes are to find, and least number of passes.
RECALL, LEAST_PASSES = 0.98, 6
#: Hashes in a key, successors that a row is compared with, and rows compared at once.
KEY_BITS, WINDOW, CHUNK_ROWS = 62, 256, 1024
#: Members of a group in a tile at most; a group of fewer is dealt to up to TILES tiles of LEAST_ROWS and more.
TILE_ROWS, LEAST_ROWS, TILES = 4096, 256, 8
#: Members of small groups that share a task.
SHARED_ROWS = 512
#: Rows and columns of products held at once.
BLOCK_ROWS, BLOCK_COLUMNS = 512, 8192


def _vectors(column, kind: str = "<f4") -> np.ndarray:
    """Vectors of equal length from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _narrow_unit(vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([_unit(vectors[k : k + BLOCK_COLUMNS]).astype(np.float32) for k in range(0, len(vectors), BLOCK_COLUMNS)])


def close_pairs(left: np.ndarray, right: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b) of all pairs of rows within the threshold, block by block; of a side with itself each pair once."""
    narrow = _narrow_unit(left), _narrow_unit(right)
    # more than the error of a product of unit vectors in 32 bits
    slack = (left.shape[1] + 8) * 2.0**-23
    for at in range(0, len(left), BLOCK_ROWS):
        for to in range(at if same else 0, len(right), BLOCK_COLUMNS):
            scores = narrow[0][at : at + BLOCK_ROWS] @ narrow[1][to : to + BLOCK_COLUMNS].T
            a, b = np.nonzero(scores >= threshold - slack)
            keep = scores[a, b] >= threshold + slack
            a, b = a + at, b + to
            unsure = np.flatnonzero(~keep)
            for k in range(0, len(unsure), BLOCK_COLUMNS):
                some = unsure[k : k + BLOCK_COLUMNS]
                keep[some] = np.einsum("ij,ij->i", _unit(left[a[some]]), _unit(right[b[some]])) >= threshold
            if same:
                keep &= a < b
            if keep.any():
                yield a[keep], b[keep]


def _unite(tree: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tree of each position after the pairs (a, b) joined theirs."""
    while True:
        x, y = tree[a], tree[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return tree
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        # one pair of every tree on either side, then the rest again
        picked = np.union1d(np.unique(x, return_index=True)[1], np.unique(y, return_index=True)[1])
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while (up := parent.setdefault(i, i)) != i:
                parent[i] = parent.setdefault(up, up)
                i = up
            return i

        for i, j in zip(x[picked].tolist(), y[picked].tolist(), strict=True):
            parent[root(i)] = root(j)
        joined = np.arange(len(tree))
        for i in list(parent):
            joined[i] = root(i)
        tree = joined[tree]


def passes(n: int, threshold: float, window: int) -> int:
    """Passes over n rows after which a pair at the threshold has shared a window with a chance of RECALL.

    Two vectors at an angle agree in a random hyperplane's hash with a chance of 1 - angle / pi,
    and rows that agree in the first log2(n / window) hashes are about a window apart.
    """
    agree = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    shared = min(0.99, agree ** max(0.0, math.log2(max(1, n) / window)))
    return max(LEAST_PASSES, math.ceil(math.log(1 - RECALL) / math.log(1 - shared)))


def projection(turn: int, dimensions: int) -> np.ndarray:
    """Random hyperplanes of a pass."""
    return np.random.default_rng([turn, dimensions]).standard_normal((dimensions, KEY_BITS))


def narrowed(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in 8 bits a component, and for each a bound on how far a product with any other narrowed one is off.

    The factor that makes integers into components again stands in the first four bytes.
    """
    step = np.maximum(np.abs(units).max(1) / 127, 1e-30).astype(np.float32)
    whole = np.rint(units / step[:, None]).astype(np.int8)
    away = np.linalg.norm(units - whole * step[:, None].astype(np.float64), axis=1)
    packed = np.concatenate([step.view(np.uint8).reshape(-1, 4), whole.view(np.uint8)], axis=1)
    # x.y - x'.y' = (x - x').y + x'.(y - y'), and x' is no longer than 1 + away
    return packed, away * (1 + away) + 1e-6


def _widened(column) -> np.ndarray:
    packed = _vectors(column, "u1")
    return packed[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(packed[:, :4]).view(np.float32)


def _window_pairs(group: np.ndarray, vectors: np.ndarray, slack: np.ndarray, threshold: float, window: int, fresh: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b), a < b, of rows of one group at most a window apart that may reach the threshold; b from ``fresh`` on."""
    for at in range(0, len(group), CHUNK_ROWS):
        end = min(len(group), at + CHUNK_ROWS + window)
        if end <= fresh:
            continue
        scores = vectors[at : at + CHUNK_ROWS] @ vectors[at:end].T
        scores += slack[at : at + CHUNK_ROWS, None]
        scores += slack[None, at:end]
        a, b = np.nonzero(scores >= threshold)
        near = (b > a) & (b - a <= window)
        a, b = a[near] + at, b[near] + at
        keep = (b >= fresh) & (group[a] == group[b])
        yield a[keep], b[keep]


def _forest(node: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what the pairs of positions connect."""
    tree = np.arange(len(node))
    for a, b in pairs:
        tree = _unite(tree, a, b)
    joined = np.flatnonzero(tree != np.arange(len(node)))
    return node[joined], node[tree[joined]]


def _candidates(classes: DataFrame, threshold: float, kind: str, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between classes that connect all that a window of any pass shows to be close, or nearly so."""
    spark = classes.sparkSession
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0]
    turns = passes(largest or 0, threshold, WINDOW)
    order = ["turn", "label", "dim", "key", "node"]
    carried = "turn int, label long, dim int, key long, node long, slack float, vec binary"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(KEY_BITS - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                units = _unit(_vectors(part.column("vec"), kind))
                packed, slack = narrowed(units)
                held = pa.array([row.tobytes() for row in packed], pa.binary())
                slack = pa.array(slack.astype(np.float32))
                for turn in range(turns):
                    keys = ((units @ projection(turn, int(dim))) > 0).astype(np.int64) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), turn, np.int32)), part.column("label"), part.column("dim"), pa.array(keys), part.column("node"), slack, held], names=["turn", "label", "dim", "key", "node", "slack", "vec"])

    def within(rows: pa.Table, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Forest of the pairs in sorted rows whose later one is at ``first`` or after."""
        turn, label, dim, node, slack = (np.asarray(rows.column(c)) for c in ("turn", "label", "dim", "node", "slack"))
        new = np.ones(len(turn), bool)
        new[1:] = (turn[1:] != turn[:-1]) | (label[1:] != label[:-1]) | (dim[1:] != dim[:-1])
        group = np.cumsum(new)
        left, right = [], []
        cuts = [0, *(np.flatnonzero(dim[1:] != dim[:-1]) + 1).tolist(), len(dim)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1 and b > first:
                found = _forest(node[a:b], _window_pairs(group[a:b], _widened(rows.column("vec").slice(a, b - a)), slack[a:b], threshold, WINDOW, max(0, first - a)))
                left.append(found[0])
                right.append(found[1])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    fields = ["turn", "label", "dim", "key", "node", "slack", "vec"]

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges within a partition (border null), and its first and last rows for the borders with the partitions before and after."""
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        held: pa.Table | None = None
        seen = 0
        names = ["a", "b", "border", *fields]

        def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            empty = [pa.nulls(len(a), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float32(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *empty], names=names)

        def border(rows: pa.Table, at: int) -> pa.RecordBatch:
            n = rows.num_rows
            rows = rows.combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([at] * n, pa.int32()), *rows.columns], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if seen < WINDOW:
                yield border(rows.slice(0, WINDOW - seen), here)
            seen += batch.num_rows
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            yield edges(*within(rows, 0 if held is None else held.num_rows))
            held = rows.slice(max(0, rows.num_rows - WINDOW))
        if held is not None:
            yield border(held, here + 1)

    def across(rows: pa.Table) -> pa.Table:
        """Edges between the last rows of a partition and the first of the next."""
        rows = rows.sort_by([(c, "ascending") for c in order])
        a, b = within(rows, 0)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = classes.select("label", "dim", "node", "vec").mapInArrow(keyed, carried)
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select(*fields)
    found = scratch.table(rows.mapInArrow(slide, f"a long, b long, border int, {carried}"), "windows")
    borders = found.where("border IS NOT NULL").drop("a", "b").groupBy("border").applyInArrow(across, "a long, b long")
    return found.where("border IS NULL").select("a", "b").union(borders)


def _close_classes(members: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(node, other_links, root) of each class with links to others of its group.

    members: component, size (of the component), node, copies, vec. other_links counts the
    copies of the other classes, tile by tile; root is a class that it is connected with.
    """
    shared = F.col("size") <= SHARED_ROWS // 2
    small = members.where(shared).count()
    deals = max(1, -(-small // SHARED_ROWS))
    tiles = F.greatest(F.ceil(F.col("size") / TILE_ROWS), F.least(F.lit(TILES), F.ceil(F.col("size") / LEAST_ROWS))).cast("long")
    none = F.lit(-1).cast("long")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("tile")).alias("i"), F.greatest(k, F.col("tile")).alias("j")))
    tiled = members.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    dealt = (
        tiled.withColumn("pair", F.explode(F.when(shared, F.array(F.struct(none.alias("i"), none.alias("j")))).otherwise(pairs)))
        .withColumn("deal", F.when(shared, F.pmod(F.xxhash64("component"), F.lit(deals))).otherwise(F.col("component")))
        .select("deal", "pair.i", "pair.j", "component", "tile", "node", "copies", "vec")
    )

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        table = table.sort_by("component")
        component, node, copies, tile = (np.asarray(table.column(c)) for c in ("component", "node", "copies", "tile"))
        found, tree = np.zeros(len(node), np.int64), np.arange(len(node))
        cuts = [0, *(np.flatnonzero(component[1:] != component[:-1]) + 1).tolist(), len(node)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            vectors = _vectors(table.column("vec").slice(start, end - start), kind)
            own = np.arange(start, end)
            sides = [own, own] if i == j else [own[tile[own] == i], own[tile[own] != i]]
            for a, b in close_pairs(vectors[sides[0] - start], vectors[sides[1] - start], threshold, i == j) if len(sides[0]) and len(sides[1]) else ():
                a, b = sides[0][a], sides[1][b]
                for x, y in ((a, b), (b, a)):
                    found += np.bincount(x, copies[y], len(node)).astype(np.int64)
                tree = _unite(tree, a, b)
        linked = np.flatnonzero(found)
        return pa.table({"node": pa.array(node[linked], pa.int64()), "other_links": pa.array(found[linked], pa.int64()), "root": pa.array(node[tree[linked]], pa.int64())})

    return dealt.groupBy("deal", "i", "j").applyInArrow(compare, "node long, other_links long, root long")


def link_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Vectors are compared when their labels, of any type that can be joined, are equal and not null and their lengths are
    equal, in the column's own precision. Rows with a null id, a null or empty or zero
    vector, or one with null or non-finite components link with nothing: n_links 0 and
    their own id as component. Repeated rows link with each other. A cosine equal to the
    threshold links. Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    wide = isinstance(vectors.schema[vec_col].dataType, T.ArrayType) and isinstance(vectors.schema[vec_col].dataType.elementType, T.DoubleType)
    kind, vec = ("<f8", F.col(vec_col)) if wide else ("<f4", F.col(vec_col).cast("array<float>"))
    usable = F.coalesce(
        F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vec) > 0)
        & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(vec, lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vec.alias("v"), usable.alias("usable"))
    if isinstance(vectors.schema[label_col].dataType, T.IntegralType):
        rows = rows.withColumn("label", F.col("label").cast("long"))
    else:  # labels that are no whole numbers are numbered
        numbers = scratch.table(rows.where("usable").select(F.col("label").alias("named")).distinct().withColumn("label", F.monotonically_increasing_id()), "labels")
        rows = rows.withColumnRenamed("label", "named").join(numbers, "named", "left").select("id", "label", "v", "usable")
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(2), "v")})

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.asarray(v, kind).tobytes() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(h) // int(kind[2]) for h in held], pa.int32()), pa.array(held, pa.binary())], names=[*batch.schema.names[:-1], "dim", "vec"])

    first = rows.where("usable").groupBy("label", "h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # written once, so the number of a class stays
    first = first.mapInArrow(as_bytes, "label long, h1 long, h2 long, first_id long, copies long, dim int, vec binary").withColumn("node", F.monotonically_increasing_id())
    classes = scratch.table(first, "classes")
    groups = scratch.table(components(_candidates(classes, threshold, kind, scratch), scratch), "groups")
    sizes = scratch.table(groups.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    members = classes.select("node", "copies", "vec").join(groups.join(sizes, "component"), "node")
    close = scratch.table(_close_classes(scratch.table(members, "members"), threshold, kind), "close")
    found = scratch.table(components(close.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch), "found")
    named = scratch.table(found.join(classes.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("component_id")), "named")
    links = close.groupBy("node").agg(F.sum("other_links").alias("other_links"))
    linked = found.join(links, "node").join(named, "component").select("node", "other_links", "component_id")
    per_class = classes.join(linked, "node", "left").select(
        "label", "h1", "h2", (F.col("copies") - 1 + F.coalesce("other_links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    per_class = scratch.table(per_class, "per-class")
    usable_rows = rows.where("usable").select("id", "label", "h1", "h2").join(per_class, ["label", "h1", "h2"]).select("id", "n_links", "component_id")
    other = rows.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return usable_rows.union(other).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
