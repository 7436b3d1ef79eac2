"""Exact search and similarity over vector tables.

Pairs are scored block by block: vectors are dealt into blocks whose number grows with
their group, each pair of blocks is one task's matrix product, and top-k or threshold is applied
there, so neither side is ever collected or broadcast and no pair below the threshold
leaves a task. Rows have explicit ids; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V

#: Vectors of a block; a task holds two blocks and a strip of their product.
BLOCK_ROWS = 16_384


def usable(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Rows with finite vectors that are not zero."""
    return vectors.where(V.finite(F.col(vec)) & V.nonzero(F.col(vec)))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column without nulls as rows, in double precision."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pc.count_distinct(pc.list_value_length(lists)).as_py() > 1:
        raise ValueError("vectors of a group have different lengths")
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)


def _units(column: pa.ChunkedArray) -> np.ndarray:
    out = matrix(column)
    lengths = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(lengths > 0, lengths, 1)


#: Rows of a block that are scored at a time.
_STRIP = 256
#: Similarities of a row whose largest stands for them where a bound of the k-th is sought.
_RUN = 64


def _above(table: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sim) of the pairs a < b of a pair of blocks with a cosine of at least ``least``, by strips of rows."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    ids, side = np.asarray(table.column("id")), np.asarray(table.column("side"))
    units = _units(table.column("vec"))
    left, right = (np.flatnonzero(side == i), np.flatnonzero(side == j)) if i != j else (np.arange(len(ids)),) * 2
    other, out = units[right].T, []
    for s in range(0, len(left), _STRIP):
        part = left[s : s + _STRIP]
        sims = units[part] @ other
        x, y = np.nonzero(sims >= least)
        a, b = ids[part[x]], ids[right[y]]
        # a block with itself has each pair twice
        kept = a < b if i == j else a != b
        out.append((np.minimum(a, b)[kept], np.maximum(a, b)[kept], np.clip(sims[x, y], -1, 1)[kept]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (ids[:0], ids[:0], np.zeros(0))


def block_pairs(vectors: DataFrame, group: str | None, symmetric: bool, keep: tuple[str, ...] = (), block_rows: int | None = None) -> DataFrame:
    """Each vector once for every pair of blocks of its group that it is in: columns g, i, j, side, id, vec and ``keep``.

    A group has as many blocks as its own rows need, so rows of small groups are dealt once
    (twice where the pairs are ordered). Rows whose group is null are in no pair.
    """
    key = F.col(group).cast("string") if group else F.lit("")
    rows = vectors.select(key.alias("g"), "id", "vec", *keep)
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / F.lit(min(block_rows or BLOCK_ROWS, BLOCK_ROWS))).cast("int").alias("blocks"))
    rows = rows.join(sizes, "g").withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    if symmetric:
        pairs = F.transform(every, lambda x: F.struct(F.least(x, F.col("k")).alias("i"), F.greatest(x, F.col("k")).alias("j")))
        return rows.withColumn("p", F.explode(pairs)).select("g", "p.i", "p.j", F.col("k").alias("side"), "id", "vec", *keep)
    places = F.array(F.struct(F.col("k").alias("i"), F.col("x").alias("j"), F.lit(0).alias("side")), F.struct(F.col("x").alias("i"), F.col("k").alias("j"), F.lit(1).alias("side")))
    return rows.withColumn("x", F.explode(every)).withColumn("p", F.explode(places)).select("g", "p.i", "p.j", "p.side", "id", "vec", *keep)


def threshold_pairs(vectors: DataFrame, least: float, group: str | None = None) -> DataFrame:
    """(a, b, sim) of all pairs a < b with a cosine of at least ``least``, within equal ``group`` if given.

    vectors: id (long), vec. Rows without a finite, non-zero vector are in no pair.
    """
    dealt = block_pairs(usable(vectors), group, True)

    def score(table: pa.Table) -> pa.Table:
        a, b, sim = _above(table, least)
        return pa.table({"a": a, "b": b, "sim": sim})

    return dealt.groupBy("g", "i", "j").applyInArrow(score, "a long, b long, sim double")


def pair_summary(vectors: DataFrame, least: float, group: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Of the pairs of ``threshold_pairs``: (group, n_pairs, most) and (group, a, b, sim, rank) of the first ``most`` of each group, by similarity, a and b.

    A pair of blocks gives its count and its first pairs, so no other pair leaves a task.
    """
    dealt = block_pairs(usable(vectors), group, True)

    def score(table: pa.Table) -> pa.Table:
        a, b, found = _above(table, least)
        first = np.lexsort((b, a, -np.round(found, 12)))[:most]
        # the count and the largest come with the first row
        n = np.zeros(len(first), np.int64)
        n[:1] = len(found)
        return pa.table({"g": pa.array([table.column("g")[0].as_py()] * len(first), pa.string()), "a": a[first], "b": b[first], "sim": found[first], "n": n})

    found = dealt.groupBy("g", "i", "j").applyInArrow(score, "g string, a long, b long, sim double, n long")
    kind = vectors.schema[group].dataType
    named = F.col("g").cast(kind).alias(group)
    counts = found.groupBy("g").agg(F.sum("n").alias("n_pairs"), F.max("sim").alias("most")).select(named, "n_pairs", "most")
    order = Window.partitionBy("g").orderBy(F.round("sim", 12).desc(), "a", "b")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return counts, best.select(named, "a", "b", "sim", "rank")


def equal_classes(vectors: DataFrame, group: str | None = None) -> DataFrame:
    """(id, vec, class_id, copies) of usable vectors: class_id is the smallest id of those equal to it, copies their number.

    Pairs are sought between the rows whose id is their class_id; copies then add no pairs, only members.
    """
    keys = [*([group] if group else []), "h1", "h2"]
    rows = usable(vectors).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(2), "vec")})
    found = rows.groupBy(*keys).agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    return rows.join(found, keys).drop("h1", "h2")


def _nearest(ids: np.ndarray, units: np.ndarray, others: np.ndarray, vectors: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sim) of the k most similar of ``others``, which ascend, for each id, by strips of rows; ties by smaller id."""
    out = []
    for s in range(0, len(ids) if len(others) else 0, _STRIP):
        sims = units[s : s + _STRIP] @ vectors.T
        own = ids[s : s + _STRIP]
        first, last = np.searchsorted(others, own, "left"), np.searchsorted(others, own, "right")
        for row in np.flatnonzero(last > first).tolist():
            sims[row, first[row] : last[row]] = -np.inf
        # the k-th of the largest of runs is no larger than the k-th of all
        tops = np.maximum.reduceat(sims, np.arange(0, len(others), _RUN), axis=1)
        floor = np.partition(tops, -k, axis=1)[:, -k] if k <= tops.shape[1] else np.full(len(sims), -2.0)
        # rounding to twelve digits lets more tie with the k-th than are equal to it
        floor = np.maximum(floor - 2e-12, -2.0 if least is None else least - 2e-12)
        x, y = np.nonzero(sims >= floor[:, None])
        sim = np.clip(sims[x, y], -1, 1)
        if least is not None:
            x, y, sim = x[sim >= least], y[sim >= least], sim[sim >= least]
        order = np.lexsort((y, -np.round(sim, 12), x))
        x, y, sim = x[order], y[order], sim[order]
        kept = np.arange(len(x)) - np.searchsorted(x, x) < k
        out.append((ids[s + x[kept]], others[y[kept]], sim[kept]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (ids[:0], ids[:0], np.zeros(0))


def top_neighbours(vectors: DataFrame, k: int, group: str | None = None, least: float | None = None) -> DataFrame:
    """(a, b, sim, rank): the k most similar other vectors of each, exact; ties by smaller id.

    A pair of blocks is scored once, for the rows of either side.
    """
    dealt = block_pairs(usable(vectors), group, True)

    def score(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        table = table.sort_by("id")
        ids, side, units = np.asarray(table.column("id")), np.asarray(table.column("side")), _units(table.column("vec"))
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        found = [_nearest(ids[left], units[left], ids[right], units[right], k, least)]
        if i != j:
            found.append(_nearest(ids[right], units[right], ids[left], units[left], k, least))
        a, b, sim = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"a": a, "b": b, "sim": sim})

    best = dealt.groupBy("g", "i", "j").applyInArrow(score, "a long, b long, sim double")
    order = Window.partitionBy("a").orderBy(F.round("sim", 12).desc(), "b")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def centroids(vectors: DataFrame, group: str | None = None) -> DataFrame:
    """(group, centroid, n): component-wise mean of vectors of one length, with one partial sum a batch and group before the shuffle.

    Vectors that are null, or have a null component, count for nothing.
    """
    key = F.col(group) if group else F.lit("")
    kind = vectors.schema[group].dataType.simpleString() if group else "string"
    rows = vectors.select(key.alias("g"), V.doubles(F.col("vec")).alias("vec")).where(F.forall("vec", lambda x: x.isNotNull()) & (F.size("vec") > 0))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pc.dictionary_encode(batch.column("g"), null_encoding="encode")
            of = np.asarray(names.indices, np.int64)
            lists = batch.column("vec")
            lengths = np.asarray(pc.list_value_length(lists))
            values = np.asarray(lists.flatten(), np.float64)
            for size in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == size)
                starts = (np.cumsum(lengths) - lengths)[own]
                block = values[starts[:, None] + np.arange(size)]
                order = np.argsort(of[own], kind="stable")
                codes, first = np.unique(of[own][order], return_index=True)
                sums = np.add.reduceat(block[order], first, axis=0)
                counts = np.diff(np.append(first, len(own)))
                made = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, size), pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(codes)), made, pa.array(counts, pa.int64())], names=["g", "s", "n"])

    parts = rows.mapInArrow(add, f"g {kind}, s array<double>, n long")
    sums = parts.select("g", "n", F.posexplode("s").alias("pos", "x")).groupBy("g", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    # a list has as many items as a vector components
    gathered = sums.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("p"), F.max("n").alias("n"))
    mean = F.transform("p", lambda p: p["x"] / F.col("n"))
    return gathered.select(*([F.col("g").alias(group)] if group else []), mean.alias("centroid"), "n")


def related(vectors: DataFrame, k: int = 3, extra: int = 5) -> DataFrame:
    """(a, b, sim, rank): the k most similar pages of each page's section that are no index pages.

    vectors: id, vec, section, path, is_index. k + extra neighbours are taken before pages of
    the same path and index pages go, so a page may get fewer than k. Rows with an empty
    section are left out, and nothing is related to a page without a usable vector.
    """
    rows = vectors.where(F.coalesce("section", F.lit("")) != "")
    near = top_neighbours(rows.select("id", "vec", "section"), k + extra, "section")
    other = rows.select(F.col("id").alias("b"), F.col("path").alias("b_path"), F.col("is_index").alias("b_index"))
    own = rows.select(F.col("id").alias("a"), F.col("path").alias("a_path"))
    kept = near.join(other, "b").join(own, "a").where("a_path <> b_path AND NOT b_index")
    order = Window.partitionBy("a").orderBy(F.round("sim", 12).desc(), "b")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("a", "b", "sim", "rank")


def duplicate_pairs(vectors: DataFrame, least: float = 0.92, k: int = 10) -> DataFrame:
    """(a, b, sim): pairs of a similarity of at least ``least`` that either side has among its k - 1 nearest."""
    near = top_neighbours(vectors, k - 1, least=least)
    return near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sim").alias("sim"))


def encode_cached(texts: DataFrame, cache: DataFrame, model: str, encode: Callable[[list[str]], np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """Vectors of texts by content hash: (rows with vec, rows to append to the cache).

    texts: id, text. cache: model, text_hash, dim, vec. Each distinct missing text is encoded
    once; a cached vector that is not finite counts as missing; a new one that is not finite
    becomes zeros for its rows and is not appended.
    """
    rows = texts.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    sound = cache.where((F.col("model") == model) & V.finite(F.col("vec"))).groupBy("text_hash").agg(F.first("vec").alias("vec"))
    wanted = rows.select("text_hash", "text").dropDuplicates(["text_hash"]).join(sound, "text_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = np.asarray(encode(batch["text"].fillna("").tolist()), dtype=np.float32)
            if len(made) != len(batch):
                raise ValueError(f"the encoder returned {len(made)} vectors for {len(batch)} texts")
            yield pd.DataFrame({"text_hash": batch["text_hash"], "vec": list(made)})

    fresh = wanted.mapInPandas(run, "text_hash string, vec array<float>")
    append = fresh.where(V.finite(F.col("vec"))).select(F.lit(model).alias("model"), "text_hash", F.size("vec").alias("dim"), "vec")
    known = sound.unionByName(fresh.select("text_hash", V.repaired(F.col("vec")).cast("array<float>").alias("vec")))
    return rows.join(known, "text_hash", "left").select("id", "text_hash", "vec"), append


def hashing_encoder(dimensions: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder for tests and machines without a model: words hashed into signed slots, unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % dimensions] += 1 if h & 0x8000_0000 else -1
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(lengths > 0, lengths, 1)

    return encode
