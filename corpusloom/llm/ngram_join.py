"""Exact Jaccard join of documents on word shingles.

Equal shingle sets are one node. Two sets that reach the similarity share one of their
first few shingles under any common order (the prefix); here rare shingles come first,
by a counting sketch of fixed size, so common ones bring hardly any sets together. The
first shingle that two linking sets share stands so early in the smaller one that few of
its shingles come into question. Sets of fitting sizes that meet in such a shingle are
paired and kept where bitmaps of the parities of hashed shingles (marks) let them link; sets
of a shingle that many have are chained instead. That gives candidate groups that no link
leaves. A chain of sets that only met by chance would make one group of most of a large
table, as in it many shingles are shared by chance. Groups are compared in tiles
by band of set size and, where a band is large, salt: a band with itself and with the
next, as sets further apart in size cannot link. That is done twice. First tiles hold
marks only: as many bits as two marks differ
in, so many shingles at least are in one of the two sets only. Sets that no mark lets link
go, and groups fall apart. Then tiles hold the whole sets that are left: hashed bitmap
signatures bound the overlap of two sets from above by bit counts, and what may reach the
similarity is decided by intersecting the sorted shingle arrays. Texts are dealt again only
where a bitmap of ids says that they may be in a group.

Shingle hashes have 64 bits; a set is named by a 64-bit hash of its sorted shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.graph import components
from corpusloom.plans.scratch import Scratch, partitions
from corpusloom.llm.wordhash import by_part, fine_parts, give_back, mix, pack, shingle_sets, text_bytes, together, unpack, word_hashes

#: Bytes of text that are taken together, slots of the sketch, and sets in a tile.
SLICE = 2 << 20
SKETCH_BITS = 22
TILE_ROWS = 256
#: Sets with a shingle among their first that are paired; more are chained.
PAIRED = 16
_SKETCH_PARTS = 16
#: Slots of the bitmap of ids in groups, and those of one row of it.
ID_SLOTS, _ID_ROW = 1 << 25, 1 << 15


@dataclass(frozen=True)
class Similarity:
    """Two sets link when scale * overlap >= least * union."""

    words: int = 3
    least: int = 90
    scale: int = 100

    def sizes_fit(self, small, large):
        return self.scale * small >= self.least * large

    def overlap_fits(self, overlap, a, b):
        return self.scale * overlap >= self.least * (a + b - overlap)

    def prefix(self, n: int) -> int:
        """How many of a set's first shingles it shares at least one of with any set that it links with."""
        return n - -(-self.least * n // self.scale) + 1

    def early(self, n):
        """How many shingles can come before the first one that a set shares with one that is no smaller and links with it."""
        return n - -(-2 * self.least * n // (self.scale + self.least))

    def largest(self, n, before):
        """Size up to which a smaller set can link with one of n shingles of which ``before`` come before the first shared one."""
        return (n - before) * (self.scale + self.least) // self.least - n

    def band(self, n) -> F.Column:
        """Sets that link are in the same band of sizes or in adjacent ones."""
        return F.floor(F.log(n.cast("double")) / F.lit(math.log(self.scale / self.least)) * F.lit(1 - 1e-9)).cast("long")


def _sets(batch: pa.RecordBatch, similarity: Similarity) -> Iterator[np.ndarray]:
    data, offsets = text_bytes(batch.column("text"))
    hashes, word_offsets, _, _ = word_hashes(data, offsets, lower=True)
    return shingle_sets(hashes, word_offsets, similarity.words)


def _name(shingles: np.ndarray) -> int:
    """64-bit name of a set, from all of its shingles in order."""
    salted = mix(shingles + np.arange(1, len(shingles) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return int(mix(np.array([np.add.reduce(salted, dtype=np.uint64) ^ np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def parities(shingles: np.ndarray) -> bytes:
    """Mark of a set: whether an odd number of its shingles falls into each slot, for at least half as many slots as shingles."""
    slots = 1 << max(8, (len(shingles) // 2).bit_length())
    odd = np.bincount((mix(shingles) & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def frequency_sketch(rows: DataFrame, similarity: Similarity) -> np.ndarray:
    """How many texts have a shingle in each slot; a fixed number of slots whatever the input."""
    size = 1 << SKETCH_BITS
    each = size // _SKETCH_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.uint32)
        for batch in together(batches, 1, SLICE):
            for shingles in _sets(batch, similarity):
                np.add.at(counts, (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
        packed = zstandard.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(_SKETCH_PARTS), pa.int32()), pa.array([packed.compress(counts[k * each : (k + 1) * each].tobytes()) for k in range(_SKETCH_PARTS)], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zstandard.ZstdDecompressor().decompress(counts.as_py()), np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([np.minimum(s, 2**32 - 1).astype(np.uint32).tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"])

    sketch = np.zeros(size, np.uint32)
    for row in rows.mapInArrow(count, "part int, counts binary").repartitionById(_SKETCH_PARTS, "part").mapInArrow(add, "part int, counts binary").collect():
        sketch[row.part * each : (row.part + 1) * each] = np.frombuffer(row.counts, np.uint32)
    give_back()
    return sketch


def chained(token: np.ndarray, name: np.ndarray, size: np.ndarray, before: np.ndarray, similarity: Similarity) -> np.ndarray:
    """Distinct pairs of names that connect all sets which may link because of a shingle: rows (smaller name, larger).

    Of two sets that link, the smaller has the first shared shingle early. Each set is joined
    to the largest early one that its own place of the shingle allows; early ones of fitting
    sizes are thereby chained, so every other one that it may link with is connected too.
    """
    order = np.lexsort((name, size, token))
    token, name, size, before = token[order], name[order], size[order], before[order]
    _, group = np.unique(token, return_inverse=True)
    early = np.flatnonzero(before <= similarity.early(size))
    if not len(early):
        return np.zeros((0, 2), np.int64)
    span = np.int64(1) << np.int64(40)
    key = group[early] * span + np.minimum(size[early], span - 2)
    # the last early set in the shingle's group that is not larger than allowed, and not the set itself
    allowed = group * span + np.clip(np.minimum(similarity.largest(size, before), size), 0, span - 2)
    at = np.searchsorted(key, allowed, "right") - 1
    own = np.searchsorted(early, np.arange(len(size)), "left")
    at = np.minimum(at, own - 1)
    ok = at >= 0
    to = early[np.maximum(at, 0)]
    ok &= (group[to] == group) & (name[to] != name) & similarity.sizes_fit(size[to], size)
    a, b = name[to[ok]], name[ok]
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)


def meeting(token: np.ndarray, name: np.ndarray, size: np.ndarray, before: np.ndarray, similarity: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of names: all that may link because of a shingle that no more than PAIRED sets have, and the chains of the others."""
    order = np.lexsort((name, size, token))
    token, name, size, before = token[order], name[order], size[order], before[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])
    token, name, size, before = token[fresh], name[fresh], size[fresh], before[fresh]
    _, group, sets = np.unique(token, return_inverse=True, return_counts=True)
    sets = sets[group]
    many = sets > PAIRED
    some = (sets > 1) & ~many
    chains = chained(token[many], name[many], size[many], before[many], similarity)
    group, name, size, before = group[some], name[some], size[some], before[some]
    early, allowed = before <= similarity.early(size), similarity.largest(size, before)
    found = [np.zeros((0, 2), np.int64)]
    for step in range(1, int(sets[some].max(initial=1))):
        small = np.flatnonzero((group[step:] == group[:-step]) & early[:-step])
        large = small + step
        ok = (size[small] <= allowed[large]) & similarity.sizes_fit(size[small], size[large])
        a, b = name[small[ok]], name[large[ok]]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
    return np.unique(np.concatenate(found), axis=0), chains


def _candidates(rows: DataFrame, similarity: Similarity, scratch: Scratch, count: int) -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, node, mark) of every row, node null for an empty set; and candidate edges (a, b, paired) between nodes.

    A node has its mark with one of its rows at least. Edges that are not paired stand for
    others too, so that none of them may go.
    """
    sketch = rows.sparkSession.sparkContext.broadcast(frequency_sketch(rows, similarity))
    fine = fine_parts(count)
    ranges = count * fine

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches, 1, SLICE):
            sizes, names, marks, tokens, token_names, token_sizes, token_before = [], [], [], [], [], [], []
            seen: set[int] = set()
            for shingles in _sets(batch, similarity):
                n = len(shingles)
                sizes.append(n)
                marks.append(None)
                if not n:
                    names.append(None)
                    continue
                name = _name(shingles)
                names.append(name)
                if name in seen:
                    continue
                seen.add(name)
                marks[-1] = parities(shingles)
                often = sketch.value[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                first = shingles[np.lexsort((shingles, often))[: similarity.prefix(n)]]
                tokens.append(first)
                token_names.append(np.full(len(first), name, np.int64))
                token_sizes.append(np.full(len(first), n, np.int64))
                token_before.append(np.arange(len(first)))
            parts, blobs = [], []
            if tokens:
                token = np.concatenate(tokens)
                order = np.argsort(token, kind="stable")
                token, name, size, before = token[order], np.concatenate(token_names)[order], np.concatenate(token_sizes)[order], np.concatenate(token_before)[order]
                edges = np.append(np.searchsorted(token, np.array([(k << 64) // ranges for k in range(ranges)], np.uint64)), len(token))
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    own = slice(edges[k], edges[k + 1])
                    parts.append(k)
                    blobs.append(pack(token[own], *[c[own].astype(np.int64).view(np.uint64) for c in (name, size, before)]))
            n, m = batch.num_rows, len(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column(0), pa.nulls(m, pa.int64())]),
                    pa.array(sizes + [None] * m, pa.int64()),
                    pa.array(names + [None] * m, pa.int64()),
                    pa.array(marks + [None] * m, pa.binary()),
                    pa.array([None] * n + parts, pa.int32()),
                    pa.array([None] * n + blobs, pa.binary()),
                ],
                names=["id", "n_shingles", "node", "mark", "part", "blob"],
            )

    made = scratch.table(rows.mapInArrow(prefixes, "id long, n_shingles long, node long, mark binary, part int, blob binary"), "prefixes")
    sketch.unpersist()
    give_back()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in by_part(batches):
            columns = [np.concatenate(c) for c in zip(*(unpack(blob.as_py(), 4) for blob in part.column("blob")), strict=True)]
            pairs, chains = meeting(columns[0], *[c.view(np.int64) for c in columns[1:]], similarity)
            both = np.concatenate([pairs, chains])
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.arange(len(both)) < len(pairs))], names=["a", "b", "paired"])
        give_back()

    dealt = made.where("part IS NOT NULL").select("part", "blob").repartitionById(count, F.floor(F.col("part") / fine).cast("int")).sortWithinPartitions("part")
    edges = scratch.table(dealt.mapInArrow(chain, "a long, b long, paired boolean"), "candidates")
    sized = scratch.table(made.where("part IS NULL").select("id", "n_shingles", "node", "mark"), "sized")
    scratch.drop(made)
    return sized, edges


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of hashed shingles, at least twice as wide as the largest set up to a bound."""
    bits = 1 << min(16, max(8, math.ceil(math.log2(2 * max(map(len, sets))))))
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, shingles in zip(out, sets, strict=True):
        slot = mix(shingles) >> np.uint64(64 - bits.bit_length() + 1)
        np.bitwise_or.at(row, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
    return out


def tile_links(sets: list[np.ndarray], side: np.ndarray | None, similarity: Similarity, every: bool = False) -> list[tuple[int, int]]:
    """Pairs of positions that link: enough of them to connect all that do, or, with ``every``, all.

    side: with it only pairs of different sides count.
    """
    sizes = np.array([len(s) for s in sets])
    marks = signatures(sets)

    def linked(i: int, others: np.ndarray) -> list[int]:
        """Those of the others that link with i."""
        n = int(sizes[i])
        others = others[similarity.sizes_fit(np.minimum(sizes[others], n), np.maximum(sizes[others], n))]
        if side is not None:
            others = others[side[others] != side[i]]
        if not len(others):
            return []
        # a bit that only one of two sets has stands for at least one shingle that the other lacks
        most = np.minimum(n - np.bitwise_count(marks[i] & ~marks[others]).sum(1, dtype=np.int64), sizes[others] - np.bitwise_count(marks[others] & ~marks[i]).sum(1, dtype=np.int64))
        hit = []
        for j in others[similarity.overlap_fits(most, n, sizes[others])].tolist():
            small, large = (sets[i], sets[j]) if n <= sizes[j] else (sets[j], sets[i])
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            if similarity.overlap_fits(int((large[at] == small).sum()), n, int(sizes[j])):
                hit.append(j)
        return hit

    if every:
        return [(i, j) for i in range(len(sets)) for j in linked(i, np.arange(i + 1, len(sets)))]
    return _connecting(len(sets), linked)


def _connecting(n: int, linked: Callable[[int, np.ndarray], list[int]]) -> list[tuple[int, int]]:
    """Pairs of positions below n that connect all that ``linked`` finds."""
    left = np.arange(n)
    found: list[tuple[int, int]] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = linked(i, left)
            if hit:
                found += [(i, j) for j in hit]
                left = left[~np.isin(left, hit)]
                queue += hit
    return found


def tile_possible(sizes: np.ndarray, marks: list[bytes], side: np.ndarray | None, similarity: Similarity) -> list[tuple[int, int]]:
    """Pairs of positions that connect all sets whose sizes and marks let them link; with ``side`` only pairs of different sides count."""
    width = min(map(len, marks)) // 8
    # slots of a wider mark that agree in their low bits are one slot of a narrower one
    folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(m, np.uint64).reshape(-1, width), axis=0) for m in marks])

    def linked(i: int, others: np.ndarray) -> list[int]:
        n = int(sizes[i])
        others = others[similarity.sizes_fit(np.minimum(sizes[others], n), np.maximum(sizes[others], n))]
        if side is not None:
            others = others[side[others] != side[i]]
        apart = np.bitwise_count(folded[i] ^ folded[others]).sum(1, dtype=np.int64)
        return others[similarity.overlap_fits((n + sizes[others] - apart) // 2, n, sizes[others])].tolist()

    return _connecting(len(sizes), linked)


def pairs_possible(small: np.ndarray, large: np.ndarray, marks: tuple[list[bytes], list[bytes]], similarity: Similarity) -> np.ndarray:
    """Whether the sets of each pair may link by sizes and marks."""
    widths = [np.array([len(m) for m in side], np.int64) for side in marks]
    out = np.zeros(len(small), bool)
    for of in np.unique(np.stack(widths, 1), axis=0):
        rows = np.flatnonzero((widths[0] == of[0]) & (widths[1] == of[1]))
        folded = [np.bitwise_xor.reduce(np.frombuffer(b"".join([side[k] for k in rows.tolist()]), np.uint64).reshape(len(rows), -1, min(of) // 8), axis=1) for side in marks]
        a, b = small[rows], large[rows]
        apart = np.bitwise_count(folded[0] ^ folded[1]).sum(1, dtype=np.int64)
        out[rows] = similarity.sizes_fit(np.minimum(a, b), np.maximum(a, b)) & similarity.overlap_fits((a + b - apart) // 2, a, b)
    return out


def _screened(edges: DataFrame, nodes: DataFrame, similarity: Similarity) -> DataFrame:
    """The candidate edges (a, b) without pairs that cannot link by size or mark."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks = ([np.asarray(batch.column(n)) for n in ("n_a", "n_b")], [batch.column(m).to_pylist() for m in ("m_a", "m_b")])
            yield batch.select(["a", "b"]).filter(pa.array(pairs_possible(*sizes, tuple(marks), similarity)))

    end = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("mark").alias(f"m_{c}"))
    pairs = edges.where("paired").select("a", "b").distinct().join(end("a"), "a").join(end("b"), "b")
    return pairs.mapInArrow(screen, "a long, b long").union(edges.where("NOT paired").select("a", "b"))


def _banded(nodes: DataFrame, groups: DataFrame, similarity: Similarity, scratch: Scratch) -> DataFrame:
    """The nodes of groups (node, component), with component, band, and band_size, prior and next: sets of its band and of the two adjacent ones in the component."""
    members = scratch.table(nodes.join(groups, "node").withColumn("band", similarity.band(F.col("n_shingles"))), "members")
    bands = scratch.table(members.groupBy("component", "band").agg(F.count("*").alias("n")), "bands")
    near = bands.select("component", F.explode(F.array(F.struct("band", F.lit("band_size").alias("kind"), "n"), F.struct((F.col("band") + 1).alias("band"), F.lit("prior").alias("kind"), F.col("n")), F.struct((F.col("band") - 1).alias("band"), F.lit("next").alias("kind"), F.col("n")))).alias("x")).select("component", "x.*")
    near = scratch.table(near.groupBy("component", "band").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("band_size", "prior", "next")]), "near")
    return members.join(near, ["component", "band"])


def _tiles(members: DataFrame, *held: str) -> DataFrame:
    """Each member once for every tile that it is in: component, low, i, step, j, node, side and ``held``."""
    tiles_of = lambda n: F.ceil(F.col(n) / TILE_ROWS)
    salt = F.pmod(F.xxhash64("node"), F.greatest(tiles_of("band_size"), F.lit(1)))
    same = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(tiles_of("band_size") - 1, F.lit(0))), lambda k: F.struct(F.col("band").alias("low"), F.least(k, F.col("salt")).alias("i"), F.lit(0).alias("step"), F.greatest(k, F.col("salt")).alias("j")))
    above = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(tiles_of("next") - 1, F.lit(0))), lambda k: F.struct(F.col("band").alias("low"), F.col("salt").alias("i"), F.lit(1).alias("step"), k.alias("j")))
    below = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(tiles_of("prior") - 1, F.lit(0))), lambda k: F.struct((F.col("band") - 1).alias("low"), k.alias("i"), F.lit(1).alias("step"), F.col("salt").alias("j")))
    empty = F.filter(same, lambda x: F.lit(False))
    keys = F.concat(F.when(F.col("band_size") > 1, same).otherwise(empty), F.when(F.col("next") > 0, above).otherwise(empty), F.when(F.col("prior") > 0, below).otherwise(empty))
    dealt = members.withColumn("salt", salt).withColumn("tile", F.explode(keys))
    return dealt.select("component", "tile.*", "node", (F.col("band") * (1 << 20) + F.col("salt")).alias("side"), *held)


def _named(node: np.ndarray, pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([int(node[i]) for i, _ in pairs], pa.int64()), "b": pa.array([int(node[j]) for _, j in pairs], pa.int64())})


def _possible(members: DataFrame, similarity: Similarity) -> DataFrame:
    """Pairs (a, b) of nodes that connect all of a group that may link by size and mark."""

    def compare(table: pa.Table) -> pa.Table:
        node, side = np.asarray(table.column("node")), np.asarray(table.column("side"))
        two_sides = len(np.unique(side)) > 1
        return _named(node, tile_possible(np.asarray(table.column("n_shingles")), table.column("mark").to_pylist(), side if two_sides else None, similarity))

    return _tiles(members, "n_shingles", "mark").groupBy("component", "low", "i", "step", "j").applyInArrow(compare, "a long, b long")


def _in_groups(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The rows whose id is in a bitmap of the members' ids; others get in only where hashes meet."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_SLOTS))
    found = members.select(slot("id").alias("s")).groupBy(F.floor(F.col("s") / _ID_ROW).cast("int").alias("row")).agg(F.bitmap_construct_agg(F.col("s") % _ID_ROW).alias("bits"))
    bits = np.zeros((ID_SLOTS // _ID_ROW, _ID_ROW // 8), np.uint8)
    for row in found.collect():  # 4 MB at most
        bits[row["row"]] = np.frombuffer(row["bits"], np.uint8)
    held = rows.sparkSession.sparkContext.broadcast(bits.ravel())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.asarray(batch.column("s"))
            yield batch.select(["id", "text"]).filter(pa.array((held.value[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)))

    return rows.withColumn("s", slot("id")).mapInArrow(keep, "id long, text string")


def _verify(rows: DataFrame, members: DataFrame, similarity: Similarity, count: int, every: bool) -> DataFrame:
    """Verified links (a, b) between nodes of candidate groups: all, or enough to connect what links.

    members: id of one row of each node, node, component, band, and band_size, prior and
    next: sets of its band and of the two adjacent ones in the component.
    """
    joined = _in_groups(rows, members).repartition(count, "id").join(members.hint("shuffle_hash"), "id")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches, 1, SLICE):
            held = [s.tobytes() for s in _sets(batch, similarity)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(held, pa.binary())], names=[*batch.schema.names[2:], "shingles"])

    whole = joined.select("id", "text", "component", "node", "band", "band_size", "prior", "next")
    dealt = _tiles(whole.mapInArrow(arrays, "component long, node long, band long, band_size long, prior long, next long, shingles binary"), "shingles")

    def compare(table: pa.Table) -> pa.Table:
        node, side = np.asarray(table.column("node")), np.asarray(table.column("side"))
        sets = [np.frombuffer(b.as_py(), np.uint64) for b in table.column("shingles")]
        two_sides = len(np.unique(side)) > 1
        return _named(node, tile_links(sets, side if two_sides else None, similarity, every))

    return dealt.groupBy("component", "low", "i", "step", "j").applyInArrow(compare, "a long, b long")


def link_documents(docs: DataFrame, similarity: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """One row per input row: id, n_shingles (size of its set), component_id (smallest id reachable by links).

    With ``count_links`` n_links comes too, the number of other documents that a row links
    with. Without it sets that a tile has connected already are not compared again, so a
    group of near copies costs about as many comparisons as it has members; with it every
    pair of the group is compared.

    Words are runs of other than ASCII white space, A-Z lower-cased; a text of fewer words
    than a shingle has one, all its words; a null text or one without words has none and
    links with nothing. A null id links with nothing. Rows that share an id are one
    document to others. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch, count = Scratch(spark, "ngram-join"), partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sized, edges = _candidates(rows.where("id IS NOT NULL"), similarity, scratch, count)
    # one row for each node
    first = scratch.table(sized.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.max("n_shingles").alias("n_shingles"), F.max("mark").alias("mark")), "nodes")
    meet = components(_screened(edges, first, similarity), scratch)
    possible = scratch.table(_possible(_banded(first, meet, similarity, scratch), similarity), "possible")
    members = _banded(first.drop("mark"), components(possible, scratch), similarity, scratch).select("id", "component", "node", "band", "band_size", "prior", "next")
    links = scratch.table(_verify(rows, scratch.table(members, "dealt"), similarity, count, count_links), "links")
    found = components(links, scratch)
    named = scratch.table(first.join(found, "node").groupBy("component").agg(F.min("id").alias("component_id")), "named")
    of_node = scratch.table(first.join(found, "node", "left").join(named, "component", "left").select("node", F.coalesce("component_id", "id").alias("component_id")), "of-node")
    linked = sized.where("node IS NOT NULL").join(of_node, "node").select("id", "n_shingles", "component_id", "node")
    alone = sized.where("node IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"), "node")
    done = linked.union(alone)
    columns = ["id", "n_shingles", "component_id"]
    if count_links:
        copies = scratch.table(sized.where("node IS NOT NULL").groupBy("node").agg(F.count_distinct("id").alias("copies")), "copies")
        ends = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")
        others = ends.join(copies, ends["b"] == copies["node"]).groupBy("a").agg(F.sum("copies").alias("others"))
        numbers = copies.join(others, copies["node"] == others["a"], "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        done = done.join(numbers, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
        columns.append("n_links")
    done = done.select(*columns)
    if docs.schema[id_col].nullable:
        unnamed = _unnamed(rows.where("id IS NULL"), similarity)
        done = done.union(unnamed.withColumn("n_links", F.lit(0).cast("long")) if count_links else unnamed)
    return done.withColumnRenamed("id", id_col)


def _unnamed(rows: DataFrame, similarity: Similarity) -> DataFrame:
    """Rows without an id: they link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches, 1, SLICE):
            sizes = [len(s) for s in _sets(batch, similarity)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), batch.column(0)], names=["id", "n_shingles", "component_id"])

    return rows.mapInArrow(run, "id long, n_shingles long, component_id long")
