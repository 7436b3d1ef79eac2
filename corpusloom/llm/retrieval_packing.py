"""Packing by lexical retrieval: a window holds a document and those most like it by BM25.

Documents are tokenized once. Token ids are the terms: their document frequencies over the
whole corpus are a table no longer than the vocabulary. Documents are ordered by weighted
MinHashes of their terms, so that like ones are near, and consecutive ones form shards of
bounded size; a task works on one shard at a time. A shard's inverted index returns the
unused neighbours of a seed, best first, which fill its window; the one that no longer
fits is cut, and its rest is the next seed. What a task's last window lacks is made up in
further rounds over the unfilled windows of all tasks; the last one is cut at powers of two.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.slices import spans_of
from corpusloom.llm.word_bpe import word_model
from corpusloom.llm.wordhash import give_back, mix, together
from corpusloom.plans.scratch import Scratch, partitions

#: Tokens of a shard, whose index is in memory; a document's whole windows don't count.
SHARD_TOKENS = 1 << 19
K1, B = 1.2, 0.75
#: MinHashes in a row that order the documents.
HASHES = 4
#: Rows a task from which the borders of their ranges come.
SAMPLED = 20

_PLACED = "key long, row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, blob binary"


def _pack(ids: np.ndarray) -> bytes:
    import zstandard

    small = len(ids) == 0 or int(ids.max()) < 1 << 16
    return (b"2" if small else b"4") + zstandard.ZstdCompressor(level=1).compress(ids.astype("<u2" if small else "<u4").tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), "<u" + blob[:1].decode()).astype("<u4")


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc_tokens, blob): ids of each text and its end id, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_model(tokenizer_path)
        end = np.array([end_id], "<u4")
        for batch in together(batches, 1, 2 << 20):
            ids, offsets = model.encode(batch.column(1))
            blobs = [_pack(np.concatenate([ids[a:b], end])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets) + 1, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "doc_tokens", "blob"])
        give_back()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, doc_tokens long, blob binary")


def document_frequencies(tokens: DataFrame) -> DataFrame:
    """(term, docs): in how many documents each token id is; each task sends its counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for blob in batch.column("blob"):
                terms = np.unique(_unpack(blob.as_py()))
                if int(terms[-1]) >= len(counts):
                    counts = np.concatenate([counts, np.zeros(int(terms[-1]) + 1, np.int64)])
                counts[terms] += 1
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found])], names=["term", "docs"])

    return tokens.select("blob").mapInArrow(run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def weights(frequencies: np.ndarray, documents: int) -> np.ndarray:
    """Robertson and Sparck Jones' weight of each term; terms of more than half of the documents have none."""
    return np.maximum(np.log((documents - frequencies + 0.5) / (frequencies + 0.5)), 0)


def _order_table(idf: np.ndarray) -> np.ndarray:
    """Per hash and term a draw of an exponential with the term's weight as rate: the least of a set is a weighted MinHash."""
    at = np.arange(HASHES * len(idf), dtype=np.uint64)
    uniform = (mix(at + np.uint64(1)).astype(np.float64) + 1) / 2.0**64
    with np.errstate(divide="ignore"):
        return -np.log(np.minimum(uniform, 1 - 2.0**-53)).reshape(HASHES, -1) / np.where(idf > 0, idf, 0)


def _order_key(terms: np.ndarray, table: np.ndarray) -> int:
    key = 0
    for row in table[:, terms]:
        k = int(row.argmin())
        key = key << 15 | (int(terms[k]) & 0x7FFF if np.isfinite(row[k]) else 0x7FFF)
    return key


def ordered(tokens: DataFrame, idf: np.ndarray, parts: int) -> DataFrame:
    """The rows with key, concatenated MinHashes of their terms, dealt by ranges of it into ``parts`` tasks and sorted there.

    The ranges' borders come from about SAMPLED rows a task; rows of equal keys go by their
    number, so copies are dealt like others. A range sort would make every key twice.
    """
    kind = "part int, key long, row long, doc_id long, start long, doc_tokens long, blob binary"

    def keyed(borders: list[tuple[int, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = _order_table(idf)
            for batch in batches:
                keys = [_order_key(np.unique(_unpack(b.as_py())), table) for b in batch.column("blob")]
                part = [bisect_right(borders, at) for at in zip(keys, batch.column("row").to_pylist(), strict=True)]
                start = pa.array(np.zeros(batch.num_rows, np.int64))
                columns = [pa.array(part, pa.int32()), pa.array(keys, pa.int64()), batch.column("row"), batch.column("doc_id"), start, batch.column("doc_tokens"), batch.column("blob")]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "key", "row", "doc_id", "start", "doc_tokens", "blob"])

        return run

    rows = tokens.select("row", "doc_id", "doc_tokens", "blob")
    borders: list[tuple[int, int]] = []
    if parts > 1:
        every = max(1, tokens.count() // (SAMPLED * parts))
        some = rows.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).mapInArrow(keyed([]), kind).select("key", "row")
        held = sorted(map(tuple, some.collect()))  # as many as a range sort takes
        borders = [held[len(held) * k // parts] for k in range(1, parts)] if held else []
    dealt = rows.mapInArrow(keyed(borders), kind)
    return (dealt.repartitionById(parts, "part") if parts > 1 else dealt.coalesce(1)).sortWithinPartitions("key", "row", "start")


class Index:
    """Inverted index of a shard with BM25 weights."""

    def __init__(self, items: list[np.ndarray], idf: np.ndarray, mean: float):
        lengths = np.array([len(i) for i in items], np.int64)
        self.n, vocabulary = len(items), len(idf)
        of = np.repeat(np.arange(len(items)), lengths)
        pairs, tf = np.unique(of * vocabulary + np.concatenate(items), return_counts=True)
        doc, term = pairs // vocabulary, pairs % vocabulary
        told = idf[term] > 0
        doc, term, tf = doc[told], term[told], tf[told]
        norm = K1 * (1 - B + B * lengths[doc] / mean)
        weight = idf[term] * tf * (K1 + 1) / (tf + norm)
        self.terms, self.of_doc = term, np.searchsorted(doc, np.arange(self.n + 1))
        by_term = np.argsort(term, kind="stable")
        self.docs, self.weight = doc[by_term], weight[by_term]
        ordered = term[by_term]
        self.starts = np.searchsorted(ordered, np.arange(vocabulary))
        self.counts = np.searchsorted(ordered, np.arange(vocabulary), "right") - self.starts

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all items for the terms of one, each once."""
        terms = self.terms[self.of_doc[seed] : self.of_doc[seed + 1]]
        at = spans_of(self.counts[terms], self.starts[terms])
        return np.bincount(self.docs[at], self.weight[at], self.n)


Window = list[tuple[int, int, int]]


def fill(items: list[np.ndarray], idf: np.ndarray, mean: float, capacity: int) -> list[Window]:
    """Windows of (item, from, to); all but the last are full.

    The seed is the rest of the item cut last, else the first unused one. Its unused
    neighbours follow by falling score, ties in the items' order; those without a common
    term come last, in their order.
    """
    index = Index(items, idf, mean)
    unused = np.ones(len(items), bool)
    out: list[Window] = []
    first, rest = 0, None
    while True:
        if rest is None:
            while first < len(items) and not unused[first]:
                first += 1
            if first == len(items):
                return out
            rest = first, 0, len(items[first])
            unused[first] = False
        window = [rest]
        free = capacity - (rest[2] - rest[1])
        seed, rest = rest[0], None
        if free > 0:
            scores = np.where(unused, np.round(index.scores(seed), 9), -1)
            for k in np.argsort(-scores, kind="stable").tolist():
                if scores[k] < 0 or not free:
                    break
                size = len(items[k])
                took = min(size, free)
                window.append((k, 0, took))
                unused[k] = False
                free -= took
                if took < size:
                    rest = k, took, size
        out.append(window)


def cut_window(window: Window) -> list[Window]:
    """An unfilled window as windows whose lengths are powers of two, the longest first."""
    total = sum(b - a for _, a, b in window)
    out: list[Window] = []
    todo = list(window)
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            free, part = 1 << bit, []
            while free:
                k, a, b = todo.pop(0)
                took = min(free, b - a)
                part.append((k, a, a + took))
                free -= took
                if a + took < b:
                    todo.insert(0, (k, a + took, b))
            out.append(part)
    return out


@dataclass
class _Shard:
    keys: list[int] = field(default_factory=list)
    rows: list[tuple[int, int | None, int, int]] = field(default_factory=list)
    ids: list[np.ndarray] = field(default_factory=list)
    tokens: int = 0

    def add(self, key: int, row: int, doc: int | None, start: int, doc_tokens: int, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.rows.append((row, doc, start, doc_tokens))
        self.ids.append(ids)
        self.tokens += len(ids)


def _packed(rows: DataFrame, idf: np.ndarray, mean: float, capacity: int, level: int, last: bool) -> DataFrame:
    """Pieces of full windows, and without a sequence those of each task's unfilled one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = (level << 58) + (TaskContext.get().partitionId() << 34)
        out: list[tuple] = []

        def put(window: list[tuple], number: int | None) -> None:
            at = 0
            for key, (row, doc, start, whole), ids in window:
                blob = None if number is not None else _pack(ids)
                out.append((key, row, doc, start, len(ids), zlib.crc32(ids.tobytes()), whole, number, at if number is not None else None, blob))
                at += len(ids)

        def flush(shard: _Shard, end: bool) -> _Shard:
            """Packs the shard; the unfilled window's pieces go into the next one, or out at the end."""
            nonlocal sequence
            carried = _Shard()
            for window in fill(shard.ids, idf, mean, capacity) if shard.ids else []:
                full = sum(b - a for _, a, b in window) == capacity
                for part in [window] if full or not (end and last) else cut_window(window):
                    pieces = []
                    for k, a, b in part:
                        row, doc, start, whole = shard.rows[k]
                        pieces.append((shard.keys[k], (row, doc, start + a, whole), shard.ids[k][a:b]))
                    if full or end:
                        done = full or last
                        put(pieces, sequence if done else None)
                        sequence += done
                    else:
                        for key, of, ids in pieces:
                            carried.add(key, *of, ids)
            return carried

        def sent() -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64()] * 9 + [pa.binary()]
            names = [c.split()[0] for c in _PLACED.split(", ")]
            for at in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 10_000], strict=True), kinds, strict=True)], names=names)
            out.clear()

        shard = _Shard()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "row", "doc_id", "start", "doc_tokens")]
            for k, blob in enumerate(batch.column("blob")):
                key, row, doc, start, whole = (c[k] for c in columns)
                ids = _unpack(blob.as_py())
                for a in range(0, len(ids) - capacity + 1, capacity):
                    put([(key, (row, doc, start + a, whole), ids[a : a + capacity])], sequence)
                    sequence += 1
                short = len(ids) % capacity
                if short:
                    shard.add(key, row, doc, start + len(ids) - short, whole, ids[len(ids) - short :].copy())
                if shard.tokens >= SHARD_TOKENS:
                    shard = flush(shard, False)
                    yield from sent()
        flush(shard, True)
        yield from sent()
        give_back()

    return rows.mapInArrow(run, _PLACED)


def pack_by_retrieval(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    All sequences are full, but for a handful with lengths of powers of two, which need no
    padding either. A null text counts as empty: the end id alone. Null ids are kept;
    repeated rows are packed each for itself; ties of score go by the documents' order;
    other columns are ignored, whatever their names; an empty table gives no rows. The
    driver learns the vocabulary's document frequencies and two totals.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "retrieval-packing")
    tokens = scratch.table(tokenized(docs, tokenizer_path, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "tokens")
    n, total = tokens.agg(F.count("*"), F.sum("doc_tokens")).first()
    found = document_frequencies(tokens).toPandas()  # one row a token id of the vocabulary at most
    frequencies = np.zeros(int(found["term"].max()) + 1 if len(found) else 1, np.int64)
    frequencies[found["term"].to_numpy(np.int64)] = found["docs"].to_numpy(np.int64)
    idf, mean = weights(frequencies, n), (total or 0) / max(n, 1)
    parts = max(1, min(partitions(spark), math.ceil((total or 0) / SHARD_TOKENS)))
    dealt = ordered(tokens, idf, parts)
    done: DataFrame | None = None
    level = 0
    while True:
        placed = scratch.table(_packed(dealt, idf, mean, capacity, level, parts == 1), "placed")
        full = placed.where("sequence_id IS NOT NULL")
        done = full if done is None else done.unionByName(full)
        if parts == 1:
            break
        # a task leaves less than a window
        rows = placed.where("sequence_id IS NULL").select("key", "row", "doc_id", "start", "doc_tokens", "blob")
        parts, level = math.ceil(parts * capacity / (4 * SHARD_TOKENS)), level + 1
        dealt = (rows.repartitionByRange(parts, "key", "row", "start") if parts > 1 else rows.coalesce(1)).sortWithinPartitions("key", "row", "start")
    return done.select(F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
