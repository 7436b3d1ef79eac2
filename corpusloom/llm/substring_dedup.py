"""Removal of long repeated passages.

Every window of a fixed number of words gets a Rabin-Karp hash. Tasks reduce the windows
of a slice of documents to one entry per distinct hash (that of the smallest document),
sorted, and send each hash range, packed, to the partition that counts it; what a slice
itself already shows to be repeated needs no counting. Spark deals and sorts the ranges;
a partition takes its share range by range, so that no more than one is unpacked at a
time, finds for each hash the smallest document that has it and tells every other one.
Each document then merges its repeated windows into maximal intervals and drops the words
under them. (Counting by groupBy on rows of single windows would shuffle 16 bytes of
random digits for each of them, more than four times the input.)

Hashes have 64 bits: among n windows about n*n / 2**65 pairs of different windows meet.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.scratch import Scratch, partitions
from corpusloom.llm.wordhash import by_part, fine_parts, give_back, pack, pieces, start_afresh, text_bytes, together, unpack, windows, word_hashes

#: Bytes of text that are reduced together before anything is sent.
SLICE = 4 << 20
#: Marks that a task holds before it sends them, and buckets of documents a task that marks are read for one at a time.
HELD_MARKS, MARK_BUCKETS = 2 << 20, 4

_NO_ID = np.int64(2**63 - 1)


def _ids(column: pa.Array) -> np.ndarray:
    """Ids as 64-bit integers; null is the largest."""
    return np.asarray(column.fill_null(int(_NO_ID)))


def _ranges(hashes: np.ndarray, count: int) -> np.ndarray:
    """Where each of ``count`` equal hash ranges begins in the sorted hashes."""
    edges = np.array([(k << 64) // count for k in range(count)], np.uint64)
    return np.append(np.searchsorted(hashes, edges), len(hashes))


def _split_owner(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in order of (hash, document) without repetitions, and which of them have a smaller document at their hash."""
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    order = order[fresh]
    hashes = hashes[fresh]
    later = np.zeros(len(hashes), bool)
    later[1:] = hashes[1:] == hashes[:-1]
    return order, later


def _bucket(docs: np.ndarray, count: int) -> np.ndarray:
    """Bucket of each document; _bucket_of gives the same in SQL."""
    unique, inverse = np.unique(docs, return_inverse=True)
    return np.array([zlib.crc32(str(d).encode()) % count for d in unique.tolist()], np.int64)[inverse]


def _bucket_of(doc: F.Column, count: int) -> F.Column:
    return (F.crc32(doc.cast("string").cast("binary")) % count).cast("int")


def _told(docs: np.ndarray, hashes: np.ndarray, count: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed documents and hashes) for each bucket of documents."""
    buckets = _bucket(docs, count)
    order = np.lexsort((hashes, docs, buckets))
    buckets, docs, hashes = buckets[order], docs[order], hashes[order]
    edges = np.searchsorted(buckets, np.arange(count + 1))
    for k in np.unique(buckets).tolist():
        own = slice(edges[k], edges[k + 1])
        yield k, pack(docs[own].view(np.uint64), hashes[own])


def repeated_windows(docs: DataFrame, window: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(bucket, marks): packed pairs of a document and the hash of one of its windows that also starts in a document with a smaller id."""
    spark = docs.sparkSession
    count = partitions(spark)
    fine = fine_parts(count)
    ranges = count * fine

    def reduce_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_afresh()
        for batch in together(batches, 1, SLICE):
            data, offsets = text_bytes(batch.column(1))
            hashes, word_offsets, _, _ = word_hashes(data, offsets)
            found, _, texts = windows(hashes, word_offsets, window)
            if not len(found):
                continue
            owner = _ids(batch.column(0))[texts]
            order, later = _split_owner(found, owner)
            found, owner = found[order], owner[order]
            parts, told, blobs = [], [], []
            for bucket, blob in _told(owner[later], found[later], count * MARK_BUCKETS):
                parts.append(bucket // MARK_BUCKETS * fine)
                told.append(True)
                blobs.append(blob)
            found, owner = found[~later], owner[~later]
            edges = _ranges(found, ranges)
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[k], edges[k + 1])
                parts.append(k)
                told.append(False)
                blobs.append(pack(found[own], owner[own].view(np.uint64)))
            del found, owner, order, later, hashes, texts
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(told, pa.bool_()), pa.array(blobs, pa.binary())], names=["part", "told", "blob"])
        give_back()

    def count_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # marks of many ranges go on together, so a task has a row a bucket and not one a range and bucket
        docs_held, hashes_held, held = [], [], 0

        def flush() -> pa.RecordBatch:
            marks = list(_told(np.concatenate(docs_held), np.concatenate(hashes_held), count * MARK_BUCKETS))
            docs_held.clear()
            hashes_held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in marks], pa.int32()), pa.array([b for _, b in marks], pa.binary())], names=["bucket", "marks"])

        for _, rows in by_part(batches):
            told = rows.filter(rows.column("told"))
            for blob in told.column("blob"):
                some, hashes_of = unpack(blob.as_py(), 2)
                docs_held.append(some.view(np.int64))
                hashes_held.append(hashes_of)
                held += len(some)
            hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for blob in rows.filter(pc.invert(rows.column("told"))).column("blob"):
                some, docs_of = unpack(blob.as_py(), 2)
                hashes.append(some)
                owner.append(docs_of.view(np.int64))
            hashes, owner = np.concatenate(hashes), np.concatenate(owner)
            order, later = _split_owner(hashes, owner)
            order = order[later]
            docs_held.append(owner[order])
            hashes_held.append(hashes[order])
            held += len(order)
            if held >= HELD_MARKS:
                yield flush()
                held = 0
        if held:
            yield flush()
        give_back()

    sliced = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(reduce_slices, "part int, told boolean, blob binary")
    dealt = sliced.repartitionById(count, F.floor(F.col("part") / fine).cast("int")).sortWithinPartitions("part")
    return scratch.table(dealt.mapInArrow(count_ranges, "bucket int, marks binary"), "marks")


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per input row: id, n_words, n_removed, kept_sha256, and kept_text.

    kept_sha256 is of the kept words joined by one space; kept_text is that text where
    something went, and the input's text as it is where nothing did.

    A word goes if a window of ``window`` words over it also starts in a document with a
    smaller id. Windows are judged on the input. ``keep`` names columns of the input to
    carry along. A null text has no words; texts below the window lose nothing; a null id
    counts as larger than all others; rows that share an id are one document, so they are
    no reason to remove from each other, and each row is judged by its own words. An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    count = partitions(docs.sparkSession)
    marks = repeated_windows(docs, window, id_col, text_col, scratch)
    keep = keep or []
    types = dict(docs.dtypes)
    names = [f"__c{i}" for i in range(len(keep))]
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(int(_NO_ID)))
    rows = docs.select(_bucket_of(key, count * MARK_BUCKETS).alias("__bucket"), F.lit(None).cast("binary").alias("__marks"), F.col(id_col).cast("long").alias("__own"), F.col(text_col).alias("__text"), *[F.col(c).alias(n) for n, c in zip(names, keep, strict=True)])
    told = marks.select(F.col("bucket").alias("__bucket"), F.col("marks").alias("__marks"), *[F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in rows.columns[2:]])
    # a bucket's marks come before its documents, and one bucket comes after the other
    dealt = told.union(rows).repartitionById(count, F.floor(F.col("__bucket") / MARK_BUCKETS).cast("int")).sortWithinPartitions("__bucket", F.col("__marks").isNull())
    schema = ", ".join(["__own long", "n_words long", "n_removed long", "kept_sha256 string", "kept_text string", *[f"{n} {types[c]}" for n, c in zip(names, keep, strict=True)]])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, told = None, []
        marked_docs, marked = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            of = np.asarray(batch.column("__bucket"))
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows = batch.slice(a, b - a)
                if not rows.num_rows:
                    continue
                if of[a] != bucket:
                    bucket, told, marked_docs, marked = of[a], [], marked_docs[:0], marked[:0]
                is_doc = rows.column("__marks").is_null()
                told += [unpack(blob.as_py(), 2) for blob in rows.filter(pc.invert(is_doc)).column("__marks")]
                rows = rows.filter(is_doc)
                if rows.num_rows and told:
                    marked_docs = np.concatenate([d.view(np.int64) for d, _ in told])
                    order = np.argsort(marked_docs, kind="stable")
                    marked_docs, marked, told = marked_docs[order], np.concatenate([h for _, h in told])[order], []
                for some in pieces(iter([rows]), 3, SLICE):
                    yield judge(some, marked_docs, marked)
        give_back()

    def judge(batch: pa.RecordBatch, marked_docs: np.ndarray, marked: np.ndarray) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column("__text"))
        hashes, word_offsets, _, _ = word_hashes(data, offsets)
        found, starts, texts = windows(hashes, word_offsets, window)
        edges = np.searchsorted(texts, np.arange(batch.num_rows + 1))
        n_words = np.diff(word_offsets)
        ids = _ids(batch.column("__own"))
        lows, highs = np.searchsorted(marked_docs, ids, "left"), np.searchsorted(marked_docs, ids, "right")
        null = batch.column("__text").is_null().to_pylist()
        removed, digests, kept_texts = [], [], []
        for row in range(batch.num_rows):
            a, b = int(word_offsets[row]), int(word_offsets[row + 1])
            gone = np.zeros(b - a, bool)
            own = slice(edges[row], edges[row + 1])
            if lows[row] < highs[row] and own.stop > own.start:
                hit = starts[own][np.isin(found[own], marked[lows[row] : highs[row]])] - a
                # maximal intervals: +1 where a repeated window starts, -1 after it ends
                steps = np.zeros(b - a + 1, np.int32)
                np.add.at(steps, hit, 1)
                np.add.at(steps, hit + window, -1)
                gone = np.cumsum(steps[:-1]) > 0
            raw = data[offsets[row] : offsets[row + 1]].tobytes()
            words = raw.split()
            left = np.flatnonzero(~gone)
            text = b" ".join(words if len(left) == b - a else [words[i] for i in left.tolist()])
            removed.append(b - a - len(left))
            digests.append(hashlib.sha256(text).hexdigest())
            kept_texts.append(text.decode() if len(left) < b - a else None if null[row] else raw.decode())
        return pa.RecordBatch.from_arrays(
            [batch.column("__own"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string()), *[batch.column(n) for n in names]],
            names=["__own", "n_words", "n_removed", "kept_sha256", "kept_text", *names],
        )

    done = dealt.select("__bucket", "__marks", "__own", "__text", *names).mapInArrow(apply, schema)
    return done.select(F.col("__own").alias(id_col), "n_words", "n_removed", "kept_sha256", "kept_text", *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True) if c != id_col])
