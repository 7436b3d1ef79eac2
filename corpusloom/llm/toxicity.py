"""Toxicity of texts: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased, white space becomes single spaces, and all n-grams of three to six
characters are hashed into a fixed number of slots; a feature is the presence of a slot.
Fitting uses a bounded sample of labelled rows: counts per class give each slot its
log-count ratio, the slots that separate the classes best are kept, and a logistic
regression over the kept slots, each scaled by its ratio, is trained. The model is two
arrays of fixed size, so scoring is a map over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.wordhash import give_back, start_afresh
from corpusloom.plans.scratch import Scratch

#: Bound of the fitting sample: rows of each label, the first by hash of the id.
SAMPLE_ROWS = {1: 6_000, 0: 10_000}
SLOT_BITS = 20
SHORTEST, LONGEST = 3, 6
KEPT_SLOTS = 20_000
STEPS = 300
RATE = 0.5
PENALTY = 1e-3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FINISH = np.uint64(0xBF58476D1CE4E5B9)
#: Characters that are hashed together; n-grams over the border of two stretches are in the next one.
STRETCH = 1 << 18


def _hashed(text: str | None) -> Iterator[np.ndarray]:
    """Slots of a text's n-grams, with repetitions, some at a time."""
    text = " " + " ".join((text or "").lower().split()) + " "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for at in range(0, len(codes), STRETCH):
        part = codes[max(0, at - LONGEST + 1) : at + STRETCH]
        h = part + np.uint64(1)
        for n in range(2, LONGEST + 1):
            if len(part) < n:
                break
            h = h[:-1] * _BASE + part[n - 1 :]
            if n >= SHORTEST:
                yield ((h ^ (h >> np.uint64(29))) * _FINISH) >> np.uint64(64 - SLOT_BITS)


def slots(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct slots of a text's n-grams, of those for which ``wanted`` is true if given."""
    found = [np.unique(h if wanted is None else h[wanted[h]]) for h in _hashed(text)]
    return np.unique(np.concatenate([*found, np.zeros(0, np.uint64)])).astype(np.int64)


@dataclass
class Model:
    """Weight of each slot (regression weight times log-count ratio) and the intercept."""

    weights: np.ndarray
    intercept: float

    def __post_init__(self):
        self.used = self.weights != 0

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights[slots(text, self.used)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def log_count_ratios(present: np.ndarray, n_present: int, absent: np.ndarray, n_absent: int) -> np.ndarray:
    """Log of the smoothed share of toxic rows with the slot over that of other rows."""
    return np.log((present + 1) / (n_present + 2)) - np.log((absent + 1) / (n_absent + 2))


def fit_regression(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the intercept, by gradient descent with momentum; classes weigh the same.

    rows: kept slots of each row, counted from 0; the list is used up, so that features are
    in memory once.
    """
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    parts = []
    for at in range(0, len(rows), 1000):
        own = rows[at : at + 1000]
        parts.append((np.concatenate(own).astype(np.uint16 if len(scale) <= 1 << 16 else np.int32), np.array([len(r) for r in own]), slice(at, at + len(own))))
        rows[at : at + 1000] = [None] * len(own)
    w, b = np.zeros(len(scale)), 0.0
    dw, db = np.zeros(len(scale)), 0.0
    for _ in range(STEPS):
        gw, gb = PENALTY * w, 0.0
        for index, lengths, span in parts:
            sums = np.concatenate([[0.0], np.cumsum((scale * w)[index])])
            ends = np.cumsum(lengths)
            z = sums[ends] - sums[ends - lengths] + b
            error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels[span]) * share[span]
            gw += scale * np.bincount(index, np.repeat(error, lengths), len(scale))
            gb += error.sum()
        dw, db = 0.9 * dw - RATE * gw, 0.9 * db - RATE * gb
        w, b = w + dw, b + db
    return w, b


def held_out(doc_id) -> F.Column:
    """Rows that labels are never learned from: crc32 of the id as text is a multiple of five."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, label) of at most SAMPLE_ROWS rows of each label outside of the held-out fold, one an id: of repeated ids the least text."""
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("label")).where("__id IS NOT NULL AND label IN (0, 1)")
    known = known.where(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("label").alias("label"))
    picked = None
    for value, bound in SAMPLE_ROWS.items():
        some = known.where(F.col("label") == value).orderBy(F.xxhash64("__id"), "__id").limit(bound)
        picked = some if picked is None else picked.union(some)
    # at most sum(SAMPLE_ROWS) ids and labels
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "__id")
    return texts.groupBy("__id", "label").agg(F.min("text").alias("text")).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled rows; without rows of both labels it scores 0 everywhere.

    Labels that are null or neither 0 nor 1 are no labels; of repeated labels of an id the
    larger counts, and of repeated documents of an id the least text; a null text counts as
    empty.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.table(sample(docs, labels, id_col, text_col, label_col).repartition(24), "sample")
    size = 1 << SLOT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_afresh()
        counts, n = np.zeros((2, size), np.int32), [0, 0]
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[label, slots(text.as_py())] += 1
                n[label] += 1
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(n[:1], pa.int64()), pa.array(n[1:], pa.int64()), pa.array([zstandard.ZstdCompressor(level=1).compress(counts.astype("<i4").tobytes())], pa.binary())], names=["n0", "n1", "counts"])

    total, n = np.zeros((2, size), np.int64), [0, 0]
    # written by all tasks side by side, then read one partition of at most 8 MB at a time
    counted = scratch.table(rows.mapInArrow(count, "n0 long, n1 long, counts binary"), "counts")
    for part in counted.toLocalIterator():
        total += np.frombuffer(zstandard.ZstdDecompressor().decompress(part.counts), "<i4").reshape(2, size)
        n[0], n[1] = n[0] + part.n0, n[1] + part.n1
    if not all(n):
        return Model(np.zeros(size), -500.0)
    ratios = log_count_ratios(total[1], n[1], total[0], n[0])
    # how many times its standard error a slot's ratio is
    spread = np.sqrt(1 / (total[1] + 1) + 1 / (total[0] + 1))
    kept = np.sort(np.argsort(-np.abs(ratios) / spread, kind="stable")[:KEPT_SLOTS])
    wanted = np.zeros(size, bool)
    wanted[kept] = True
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            found = [slots(text.as_py(), wanted).astype("<u4").tobytes() for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], names=["label", "features"])

    ys, xs = [], []
    featured = scratch.table(rows.mapInArrow(features, "label int, features binary"), "features")
    for part in featured.toLocalIterator():
        ys.append(part.label)
        xs.append(np.searchsorted(kept, np.frombuffer(part.features, "<u4")).astype(np.uint16 if len(kept) <= 1 << 16 else np.int32))
    scratch.drop(rows, counted, featured)
    w, b = fit_regression(xs, np.array(ys), ratios[kept])
    shared.unpersist()
    # the driver lives on after the fit
    give_back()
    weights = np.zeros(size, np.float32)
    weights[kept] = w * ratios[kept]
    return Model(weights, b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per input row: id, held_out, score in [0, 1], predicted (1 where score >= 0.5), and the columns in ``keep``.

    The text alone makes the score; a null text counts as empty, and an empty one scores by
    the intercept. Repeated rows score alike; a null id is in the fold that its empty text
    falls in; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or []
    types = dict(docs.dtypes)
    carried = [c for c in keep if c not in (id_col, text_col)]
    names = {c: f"__c{i}" for i, c in enumerate(carried)} | {text_col: "__text"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_afresh()
        for batch in batches:
            scores = [shared.value.score(text.as_py()) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(scores, pa.float64()), *batch.columns], names=["score", *batch.schema.names])

    rows = docs.select(F.col(text_col).alias("__text"), F.col(id_col).cast("long").alias("__id"), *[F.col(c).alias(names[c]) for c in carried])
    done = rows.mapInArrow(run, ", ".join(["score double, __text string, __id long", *[f"{names[c]} {types[c]}" for c in carried]]))
    return done.select(
        F.col("__id").alias(id_col),
        held_out(F.col("__id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        *[F.col(names[c]).alias(c) for c in keep if c != id_col],
    )
