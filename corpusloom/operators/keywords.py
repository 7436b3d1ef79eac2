"""Keywords of groups and pages."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from heapq import heapify, heappop
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.plans.scratch import Scratch

# Words of markup that are no keywords.
NOISE = "div span class href http https www html css javascript nbsp amp quot src img style script".split()


#: Slots of the sketch of n-gram counts, slots of a row of it, characters of texts taken together, phrases a slice names, groups with a bound of their own.
SLOTS, ROW, SLICE, NAMED, BOUNDED = 1 << 20, 1 << 12, 1 << 20, 3, 100_000
_MARKS = frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] == "M")
_WORD, _WORD_AND_MARKS, _FAR = re.compile(r"\w{3,}"), re.compile(f"[\\w{''.join(sorted(_MARKS))}]{{3,}}"), re.compile("[̀-\U0010ffff]")


def words_of(text: str) -> list[str]:
    """Runs of more than two letters, marks, digits and underscores."""
    # the class with all marks is slow, and few texts have one
    marked = not text.isascii() and _FAR.search(text) is not None and not _MARKS.isdisjoint(text)
    return (_WORD_AND_MARKS if marked else _WORD).findall(text)


class _Slice:
    """The words of some lower-cased texts (letters, marks, digits and underscores, more than two), and their n-grams."""

    def __init__(self, texts: list[str], hashes: np.ndarray, groups: np.ndarray):
        found = [words_of(t or "") for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        coded = pc.dictionary_encode(pa.array([w for words in found for w in words], pa.large_string()))
        self.word, self.known = np.asarray(coded.indices, np.int64), coded.dictionary
        self.end = np.repeat(np.cumsum(counts), counts)
        self.group, self.start = np.repeat(groups, counts), np.repeat(hashes.view(np.uint64), counts)
        noise = np.asarray(pc.is_in(self.known, pa.array(NOISE, pa.large_string())), bool)
        self.noise = noise[self.word]
        self.bare = (noise | np.asarray(pc.is_in(self.known, pa.array(X.STOPWORDS, pa.large_string())), bool))[self.word]
        self.hash = pd.util.hash_array(self.known.to_numpy(zero_copy_only=False).astype(object), categorize=False)[self.word]

    def ngrams(self, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, at, code): where wanted n-grams begin, and a hash of group and phrase that is the same in every task."""
        code, noise, bare = self.start + self.hash, self.noise, self.bare
        for n in range(1, most + 1):
            if n > 1:
                # all begin at the same word, so each step takes one more word from the right
                code = code[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (code[:-1] >> np.uint64(29))
                code += self.hash[n - 1 :]
                noise, bare = noise[:-1] | self.noise[n - 1 :], bare[:-1] & self.bare[n - 1 :]
            if not len(code):
                return
            if n >= least:
                at = np.flatnonzero((np.arange(n, len(code) + n) <= self.end[: len(code)]) & ~noise & ~bare)
                mixed = code[at] * np.uint64(0xBF58476D1CE4E5B9)
                yield n, at, (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)

    def counted(self, n: int, at: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(group, phrase, count) of the distinct n-grams that begin at the places."""
        key = self.group[at]
        for k in range(n):
            # numbers of what was seen so far stay below the number of places
            _, key = np.unique(key * (len(self.known) + 1) + self.word[at + k], return_inverse=True)
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        parts = [self.known.take(pa.array(self.word[at[first] + k])) for k in range(n)]
        return self.group[at[first]], pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.string()), count


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Slice, pa.Array]]:
    """Slices of the columns g, h (a hash of g) and t, and the groups that their numbers stand for."""
    for batch in batches:
        names = pc.dictionary_encode(batch.column("g"), null_encoding="encode")
        groups, hashes = np.asarray(names.indices, np.int64), np.asarray(batch.column("h"), np.int64)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("t")), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            yield _Slice(batch.column("t").slice(at, to - at).to_pylist(), hashes[at:to], groups[at:to]), names.dictionary
            at = to


def group_keywords(rows: DataFrame, group: str, text: str, most: int = 20, least_words: int = 2, most_words: int = 4) -> DataFrame:
    """(group, phrase, n, rank): the most frequent n-grams of two to four words; ties by phrase.

    Texts are read twice. First all n-grams are counted in a sketch of ``SLOTS`` slots, a slot's
    count being no less than that of any phrase in it, while every slice names its most frequent
    phrases of each group: their counts summed are no more than the whole ones, so the last of a
    group's ``most`` is a bound that its keywords reach. Then phrases whose slot reaches the
    bound are counted as texts. No phrase that can be a keyword is left out; where counts are
    too flat, more phrases are counted. Rows without a group are a group of their own; a null
    text has no words.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "keywords")
    kind, shift = rows.schema[group].dataType.simpleString(), np.uint64(64 - (SLOTS - 1).bit_length())
    listed = rows.select(F.col(group).alias("g"), F.xxhash64(group).alias("h"), F.lower(F.col(text)).alias("t"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, np.int64)
        schema = None
        for part, names in _slices(batches):
            schema = pa.schema([("g", names.type), ("phrase", pa.string()), ("n", pa.int64()), ("place", pa.int32()), ("counts", pa.binary())])
            for n, at, code in part.ngrams(least_words, most_words):
                held += np.bincount((code >> shift).astype(np.int64), minlength=SLOTS)
                # places of the codes that are most frequent in their group
                value, count = np.unique(code, return_counts=True)
                several = count > 1
                value, count = value[several], count[several]
                if not len(value):
                    continue
                k = np.minimum(np.searchsorted(value, code), len(value) - 1)
                hit = np.flatnonzero(value[k] == code)
                own = np.zeros(len(value), np.int64)
                own[k[hit]] = part.group[at[hit]]
                order = np.lexsort((-count, own))
                first = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0])
                rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
                wanted = np.zeros(len(value), bool)
                wanted[order[rank < NAMED * most]] = True
                groups, phrases, counts = part.counted(n, at[hit[wanted[k[hit]]]])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(groups)), phrases, pa.array(counts, pa.int64()), pa.nulls(len(counts), pa.int32()), pa.nulls(len(counts), pa.binary())], schema=schema)
        if schema is not None:
            places = np.arange(SLOTS // ROW)
            counts = [c.tobytes() for c in held.reshape(-1, ROW)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(places), schema.field("g").type), pa.nulls(len(places), pa.string()), pa.nulls(len(places), pa.int64()), pa.array(places, pa.int32()), pa.array(counts, pa.binary())], schema=schema)

    seen = scratch.table(listed.mapInArrow(sketch, f"g {kind}, phrase string, n long, place int, counts binary"), "sketch")

    def summed(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROW, np.int64)
        for part in parts:
            for counts in part.column("counts"):
                total += np.frombuffer(counts.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["place", "counts"])

    slots = np.zeros((SLOTS // ROW, ROW), np.int64)
    for r in seen.where("place IS NOT NULL").select("place", "counts").groupBy("place").applyInArrow(summed, "place int, counts binary").collect():
        slots[r.place] = np.frombuffer(r.counts, np.int64)
    # of groups with equal hashes the lower bound
    named = seen.where("place IS NULL").groupBy("g", "phrase").agg(F.sum("n").alias("n"))
    last = named.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.col("n").desc()))).where(F.col("rank") <= most)
    bounds = last.groupBy("g").agg(F.when(F.count("*") == most, F.min("n")).otherwise(0).alias("n")).groupBy(F.xxhash64("g").alias("h")).agg(F.min("n").alias("n"))
    pairs = np.array([(r.h, r.n) for r in bounds.orderBy(F.col("n").desc()).limit(BOUNDED).collect()], np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0])]
    shared = spark.sparkContext.broadcast((slots.reshape(-1), pairs[:, 0].copy(), pairs[:, 1].copy()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, least = shared.value
        for part, names in _slices(batches):
            own = part.start.view(np.int64)
            bound = np.zeros(len(own), np.int64)
            if len(known):
                k = np.minimum(np.searchsorted(known, own), len(known) - 1)
                bound = np.where(known[k] == own, least[k], 0)
            for n, at, code in part.ngrams(least_words, most_words):
                at = at[held[(code >> shift).astype(np.int64)] >= bound[at]]
                if len(at):
                    groups, phrases, counts = part.counted(n, at)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(groups)), phrases, pa.array(counts, pa.int64())], names=["g", "phrase", "n"])

    counted = listed.mapInArrow(count, f"g {kind}, phrase string, n long").groupBy("g", "phrase").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("g").orderBy(F.col("n").desc(), "phrase")
    ranked = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select(F.col("g").alias(group), "phrase", "n", "rank")


def group_names(keywords: DataFrame, group: str) -> DataFrame:
    """(group, name): the first keyword in title case, else the group's number."""
    return keywords.where("rank = 1").select(group, F.initcap("phrase").alias("name"))


def yake(text: str, longest: int = 3, most: int = 16, stop: frozenset[str] = frozenset(X.STOPWORDS), similar: float = 0.7) -> list[tuple[str, float]]:
    """Keywords by the published single-document statistics: casing, position, frequency, relatedness and spread over sentences.

    Lower scores are better. A phrase too similar to a better one is left out.
    """
    sentences = [re.findall(r"[^\W_][\w'’-]*", s) for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]
    sentences = [s for s in sentences if s]
    if not sentences:
        return []
    written = Counter(chain.from_iterable(sentences))
    begun = Counter(s[0] for s in sentences)
    lower = {w: w.lower() for w in written}
    lowered = [[lower[w] for w in s] for s in sentences]
    count = Counter(chain.from_iterable(lowered))
    upper: Counter[str] = Counter()
    capital: Counter[str] = Counter()
    for word, n in written.items():
        if word[0].isupper():
            capital[lower[word]] += n - begun[word]
        if word.isupper() and len(word) > 1:
            upper[lower[word]] += n
    places: dict[str, list[int]] = {w: [] for w in count}
    for k, sentence in enumerate(lowered):
        for w in sentence:
            places[w].append(k)
    grams = [Counter(chain.from_iterable(zip(*(s[i:] for i in range(n)), strict=False) for s in lowered)) for n in range(2, max(longest, 2) + 1)]
    # words with a neighbour on the left and right, and how many different ones
    first, last = Counter(s[0] for s in lowered), Counter(s[-1] for s in lowered)
    left, right = Counter(b for _, b in grams[0]), Counter(a for a, _ in grams[0])
    content = [n for w, n in count.items() if w not in stop] or [1]
    mean = sum(content) / len(content)
    spread = math.sqrt(sum((n - mean) ** 2 for n in content) / len(content))
    highest = max(count.values())
    score: dict[str, float] = {}
    # a word that comes once has the score of its like in the same sentence
    once: dict[tuple, float] = {}
    for w, n in count.items():
        cased = max(upper.get(w, 0), capital.get(w, 0))
        like = (places[w][0], cased, w in first, w in last) if n == 1 else None
        if like in once:
            score[w] = once[like]
            continue
        case = cased / (1 + math.log(n))
        middle = places[w][len(places[w]) // 2]
        position = math.log(math.log(3 + middle) + 1e-12)
        frequency = n / (mean + spread)
        spans = [side[w] / (n - edge[w]) for side, edge in ((left, first), (right, last)) if n > edge[w]]
        related = 1 + sum(spans) * n / highest
        sentence_share = len(set(places[w])) / len(sentences)
        score[w] = related * position / (case + frequency / related + sentence_share / related)
        if like is not None:
            once[like] = score[w]
    digits = {w for w in count if w.isdigit()}
    ends = count.keys() - stop - digits
    # a space comes before all that words are made of, so tuples of words have the order of phrases
    ranked = [(score[w] / (count[w] * (1 + score[w])), (w,)) for w in ends] if longest > 0 else []
    if longest > 1:
        ranked += [((x := score[a]) * (y := score[b]) / (n * (1 + (x + y))), (a, b)) for (a, b), n in grams[0].items() if a in ends and b in ends]
    for found in grams[1 : max(longest - 1, 1)]:
        for gram, n in found.items():
            if gram[0] in ends and gram[-1] in ends and digits.isdisjoint(gram):
                values = [score[w] for w in gram if w not in stop]
                ranked.append((math.prod(values) / (n * (1 + sum(values))), gram))
    heapify(ranked)
    out: list[tuple[str, float]] = []
    taken: list[tuple[str, Counter[str], SequenceMatcher]] = []
    while ranked and (len(out) < most or not out):
        value, words = heappop(ranked)
        gram = " ".join(words)
        if not any(_alike(gram, *other, similar) for other in taken):
            out.append((gram, value))
            taken.append((gram, Counter(gram), SequenceMatcher(None, "", gram)))
    return out


def _alike(gram: str, other: str, letters: Counter[str], matcher: SequenceMatcher, similar: float) -> bool:
    """Whether the ratio of the matcher is above ``similar``; it is only taken where bounds leave it open."""
    both, least = len(gram) + len(other), min(len(gram), len(other))
    if 2.0 * least / both <= similar:
        return False
    if len(other) < 200 and (other in gram or gram in other):
        return True
    if 2.0 * sum([min(gram.count(c), n) for c, n in letters.items()]) / both <= similar:
        return False
    matcher.set_seq1(gram)
    return matcher.ratio() > similar


def page_keywords(title: Column, description: Column, body: Column, most: int = 8) -> Column:
    """Cleaned keywords of a page, from its title (twice), description and headings."""
    heads = F.array_join(X.headers(body), " ")
    whole = F.concat_ws(". ", F.nullif(title, F.lit("")), F.nullif(title, F.lit("")), F.nullif(description, F.lit("")), F.nullif(heads, F.lit("")))

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[g for g, _ in yake(t, most=2 * most)] if t and len(t) >= 10 else [] for t in texts])

    return X.clean_keywords(run(whole), most)
