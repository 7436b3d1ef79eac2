"""The audit against a count by hand."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import divergence as D
from corpusloom.llm import slices as S

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def by_hand(rows, audit):
    terms = [(l or "", s or "", TERM.findall((t or "").translate(LOWER))) for l, s, t in rows]
    out = set()
    for lang in {x[0] for x in terms}:
        own = [x for x in terms if x[0] == lang]
        df = Counter(w for x in own for w in set(x[2]))
        kept = {w for w, n in df.items() if n >= audit.least}
        counts = {s: Counter(w for x in own if x[1] == s for w in x[2] if w in kept) for s in {x[1] for x in own}}
        whole = sum(counts.values(), Counter())

        def share(c, w):
            return 1 + 10**9 * (c[w] + audit.added) // (sum(c.values()) + audit.added * len(kept))

        for s, c in counts.items():
            pairs = [(-sum(abs(share(c, w) - share(o, w)) for w in kept), x.encode(), x) for x, o in counts.items() if x != s]
            words = [(share(whole, w) - share(c, w), w.encode(), w) for w in c if share(c, w) > share(whole, w)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(words)[: audit.top])):
                out |= {(lang, s, part, x, -v, k + 1) for k, (v, _, x) in enumerate(found)}
    return out


def test_runs_and_groups():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB é.\n9") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    whole, S.BLOCK = S.BLOCK, 64
    try:
        a, b = (np.concatenate(x) for x in zip(*S.runs(data, offsets, D.TERM), strict=True))
    finally:
        S.BLOCK = whole
    words = [data[x:y].tobytes() for x, y in zip(a, b, strict=True)]
    assert words == [w.encode() for t in texts for w in TERM.findall(t)]
    # a hash that says nothing still gives exact groups
    for hashes in (np.zeros(len(a), np.uint64), S.hashed(data, a, b)):
        first, group = S.grouped(data, a, b, hashes)
        assert [words[first[g]] for g in group] == words and len({words[f] for f in first}) == len(first)


def test_distances_over_blank_columns():
    rng = np.random.default_rng(1)
    dense = rng.integers(0, 50, (5, 9))
    none = np.array([7, 8, 9, 10, 11])
    mask = rng.random((5, 9)) < 0.4
    mask[3] = False
    full = np.where(mask, dense, none[:, None])
    row, col = np.nonzero(mask)
    got = D.distances(np.arange(5), np.arange(5), row, col, full[row, col], none, 9)
    assert (got == np.abs(full[:, None, :] - full[None, :, :]).sum(2)).all()


@pytest.mark.parametrize("sizes", [(128, 1 << 17, 1 << 20), (2, 5, 10)])
def test_audit_by_hand(spark, monkeypatch, sizes):
    monkeypatch.setattr(D, "TILE", sizes[0])
    monkeypatch.setattr(D, "BLOCK_COUNTS", sizes[1])
    monkeypatch.setattr(D, "HELD", sizes[2])
    rng = random.Random(5)
    words = ["the", "The", "THE", "é", "É", "straße", "a", "b-c", "日本", "x9y", "K", "of"]
    rows = [(rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "s3", "é", "Z", None]), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(300)]
    rows += [("en", "empty", ""), ("en", "null", None), ("xx", "one", "rare words"), ("xx", "two", None), ("yy", "alone", "word"), rows[0], ("en", "long", "word " * 30000 + "w" * 100_000)]
    audit = D.Audit(least=20, top=4)
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "lang string, source string, text string, term int, value string")
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in D.divergence(docs, audit).collect()]
    assert set(got) == by_hand(rows, audit) and len(set(got)) == len(got)


def test_nothing(spark):
    assert D.divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_counts_of_a_slice():
    part = pa.RecordBatch.from_pydict({"lang": pa.array(["a", "a"]), "source": pa.array(["s", "s"]), "text": pa.array(["x X y", None])})
    assert sorted(map(tuple, (r.values() for r in D._counted(part).to_pylist()))) == [("a", "s", "x", 2, 1), ("a", "s", "y", 1, 1)]
