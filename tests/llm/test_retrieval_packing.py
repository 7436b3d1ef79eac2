"""Windows against BM25 by hand, and every id in one piece."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import retrieval_packing as R
from corpusloom.llm.word_bpe import WordBpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_tokenizer():
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "'s", "'", "it's", "IT'S", "don't.", ".", ",", "!?", "é", "É", "é", "ß", "İ", "İ", "ΟΔΟΣ", "1", "4a", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", " ", " ", "\x85", "\x1c", "\t", "漢字", "🎉", "word", "Word.", "a.b", "\x00", "́", "ﬁ", "'Re"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", None, " ", "x" * 200_000]
    model, plain = WordBpe(PATH, memo=300), Tokenizer.from_file(PATH)
    assert model.apart
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        ids, offsets = model.encode(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [e.ids for e in plain.encode_batch_fast([t or "" for t in part], add_special_tokens=False)]
    other = WordBpe(public_tokenizers.path("byte_bpe_50k.json"))
    ids, offsets = other.encode(pa.array(["It is", None, ""]))
    assert not other.apart and offsets.tolist() == [0, 2, 2, 2] and len(ids) == 2


def bm25(items, idf, mean, seed, k):
    tf = Counter(items[k].tolist())
    return sum(idf[t] * tf[t] * (R.K1 + 1) / (tf[t] + R.K1 * (1 - R.B + R.B * len(items[k]) / mean)) for t in set(items[seed].tolist()) if t in tf)


def test_windows_take_the_best_unused():
    rng = np.random.default_rng(4)
    items = [rng.integers(0, 60, rng.integers(1, 25)).astype("<u4") + 20 * (k % 3) for k in range(80)]
    df = np.bincount(np.concatenate([np.unique(i) for i in items]), minlength=120)
    idf = R.weights(df, len(items))
    mean = float(np.mean([len(i) for i in items]))
    windows = R.fill(items, idf, mean, 64)
    assert all(sum(b - a for _, a, b in w) == 64 for w in windows[:-1])
    unused, rest = set(range(80)), None
    for w in windows:
        seed, a, b = w[0]
        if rest is None:
            assert seed == min(unused) and (a, b) == (0, len(items[seed]))
            unused.discard(seed)
        else:
            assert w[0] == rest
        rest = None
        for k, a, b in w[1:]:
            best = max(round(bm25(items, idf, mean, seed, u), 9) for u in unused)
            assert k in unused and math.isclose(bm25(items, idf, mean, seed, k), best, abs_tol=1e-8)
            unused.discard(k)
            if b < len(items[k]):
                rest = (k, b, len(items[k]))
        if rest is not None and rest[2] - rest[1] > 64:
            pytest.fail("items are shorter than a window")
    assert not unused and rest is None


@pytest.mark.parametrize("shard", [300, 1 << 19])
def test_every_id_in_one_piece(spark, monkeypatch, shard):
    monkeypatch.setattr(R, "SHARD_TOKENS", shard)
    rng = random.Random(2)
    topics = [["cat", "purr", "fur"], ["ship", "sail", "sea"], ["gene", "cell", "dna"]]
    rows = [(k, " ".join(rng.choices(topics[k % 3], k=rng.randint(1, 40)))) for k in range(400)]
    rows += [(None, "cat"), (3, rows[3][1]), (1000, None), (1001, ""), (1002, "sea " * 1000), *[(2000 + k, "the same words in each copy of it") for k in range(200)]]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, key int")
    got = R.pack_by_retrieval(docs, PATH, capacity=128).collect()
    plain = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows:
        want[i, tuple(plain.encode(t or "", add_special_tokens=False).ids) + (2,)] += 1
    # pieces of equal documents can't be told apart, so they are counted by their place
    pieces, expected = Counter(), Counter()
    for r in got:
        ids = next(i for d, i in want if d == r.doc_id and len(i) == r.doc_tokens)
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        pieces.update((r.doc_id, at) for at in range(r.start, r.start + r.length))
    for (i, ids), n in want.items():
        expected.update({(i, at): n for at in range(len(ids))})
    assert pieces == expected
    windows = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert windows.get(r.sequence_id, 0) == r.offset
        windows[r.sequence_id] = r.offset + r.length
    rest = sorted(n for n in windows.values() if n != 128)
    assert all(n & (n - 1) == 0 for n in rest) and len(set(rest)) == len(rest)


def test_nothing(spark):
    assert R.pack_by_retrieval(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
