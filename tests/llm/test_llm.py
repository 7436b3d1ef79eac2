"""Operators of the training-data pipeline against brute force, with awkward rows.

Rows without an id, without text, with repeated ids, very long ones, and columns whose
names an operator also uses; and empty tables.
"""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import toxicity, wordhash
from corpusloom.llm.byte_bpe import BpeModel
from corpusloom.llm.embedding_dedup import link_vectors
from corpusloom.llm.exact_dedup import DigestIndex, exact_dedup, keep_first
from corpusloom.llm.html_text import extract_pages, main_text
from corpusloom.llm.ngram_join import Similarity, link_documents, tile_links
from corpusloom.llm.packing import best_fit, evolve, least_bins, pack_documents
from corpusloom.llm.queries import tokenizer_path
from corpusloom.plans.scratch import Scratch
from corpusloom.llm.spm_bpe import PieceModel, encode_documents
from corpusloom.llm.substring_dedup import remove_repeats
from corpusloom.llm.warc import read_archives, write_archives

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "id long, node long, row long, digest string, keep_id long, score double, part int, blob binary, size long, __id long"
EXTRA = (1, 2, 3, "x", 4, 0.5, 5, b"y", 6, 7)


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], f"{schema}, {CLASH}")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = ["alpha", "beta", "Gamma", "delta", "é", "日本", "x", "the", "of", "and"] + [f"w{i}" for i in range(300)]
    long = [rng.choice(words) for _ in range(6000)]
    passage = [rng.choice(words) for _ in range(70)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a"), (7, " ".join(long)), (8, " ".join(long[:3000] + ["new"] + long[3001:]))]
    for i in range(20, 40):
        own = [rng.choice(words) for _ in range(120)]
        rows.append((i, " ".join(own[:40] + passage + own[40:] if i % 2 else own)))
    rows += [(50, rows[10][1]), (51, rows[10][1].replace(" ", "\n", 3)), (52, rows[11][1] + " end"), (53, " ".join(["same"] * 200)), (54, " ".join(["same"] * 150))]
    return rows


def union(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


# ---- words ----


@pytest.mark.parametrize("block", [1 << 20, 40, 5])
def test_words_and_windows(block, monkeypatch):
    monkeypatch.setattr(wordhash, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(100):
        some = [None if rng.random() < 0.1 else "".join(rng.choice("ab é\t\n\x0b\x1c　") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(6))]
        data, offsets = wordhash.text_bytes(pa.array(some, pa.string()))
        hashes, of, a, b = wordhash.word_hashes(data, offsets)
        want = [WORD.findall(t or "") for t in some]
        assert [[bytes(data[a[i] : b[i]]).decode() for i in range(of[k], of[k + 1])] for k in range(len(some))] == want
        found, starts, owner = wordhash.windows(hashes, of, 2)
        grams = [tuple(w[i : i + 2]) for w in want for i in range(len(w) - 1)]
        assert len(set(zip(grams, found.tolist(), strict=True))) == len(set(grams)) == len(set(found.tolist()))


def test_packed_columns():
    a = np.sort(np.random.default_rng(0).integers(0, 1 << 62, 500)).astype(np.uint64)
    assert all((x == y).all() for x, y in zip(wordhash.unpack(wordhash.pack(a, a[::-1].copy()), 2), [a, a[::-1]], strict=True))


def test_parts_come_one_at_a_time():
    assert [wordhash.fine_parts(n) for n in (1, 51, 200, 4096, 10**6)] == [32, 32, 20, 1, 1]
    batches = [pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(range(len(p)))], names=["part", "x"]) for p in ([], [1, 1, 3], [3], [3, 7], [], [8])]
    assert [(part, rows.num_rows) for part, rows in wordhash.by_part(iter(batches))] == [(1, 2), (3, 3), (7, 1), (8, 1)]


# ---- toxicity ----


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(3)
    plain = ["stone", "river", "cloud", "tree", "house", "green", "walk"]
    bad = ["vexuri", "vexuna", "vexolo"]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(30)] + ([rng.choice(bad) for _ in range(3)] if toxic else [])
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(None, None), (900, ""), (901, "vexuri " * 30_000), (900, "")]
    labels += [(None, 1), (900, None), (0, 0), (7, 5)]
    data = frame(spark, docs)
    model = toxicity.fit(data, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = toxicity.score(data, model).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert len(held) > 30 and all(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert {r.score for r in rows if r.doc_id == 900} == {next(r.score for r in rows if r.doc_id is None)}
    assert [r.predicted for r in rows if r.doc_id == 901] == [1]


def test_toxicity_keeps_its_size():
    # lower values cost accuracy: held-out AUC and clean rows rejected
    assert (toxicity.KEPT_SLOTS, toxicity.STEPS) == (20_000, 300)


def test_toxicity_without_labels(spark):
    data = frame(spark, [(1, "a")])
    model = toxicity.fit(data, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.score(data, model).collect()] == [0]
    assert toxicity.score(data.limit(0), model).count() == 0


def test_log_count_ratios():
    got = toxicity.log_count_ratios(np.array([9, 0]), 10, np.array([0, 0]), 20)
    assert np.allclose(got, [math.log((10 / 12) / (1 / 22)), math.log((1 / 12) / (1 / 22))])


# ---- exact copies ----


def test_exact_dedup(spark, texts):
    rows = texts + [(None, "z z"), (None, "z z"), (4, "a b"), (60, "z  z")]
    got = exact_dedup(frame(spark, rows)).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    size = Counter(norm)
    assert Counter((r.doc_id, r.text_sha256, r.group_size) for r in got) == Counter((i, hashlib.sha256(t.encode()).hexdigest(), size[t]) for (i, _), t in zip(rows, norm, strict=True))
    assert sum(r.kept for r in got) == len(size)
    least = {}
    for (i, _), t in zip(rows, norm, strict=True):
        if i is not None:
            least[t] = min(i, least.get(t, i))
    assert all(r.keep_id == least[t] for t in least for r in got if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup(frame(spark, texts).limit(0)).count() == 0
    kept = keep_first(frame(spark, rows))
    assert kept.count() == len(size) and kept.columns == frame(spark, rows).columns


def test_digest_index_stays(spark):
    path = Scratch(spark, "t").path("index")
    index = DigestIndex(spark, path, 3)
    exact_dedup(frame(spark, [(1, "a"), (2, "a"), (3, "b")]), index=index, batch="one").collect()
    again = DigestIndex(spark, path, 3)
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup(frame(spark, [(10, "a"), (11, "c"), (12, "c")]), index=again, batch="two").collect()}
    assert got == {10: (1, False), 11: (11, True), 12: (11, False)}
    last = DigestIndex(spark, path, 3)
    assert last.rows().count() == 3
    last.close()


# ---- vectors ----


def test_embedding_links(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(6):
        centre = rng.normal(size=16)
        for k in range(90 if c == 0 else 8):
            rows.append((len(rows), (centre + rng.normal(size=16) * 0.12).tolist(), 1 if c < 3 else 2))
    rows += [(len(rows) + k, rng.normal(size=16).tolist(), 1) for k in range(100)]
    n = len(rows)
    rows += [(n, rows[0][1], 1), (n + 1, rows[0][1], 1), (n + 2, rows[0][1], 2), (n + 3, rows[0][1], None), (n + 4, None, 1), (n + 5, [0.0] * 16, 1), (n + 6, [math.nan] + [1.0] * 15, 1), (n + 7, [None] + [1.0] * 15, 1), (n + 8, [], 1), (None, rows[0][1], 1), (n + 9, [1.0, 2.0], 1)]
    got = {r.vec_id: r for r in link_vectors(frame(spark, rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows)
    usable = [(i, np.array(v, np.float32).astype(float), g) for i, v, g in rows if i is not None and g is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a[0], b[0]) for k, a in enumerate(usable) for b in usable[:k] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / math.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.93]
    degree = Counter(i for pair in links for i in pair)
    roots = union([i for i, _, _ in rows if i is not None], links)
    hit = sum(min(got[i].n_links, degree[i]) for i in roots)
    assert hit >= 0.99 * sum(degree.values()) and all(got[i].n_links <= degree[i] for i in roots)
    assert sum(got[i].component_id == roots[i] for i in roots) >= 0.99 * len(roots)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert got[n].n_links == degree[n] and got[n + 3].n_links == got[n + 4].n_links == got[None].n_links == 0


def test_embedding_links_of_a_large_label(spark):
    rng = np.random.default_rng(8)
    n, planted = 30_000, 300
    vectors = rng.standard_normal((n, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    other = rng.standard_normal((planted, 64))
    other -= (other * vectors[:planted]).sum(1, keepdims=True) * vectors[:planted]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.931 * vectors[:planted] + math.sqrt(1 - 0.931**2) * other
    rows = [(k, v.tolist(), 1) for k, v in enumerate(np.concatenate([vectors, near]))]
    got = {r.vec_id: r for r in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).where("n_links > 0").collect()}
    # windows are bounded: recall against all pairs, at the threshold itself; what is found is right
    hit = [k for k in range(planted) if k in got]
    assert len(hit) >= 0.95 * planted and len(got) == 2 * len(hit)
    assert all(got[k].n_links == got[n + k].n_links == 1 and got[n + k].component_id == k for k in hit)


def test_passes_follow_the_size_of_a_label():
    from corpusloom.llm.embedding_dedup import LEAST_PASSES, passes

    few = [passes(n, 0.93, 256) for n in (0, 10, 10**4, 10**6, 10**8)]
    assert few[0] == few[1] == LEAST_PASSES and few == sorted(few) and few[-1] > 2 * few[2]


def test_narrowed_products_keep_their_bound():
    from corpusloom.llm.embedding_dedup import _unit, _widened, narrowed

    rng = np.random.default_rng(6)
    units = _unit(np.concatenate([rng.standard_normal((200, 24)), rng.standard_normal((50, 24)) ** 7, np.eye(24)]))
    packed, slack = narrowed(units)
    wide = _widened(pa.chunked_array([pa.array([r.tobytes() for r in packed], pa.binary())])).astype(float)
    assert (np.abs(units @ units.T - wide @ wide.T) <= slack[:, None] + slack[None, :]).all() and slack.max() < 0.03


def test_close_pairs_are_exact(monkeypatch):
    from corpusloom.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 7)
    monkeypatch.setattr(embedding_dedup, "BLOCK_COLUMNS", 16)
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((5, 8))[rng.integers(0, 5, 90)] + 0.2 * rng.standard_normal((90, 8))).astype(np.float32)
    units = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    # a threshold that is a pair's own product
    threshold = float(np.einsum("j,j", units[3], units[np.argsort(units @ units[3])[-9]]))
    want = {(a, b) for a in range(90) for b in range(a + 1, 90) if np.einsum("j,j", units[a], units[b]) >= threshold}
    tree, got = np.arange(90), []
    for a, b in embedding_dedup.close_pairs(vectors, vectors, threshold, True):
        got += zip(a.tolist(), b.tolist(), strict=True)
        tree = embedding_dedup._unite(tree, a, b)
    roots = union(range(90), want)
    assert len(got) == len(set(got)) and set(got) ^ want <= {p for p in want | set(got) if abs(units[p[0]] @ units[p[1]] - threshold) < 1e-14}
    assert len({(tree[k], roots[k]) for k in range(90)}) == len(set(tree.tolist())) == len(set(roots.values()))


def test_embedding_links_across_borders_and_in_large_groups(spark, monkeypatch):
    from corpusloom.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "WINDOW", 4)
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", 16)
    monkeypatch.setattr(embedding_dedup, "SHARED_ROWS", 40)
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((4, 12))
    # doubles keep their precision; one group is far larger than a window and a tile
    rows = [(k, (centres[0 if k < 120 else 1 + k % 3] + 0.02 * rng.standard_normal(12)).tolist(), 1) for k in range(150)]
    rows += [(200, [1.0] + [0.0] * 11, 7), (201, [0.93, math.sqrt(1 - 0.93**2) * (1 - 1e-9)] + [0.0] * 10, 7)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)).collect()}
    assert all(got[k] == (119, 0) for k in range(120)) and all(got[k] == (9, 120 + k % 3) for k in range(120, 150)) and got[200] == (1, 200) == (got[201][0], got[201][1])


def test_embedding_links_of_nothing(spark):
    assert link_vectors(frame(spark, [], "vec_id long, embedding array<float>, label int")).count() == 0


# ---- near copies ----


def shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


@pytest.mark.parametrize("similarity", [Similarity(), Similarity(words=5, least=80), Similarity(words=2, least=50)])
def test_ngram_join(spark, texts, similarity, monkeypatch):
    from corpusloom.llm import ngram_join

    # small tiles, so that salts are used
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 4)
    rng = random.Random(11)
    base = [f"t{rng.randrange(1000)}" for _ in range(80)]
    rows = list(texts)
    for k in range(30):
        words = list(base)
        for _ in range(k % 7):
            words[rng.randrange(80)] = f"n{rng.randrange(1000)}"
        rows.append((200 + k, " ".join(words[: 80 - k % 5])))
    rows += [(None, "a b"), (4, "a b")]
    got = link_documents(frame(spark, rows), similarity).collect()
    sets = {i: shingles(t, similarity.words) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and similarity.scale * len(sets[a] & sets[b]) >= similarity.least * len(sets[a] | sets[b])]
    roots = union(sets, links)
    assert len(got) == len(rows) and len(links) > 20
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), roots[r.doc_id]) for r in got if r.doc_id is not None)
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(len(shingles("a b", similarity.words)), None)]
    degree = Counter(i for pair in links for i in pair)
    counted = link_documents(frame(spark, rows), similarity, count_links=True).collect()
    assert len(counted) == len(rows) and {(r.doc_id, r.component_id, r.n_links) for r in counted} == {(i, roots[i], degree[i]) for i in sets} | {(None, None, 0)}


def test_sets_that_only_meet_in_a_rare_shingle_are_not_dealt_whole(spark, monkeypatch):
    from corpusloom.llm import ngram_join

    words = [f"w{k}" for k in range(700)]
    near = " ".join(words[400:690])
    texts = [" ".join(["a b c", *words[:200]]), " ".join(["a b c", *words[200:400]]), near, near + " more"]
    # what else the first two hold is common, so that the shingle they share is among their rarest
    texts += [" ".join([*words[k : k + 40], *(f"x{k}y{copy}z{i}" for i in range(20))]) for k in range(0, 400, 20) for copy in range(2)]
    verify, dealt = ngram_join._verify, []
    monkeypatch.setattr(ngram_join, "_verify", lambda rows, members, *rest: dealt.append(members.count()) or verify(rows, members, *rest))
    found = link_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert dealt == [2] and {r.doc_id: r.component_id for r in found} == {k: 2 if k == 3 else k for k in range(len(texts))}


def test_sets_that_meet_by_chance_make_no_group(spark, monkeypatch):
    """Many sets that share a shingle with some other each are no candidate group (F1: tiles grow with the square of a group)."""
    from corpusloom.llm import ngram_join

    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(20)}" for _ in range(60)) for _ in range(600)]
    texts.append(texts[7] + " more")
    possible, grouped = ngram_join._possible, []
    monkeypatch.setattr(ngram_join, "_possible", lambda members, similarity: grouped.append(members.count()) or possible(members, similarity))
    found = link_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert grouped == [2] and {r.doc_id: r.component_id for r in found} == {k: 7 if k == 600 else k for k in range(601)}


@pytest.mark.parametrize("paired", [1, 3, 16])
def test_pairs_and_chains_lose_no_link(paired, monkeypatch):
    from corpusloom.llm import ngram_join

    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    rng, similarity = np.random.default_rng(4), Similarity(3, 80, 100)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 4000, 40)
        sets += [np.unique(np.concatenate([base[: len(base) - gone], rng.integers(0, 4000, gone)])) for gone in rng.integers(0, 9, 5)]
    firsts = [s[: similarity.prefix(len(s))] for s in sets]
    columns = [np.concatenate(firsts), *[np.concatenate([f(k, s, first) for k, (s, first) in enumerate(zip(sets, firsts, strict=True))]) for f in (lambda k, s, first: np.full(len(first), k), lambda k, s, first: np.full(len(first), len(s)), lambda k, s, first: np.arange(len(first)))]]
    pairs, chains = ngram_join.meeting(columns[0].astype(np.uint64), *columns[1:], similarity)
    links = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if similarity.overlap_fits(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
    marks = [ngram_join.parities(s.astype(np.uint64)) for s in sets]
    sizes = np.array(list(map(len, sets)))
    kept = pairs[ngram_join.pairs_possible(sizes[pairs[:, 0]], sizes[pairs[:, 1]], ([marks[i] for i in pairs[:, 0]], [marks[i] for i in pairs[:, 1]]), similarity)]
    roots = union({k: None for k in range(len(sets))}, [tuple(p) for p in np.concatenate([kept, chains]).tolist()])
    assert len(links) > 50 and all(roots[i] == roots[j] for i, j in links) and (len(kept) > 0 or paired == 1)


def test_marks_lose_no_link():
    from corpusloom.llm.ngram_join import parities, tile_possible

    rng, similarity = np.random.default_rng(3), Similarity()
    sets = []
    for n in (1, 2, 15, 255, 511, 513, 1100):
        base = rng.integers(0, 2**64, n, np.uint64)
        for gone in (0, n // 20, n // 12, n // 9, n // 2):
            sets.append(np.unique(np.concatenate([base[gone:], rng.integers(0, 2**64, gone // 2, np.uint64)])))

    def groups(pairs):
        up = list(range(len(sets)))
        for i, j in pairs:
            up = [min(up[i], up[j]) if g in (up[i], up[j]) else g for g in up]
        return up

    marks = [parities(s) for s in sets]
    exact, may = groups(tile_links(sets, None, similarity)), groups(tile_possible(np.array(list(map(len, sets))), marks, None, similarity))
    assert all(may[i] == may[exact[i]] for i in range(len(sets))) and len(set(may)) >= 7


def test_ngram_join_of_nothing(spark):
    assert link_documents(frame(spark, [])).count() == 0
    assert {r.component_id for r in link_documents(frame(spark, [(1, None), (2, "")])).collect()} == {1, 2}


def test_tile_links_are_exact():
    rng = np.random.default_rng(3)
    similarity = Similarity()
    base = np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > 0.04], rng.integers(0, 1 << 63, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(40)]
    linked = {(i, j) for i in range(40) for j in range(i) if similarity.overlap_fits(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    found = tile_links(sets, None, similarity)
    assert {(max(p), min(p)) for p in found} <= linked
    assert union(range(40), found) == union(range(40), linked)
    assert {(max(p), min(p)) for p in tile_links(sets, None, similarity, every=True)} == linked


# ---- repeated passages ----


@pytest.mark.parametrize("size", [1 << 23, 1 << 10])
def test_substring_dedup(spark, texts, size, monkeypatch):
    from corpusloom.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "SLICE", size)
    rows = texts + [(None, texts[10][1]), (21, "short"), (54, " ".join(["same"] * 60))]
    got = remove_repeats(frame(spark, rows).repartition(3), window=50).collect()
    first = {}
    for i, t in rows:
        words = WORD.findall(t or "")
        for k in range(len(words) - 49):
            key = tuple(words[k : k + 50])
            first[key] = min(first.get(key, math.inf), math.inf if i is None else i)
    want = []
    for i, t in rows:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for k in range(len(words) - 49):
            if first[tuple(words[k : k + 50])] < (math.inf if i is None else i):
                gone[k : k + 50] = [True] * 50
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(want)
    assert sum(w[2] for w in want) > 500
    same = {(r.doc_id, r.kept_text) for r in got if not r.n_removed}
    assert (3, " \t\n") in same and (1, None) in same
    assert remove_repeats(frame(spark, [])).count() == 0


# ---- archives ----


def test_warc_round_trip(spark, monkeypatch):
    from corpusloom.llm import warc

    monkeypatch.setattr(warc, "READ_BYTES", 700)
    rng = random.Random(2)
    body = "<p>" + "x" * 200
    rows = [(1, "u", body), (2, None, body), (3, "u\nv", "small"), (4, "u", "small"), (5, "u", None), (6, "", ""), (None, "u", body), (1, "u", body)]
    rows += [(100 + k, "u", "".join(rng.choice("abc é\x1f\x8b\x08") for _ in range(rng.randrange(3000)))) for k in range(40)]
    rows.append((200, "u", "WARC/1.1\r\n" + "y" * 300_000))
    data = frame(spark, rows, "page_id long, url string, html string")
    scratch = Scratch(spark, "t")
    manifest = write_archives(data.repartition(2), scratch.path("archives"), scratch)
    for split in (1000, 1 << 20):
        got = read_archives(spark, manifest, split, payloads=True).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest()) for i, _, t in rows)
        assert {r.page_id: (r.record_type, r.refers_to) for r in got if r.page_id in (1, 2, 3, 4, 5, 6, None)} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("response", None)}
        assert all(bytes(r.payload) == b"" for r in got if r.record_type == "revisit")
        assert len({r.record_id for r in got}) == len(got)
    head = gzip.decompress(open(manifest.first().path.removeprefix("file:").replace("///", "/"), "rb").read())
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and b"\r\n\r\nHTTP/1.1 200 OK\r\n" in head
    assert read_archives(spark, write_archives(data.limit(0), scratch.path("archives"), scratch)).count() == 0


def test_warc_of_ids_with_several_payloads(spark):
    a, b, c = ("<p>" + x * 200 for x in "abc")
    rows = [(1, "u", a), (2, "v", b), (5, "w", a), (5, "w", b), (5, "w", c)]
    scratch = Scratch(spark, "t")
    manifest = write_archives(frame(spark, rows, "page_id long, url string, html string").repartition(3), scratch.path("archives"), scratch)
    got = {(r.page_id, r.payload_digest): (r.record_type, r.refers_to) for r in read_archives(spark, manifest).collect()}
    of = lambda i, text: (i, hashlib.sha256(text.encode()).hexdigest())
    assert got == {of(1, a): ("response", None), of(2, b): ("response", None), of(5, a): ("revisit", 1), of(5, b): ("revisit", 2), of(5, c): ("response", None)}


def test_warc_of_another_writer(spark, tmp_path):
    def member(kind, extra, block):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{kind}>\r\nWARC-Target-URI: http://x/\r\n{extra}Content-Length: {len(block)}\r\n\r\n"
        return gzip.compress(head.encode() + block + b"\r\n\r\n")

    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n6\r\n world\r\n0\r\n\r\n"
    http = "Content-Type: application/http;msgtype=response\r\n"
    data = member("warcinfo", "", b"software: other") + member("request", http, b"GET / HTTP/1.1\r\n\r\n") + member("response", http, chunked) + member("revisit", "WARC-Payload-Digest: sha1:ABC\r\n", b"")
    (tmp_path / "x.warc.gz").write_bytes(data + b"no member")
    manifest = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", len(data) + 9)], "path string, bytes long")
    for split in (50, 1 << 20):
        got = sorted((r.record_type, r.page_id, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in read_archives(spark, manifest, split, payloads=True).collect())
        assert got == [("response", None, 11, hashlib.sha256(b"hello world").hexdigest(), b"hello world"), ("revisit", None, None, "sha1:ABC", b"")]


def test_warc_at_a_place_that_tasks_cannot_open():
    from corpusloom.llm.warc import _store

    with pytest.raises(ValueError, match="dbfs"):
        _store("dbfs://x/y")


# ---- packing ----


def test_best_fit_and_evolution():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 100) for _ in range(300)]
    bins = best_fit(sorted(range(300), key=lambda i: -sizes[i]), sizes, 100)
    for found in [bins, *evolve(sizes, 100, 1, []), *evolve(sizes, 100, 2, [bins])]:
        assert sorted(i for b in found for i in b) == list(range(300)) and all(sum(sizes[i] for i in b) <= 100 for b in found)
    assert least_bins(sizes, 100) <= len(evolve(sizes, 100, 3, [])[0]) <= len(bins)


def test_packing(spark, texts, monkeypatch):
    from tokenizers import Tokenizer

    from corpusloom.llm import packing

    monkeypatch.setattr(packing, "GROUP_ITEMS", 16)
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = texts + [(None, None), (4, "a b")]
    got = pack_documents(frame(spark, rows), tokenizer_path("byte_bpe_50k.json"), 256).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % 256 or 256
        for k, start in enumerate([0, *range(first, len(ids), 256)]):
            part = ids[start : first if k == 0 else start + 256]
            want[i, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert len(by) <= math.ceil(sum(r.length for r in got) / 256) + 3
    assert pack_documents(frame(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_word_memo_keeps_ids():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer, model, rng = Tokenizer.from_file(path), BpeModel(path, memo=50), random.Random(3)
    parts = ["<|endoftext|>", "'s", "  ", " ", " ", "a", "b", " é", "\n", "\t", ".", ",", "12", "日", "\x1c", "\x85", "　", "\0", "don't", "y,", "\r\n"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for k in range(0, len(some), 50):
        for text, raw in zip(some[k : k + 50], model.encode(some[k : k + 50]), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# ---- pages ----


def test_main_text():
    page = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><header class="site"><h1>Site</h1></header>
    <div id="cookie-notice">We use cookies, ok?</div><nav><ul><li><a href="/">Home</a></ul></nav><div class="sidebar"><p>Side, here.</p></div>
    <div class="content"><h1>Title &amp; more</h1><p>First   para,\n of <b>text</b> &lt;x&gt;.<p>Second<br>para.<ul><li>one<li>two</ul>
    <form><input><label>Name</label></form><section class="comments"><p>Nice article, I like this very much!</p></section></div><footer>&copy; f</footer>"""
    assert main_text(page) == "Title & more\nFirst para, of text <x>.\nSecond para.\none\ntwo"
    assert [main_text(p) for p in (None, "", "plain", "<p>a</p", "<article><p>cut <a href=\"x", "<nav>only</nav>")] == ["", "", "plain", "a", "cut", ""]


P1, P2, P3 = (
    "The river rose in the night, and by morning the lower road was gone; nobody had seen it so high since the spring of the great thaw.",
    "Farmers moved their animals up the slope before noon, helped by neighbours, soldiers and a school class that had the day off.",
    "By evening the water fell again, slowly at first, then so fast that the mill wheel, torn loose hours before, lay dry on the stones.",
)
MENU = "<ul><li><a href='/'>Home page</a></li><li><a href='/p'>All products</a></li><li><a href='/c'>Contact us</a></li></ul>"
FOOT = "Copyright 2024 River News, all rights reserved."
BODY = f"<h1>High water</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p>"
WANT = ["High water", P1, P2, P3]
#: Pages without telling elements and names but where noted, and the blocks of their article.
PAGES = [
    (f"<body><div>{MENU}</div><div>{BODY}</div><div>{FOOT}</div></body>", WANT),
    (f"<body><div>{MENU}</div><div>{BODY}</div><div><p>{FOOT}</p></div></body>", WANT),
    (f"<div><div>{MENU}</div><div><div>{BODY}</div></div><div><a href='/i'>Imprint</a> | <a href='/j'>Jobs</a></div></div>", WANT),
    (f"<table><tr><td>{MENU}</td><td>{BODY}</td><td>Weather: rain<br>Wind: north</td></tr></table>", WANT),
    (f"<div>{MENU}</div><div><h1>High water</h1><p>{P1}</p><h2>Noon</h2><p>{P2}</p><ul><li>two barns</li><li>one bridge</li></ul><p>{P3}</p></div>", ["High water", P1, "Noon", P2, "two barns", "one bridge", P3]),
    (f"<div>{MENU}</div><div><div><h1>High water</h1><p>{P1}</p></div><div><h2>Noon</h2><p>{P2}</p></div><div><p>{P3}</p></div></div><div>{FOOT}</div>", ["High water", P1, "Noon", P2, P3]),
    (f"<body>{MENU}{BODY}</body>", WANT),
    (f"<div class='x1'>{MENU}</div><div class='x2'>{P1}<br><br>{P2}</div><div class='x3'>{FOOT}</div>", [f"{P1} {P2}"]),
    (f"<div><span>Search</span> <span>Sign in</span></div><div>{BODY}</div>", WANT),
    (f"<div>{MENU}</div><div><h1>High <a href='/w'>water</a></h1><p>{P1} <a href='/more'>More about the road</a>.</p><p>{P2}</p><p>{P3}</p></div>", ["High water", P1 + " More about the road.", P2, P3]),
    (f"<div>{BODY}</div><div><div><a href='/1'>Storm over the hills</a></div><div><a href='/2'>A dry summer, again</a></div><div><a href='/3'>New bridge opens</a></div></div>", WANT),
    (f"<div><p>Read our app.</p></div><div>{BODY}</div><div><p>Call 555.</p></div>", WANT),
    (f"<div>{MENU}</div><div><blockquote><p>{P1}</p></blockquote><p>{P2}</p><pre>a b</pre><p>{P3}</p></div>", [P1, P2, "a b", P3]),
    (f"<div>{MENU}</div><div><p>{P1}</p><table><tr><td>7 am</td><td>2 m</td></tr></table><p>{P2}</p></div><div>{FOOT}</div>", [P1, "7 am", "2 m", P2]),
    (f"<div id='cookie-notice'><p>{P3}</p></div><div>{BODY}</div>", WANT),
    (f"<article>{BODY}<h2 id='legal'>Legal basis</h2><p>Short.</p></article><div>{FOOT}</div>", [*WANT, "Legal basis", "Short."]),
    (f"<article>{BODY}<h2 id='search-results'>What we found</h2><p>Short.</p></article>", [*WANT, "What we found", "Short."]),
    (f"<article>{BODY}<div id='notice'>Mind the step.</div></article>", [*WANT, "Mind the step."]),
    (f"<article>{BODY}<div class='comments'><p>{P2}</p></div><div class='ad'>{P3}</div></article><div class='notice'>{P1}</div>", WANT),
    (f"<article>{BODY}<section class='related-work'><h2>Related work</h2><p>{P2}</p></section></article>", [*WANT, "Related work", P2]),
    (f"<article>{BODY}<div class='share-price'>Shares fell 2 %.</div></article>", [*WANT, "Shares fell 2 %."]),
    (f"<article>{BODY}<div class='menu-costs'>A menu cost 7 crowns.</div></article>", [*WANT, "A menu cost 7 crowns."]),
    (f"<article>{BODY}<table class='navigation-data'><tr><td>7 am</td><td>2 m</td></tr></table></article>", [*WANT, "7 am", "2 m"]),
    (f"<main>{BODY}<div class='social-history'><p>Mills came late.</p></div></main>", [*WANT, "Mills came late."]),
    (f"<main>{BODY}<div id='login-guide'><p>Sign in first.</p></div></main>", [*WANT, "Sign in first."]),
    (f"<article>{BODY}<div class='related-posts'><p>{P2}</p></div><div id='comment-list'><div><p>{P3}</p><p>{P1}</p></div></div><ul class='share-buttons'><li>Send</li></ul></article>", WANT),
    (f"<main><article>{BODY}</article><section class='comments'><p>{P1}</p><p>{P2}</p></section></main>", WANT),
    (f"<article><h1>High water</h1><p>{P1}</p><div class='ad'>Buy a boat, now!</div><p>{P2}</p><p>{P3}</p></article>", WANT),
]
#: Of these the ones within article or main elements.
INSIDE = [x for x in PAGES if "<article>" in x[0] or "<main>" in x[0]]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_main_text_of_labelled_pages(k):
    page, want = PAGES[k]
    assert main_text(page).split("\n") == want


def test_main_text_comes_from_the_choice_of_paths(monkeypatch):
    from corpusloom.llm import html_text

    monkeypatch.setattr(html_text, "content_nodes", lambda nodes: [True] * len(nodes))
    assert sum(main_text(page).split("\n") != want for page, want in PAGES) >= 9
    assert sum(main_text(page).split("\n") != want for page, want in INSIDE) >= 3


def test_extract_pages(spark):
    rows = [(1, "u", "<article><p>one</p><p>two</p></article>"), (None, None, None), (1, "u", "<article><p>é</p></article>"), (2, "u", "<p>" + "x " * 200_000)]
    got = extract_pages(frame(spark, rows, "page_id long, url string, html string")).collect()
    assert Counter((r.page_id, r.url, r.n_chars) for r in got) == Counter([(1, "u", 7), (None, None, 0), (1, "u", 1), (2, "u", 399_999)])
    assert extract_pages(frame(spark, [], "page_id long, url string, html string")).count() == 0


# ---- pieces ----


def test_piece_encoding_is_the_librarys():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model, library, rng = PieceModel(path, memo=500), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(1)
    letters = "ab e  \t\n\n▁éß,.;'’1230日本語x😀\x00 thheinGER<s></s>"
    some = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["<s>", "<0x0A>", "a" * 500, " " * 60, "the" * 300, ""]
    for text in some:
        ids = model.encode(text)
        assert ids == library.encode(text) and model.decode(ids) == library.decode(ids) and next(model.spoken([text]))[1].decode() == library.decode(ids)


def test_encode_documents(spark, texts):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = texts + [(None, None), (4, "a b")]
    got = encode_documents(frame(spark, rows), path).collect()
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    assert encode_documents(frame(spark, []), path).count() == 0


# ---- licences ----


def test_licenses():
    from corpusloom.llm.license_scan import TEMPLATES, Scanner

    scanner = Scanner(TEMPLATES)
    for name, text in TEMPLATES.items():
        assert scanner.text("x\n" + text)[1] == [name]
    assert scanner.text("# SPDX-License-Identifier: ISC") == (1, ["ISC"])
    assert scanner.text(None) == scanner.text("") == (0, []) and scanner.text("my driving license is green")[1] == []


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("lorem ipsum dolor " * 45 + "Released under the MIT License. " + "sit amet " * 80, ["MIT"]),
        ("Licensed under the Apache License, Version 2.0 or the MIT License, at your option.", ["Apache-2.0", "MIT"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("You may copy it under the terms of the GNU GPL v2.", ["GPL-2.0"]),
        ("# it under the terms of the GNU Lesser General Public License as\n# published by the Free Software Foundation, either version 3 of the License", ["LGPL-3.0"]),
        ("Distributed under the LGPL-2.1 or, where that is not possible, the AGPLv3.", ["AGPL-3.0", "LGPL-2.1"]),
        ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\nCopyright", ["GPL-2.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("The pictures are available under CC BY-SA 4.0, the code under the 2-clause BSD license", ["BSD-2-Clause", "CC-BY-SA-4.0"]),
        ("Available under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International licence", ["CC-BY-NC-SA-4.0"]),
        ("// Permission to use, copy, modify, and distribute this software for any\n// purpose with or without fee is hereby granted, provided that the above\n// copyright notice appear in all copies.", ["ISC"]),
        ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
        ("The author has dedicated this to the public under CC0.", ["CC0-1.0"]),
        ("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0", ["Apache-2.0", "GPL-2.0-only", "MIT"]),
        ("Licensed under the Apache License, Version 1.1. All rights reserved.", []),
        ("The MIT campus gives a parking license each year.", []),
    ],
)
def test_license_wordings_that_are_not_templates(text, names):
    from corpusloom.llm.license_scan import TEMPLATES, Scanner

    assert Scanner(TEMPLATES).text(text)[1] == names


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("This work is NOT licensed under the MIT License.", []),
        ("We compared software under GPL version 3 with ours.", []),
        ("Use it under the same terms as Perl itself, not the MIT License.", []),
        ("Use it under the same terms as Perl itself and not the MIT License.", []),
        ("You aren't allowed to use it under the GNU GPL v3; it is released under the ISC license.", ["ISC"]),
        ("The driving license of 2024 was issued under the road act, version 2.", []),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", ["0BSD"]),
    ],
)
def test_license_denials_and_kin(text, names):
    from corpusloom.llm.license_scan import TEMPLATES, Scanner

    assert Scanner(TEMPLATES).text(text)[1] == names


def test_license_ranking_and_differences():
    import zstandard

    from corpusloom.llm.license_scan import BLOCK_SHARE, OF_BEST, PASSAGES, TEMPLATES, Scanner

    scanner = Scanner(TEMPLATES)
    block = TEMPLATES["BSD-3-Clause"].lower().replace("source and binary forms", "source or compiled forms").replace("specific prior written", "specific signed written")
    # brute force: the same sizes from fresh dictionaries, one template at a time
    alone, saved = len(zstandard.ZstdCompressor(level=3).compress(block.encode())), {}
    for name, text in TEMPLATES.items():
        raw = zstandard.ZstdCompressionDict(f"{text}\n{PASSAGES.get(name, '')}".lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        saved[name] = alone - len(zstandard.ZstdCompressor(level=3, dict_data=raw).compress(block.encode()))
    ranked = scanner.ranked(block, scanner.long, BLOCK_SHARE)
    assert ranked[0][1] == max(saved, key=saved.get) == "BSD-3-Clause" and [n for n, _ in ranked] == sorted((n for n, _ in ranked), reverse=True)
    assert {name for name, n in saved.items() if n >= max(OF_BEST * max(saved.values()), BLOCK_SHARE * alone)} == {name for _, name in ranked}
    found = {m[0]: m for m in scanner.matches(block)}
    assert found.keys() == {"BSD-3-Clause"}
    assert found["BSD-3-Clause"][2] == ["and", "binary", "prior"] and found["BSD-3-Clause"][3] == ["or", "compiled", "signed"]


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nPreamble\n\nThe GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n\nThe licenses for most software and other practical works are designed\nto take away your freedom to share and change the works.  By contrast,", "GPL-3.0"),
        ("This version of the GNU Lesser General Public License incorporates\nthe terms and conditions of version 3 of the GNU General Public\nLicense, supplemented by the additional permissions listed below.", "LGPL-3.0"),
        ("The GNU Affero General Public License is a free, copyleft license for\nsoftware and other kinds of works, specifically designed to ensure\ncooperation with the community in the case of network server software.", "AGPL-3.0"),
        ("TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n1. Definitions.\n\n\"License\" shall mean the terms and conditions for use, reproduction,\nand distribution as defined by Sections 1 through 9 of this document.", "Apache-2.0"),
        ("1.1. \"Contributor\"\n means each individual or legal entity that creates, contributes to\n the creation of, or owns Covered Software under this license.", "MPL-2.0"),
    ],
)
def test_openings_of_whole_texts(text, name):
    from corpusloom.llm.license_scan import TEMPLATES, Scanner

    assert name in Scanner(TEMPLATES).text(text)[1]


def test_compression_decides(monkeypatch):
    """With every template a winner, statements come out that are none."""
    from corpusloom.llm.license_scan import TEMPLATES, Scanner

    cases = ["We compared software under GPL version 3 with ours.", "Under the bridge they printed the old text of the Apache License, Version 2.0, on leaflets for visitors of the harbour."]
    scanner = Scanner(TEMPLATES)
    assert all(scanner.text(c)[1] == [] for c in cases)
    monkeypatch.setattr(Scanner, "ranked", lambda self, part, dictionaries, least: [(1, n) for n in dictionaries])
    assert all(Scanner(TEMPLATES).text(c)[1] for c in cases)


def test_scan_licenses(spark):
    from corpusloom.llm.license_scan import TEMPLATES, scan_licenses

    statement = "Licensed under the Apache License, Version 2.0."
    long = "lorem ipsum " * 40_000
    rows = [(1, statement), (1, statement), (2, None), (3, ""), (None, statement), (4, long + TEMPLATES["MIT"] + " " + long), (5, "SPDX-License-Identifier: Zlib"), (6, "no word of it")]
    got = scan_licenses(frame(spark, rows)).collect()
    assert Counter((r.doc_id, tuple(r.licenses)) for r in got) == Counter([(1, ("Apache-2.0",)), (1, ("Apache-2.0",)), (2, ()), (3, ()), (None, ("Apache-2.0",)), (4, ("MIT",)), (5, ("Zlib",)), (6, ())])
    assert {r.doc_id: r.spdx for r in got}[5] == ["Zlib"] and all(m.saved > 0 for r in got for m in r.matches)
    assert scan_licenses(frame(spark, [])).count() == 0


# ---- toxicity by hand ----


def test_slots_by_hand():
    def by_hand(text):
        text = " " + " ".join(text.lower().split()) + " "
        out = set()
        for n in range(3, 7):
            for i in range(len(text) - n + 1):
                h = ord(text[i]) + 1
                for c in text[i + 1 : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
                out.add(((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64) >> 44)
        return sorted(out)

    for text in ("", "a", "You ARE\tso  bad", "日本 語é"):
        assert toxicity.slots(text).tolist() == by_hand(text)
    long = "word soup " * 60_000
    assert toxicity.slots(long).tolist() == by_hand(long[:400])


def test_regression_by_hand():
    rng = np.random.default_rng(1)
    x = (rng.random((60, 12)) < 0.3).astype(float)
    y = (x[:, 0] + x[:, 3] > 0).astype(int)
    scale = rng.normal(size=12)
    w, b, dw, db = np.zeros(12), 0.0, np.zeros(12), 0.0
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for _ in range(toxicity.STEPS):
        error = (1 / (1 + np.exp(-((x * scale) @ w + b))) - y) * share
        dw = 0.9 * dw - toxicity.RATE * ((x * scale).T @ error + toxicity.PENALTY * w)
        db = 0.9 * db - toxicity.RATE * error.sum()
        w, b = w + dw, b + db
    got, intercept = toxicity.fit_regression([np.flatnonzero(r) for r in x], y, scale)  # rows without features too
    assert np.allclose(got, w) and np.isclose(intercept, b)


# ---- where evolution packs better ----


def test_evolution_beats_best_fit():
    better = 0
    for seed in range(6):
        rng = random.Random(seed)
        # bins of three pieces between a quarter and a half
        sizes = []
        while len(sizes) < 90:
            a, b = rng.randrange(250, 500), rng.randrange(250, 500)
            if 250 <= 1000 - a - b <= 500:
                sizes += [a, b, 1000 - a - b]
        plain = best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 1000)
        found = evolve(sizes, 1000, seed, [])[0]
        assert least_bins(sizes, 1000) <= len(found) <= len(plain)
        better += len(found) < len(plain)
    assert better >= 3
