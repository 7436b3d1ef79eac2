"""The stages on a small corpus with clashing and missing values."""

import random

import corpus_pipeline
from corpusloom.llm import ngram_join, substring_dedup
from corpusloom.llm.queries import ORACLES, QUERIES
from tests.llm.test_llm import shingles, union


def test_stages(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    text = " ".join(words[:200])
    docs = [
        (1, text, "s", 9, "k"), (2, text, "s", 9, "k"), (3, text + " more", "s", 9, "k"), (4, " ".join(words[140:200] + words[300:400]), "s", 9, "k"),
        (5, None, None, None, None), (6, "", "s", 0, "k"), (None, "no id", "s", 5, "k"), (7, "bad " * 3, "s", 12, "k"),
    ]
    schema = "doc_id long, text string, source string, n_chars long, __id string"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in range(1, 5)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    data = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, data, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        columns = data.columns
        data = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = data.collect()
        if name != "best-fit packing":
            assert data.columns == columns
    ids = {name: sorted((-1 if r.doc_id is None else r.doc_id) for r in rows) for name, rows in seen.items()}
    assert ids["toxicity"] == [-1, 1, 2, 3, 4, 5, 6, 7]
    assert ids["exact dedup"] == [-1, 1, 3, 4, 5, 7]
    assert ids["n-gram Jaccard join"] == [-1, 1, 4, 5, 7]
    left = {r.doc_id: r for r in seen["substring dedup"]}
    assert left[4].text == " ".join(words[300:400]) and left[4].n_chars == len(left[4].text)
    assert left[1].text == text and left[5].text is None and left[1].n_chars == 9
    assert sum(r.piece == 0 for r in seen["best-fit packing"]) == 5


def test_stages_in_many_slices(spark, tmp_path, monkeypatch):
    """Near copies and passages of a corpus whose slices, hash ranges and buckets split, against brute force."""
    monkeypatch.setattr(substring_dedup, "SLICE", 1 << 11)
    monkeypatch.setattr(ngram_join, "SLICE", 1 << 11)
    rng = random.Random(21)
    words = [f"v{i}" for i in range(900)]
    passages = [[rng.choice(words) for _ in range(80)] for _ in range(3)]
    rows = []
    for i in range(90):
        own = [rng.choice(words) for _ in range(rng.randrange(5, 200))]
        if i % 3 == 0:
            own[3:3] = passages[i % 9 // 3]
        if i % 10 == 9:
            own = rows[i - 4][1].split()
            own[len(own) // 2] = "changed"
        rows.append((i, " ".join(own)))
    rng.shuffle(rows)
    data = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = {i: shingles(t, 5) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = union(sets, links)
    kept = corpus_pipeline.near(spark, data, "")
    assert {r.doc_id for r in kept.collect()} == {i for i in sets if roots[i] == i} and len(links) >= 5
    first: dict = {}
    for i, t in sorted(rows):
        own = t.split()
        for k in range(len(own) - 49):
            first.setdefault(tuple(own[k : k + 50]), i)
    left = {}
    for i, t in rows:
        own = t.split()
        gone = set()
        for k in range(len(own) - 49):
            if first[tuple(own[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        left[i] = " ".join(w for k, w in enumerate(own) if k not in gone) if gone else t
    assert {r.doc_id: r.text for r in corpus_pipeline.substrings(spark, data, "").collect()} == left
    assert sum(left[i] != t for i, t in rows) >= 20


def test_stages_over_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLES) <= set(QUERIES)


def test_stages_do_not_keep_a_tokenizer_of_another():
    """A worker drops tokenizer and memo of the packing stage before it works for another (pipeline: 3,013 MB when it ran again)."""
    import psutil

    from corpusloom.llm import byte_bpe, wordhash
    from corpusloom.llm.queries import tokenizer_path

    used = lambda: psutil.Process().memory_full_info().uss / 1e6
    rest = used()
    byte_bpe.model_at(tokenizer_path("byte_bpe_50k.json")).encode([f"word{k} other{k}" for k in range(200_000)])
    full = used()
    wordhash.start_afresh()
    assert not byte_bpe._MODELS and used() - rest < (full - rest) / 2
    # and it comes again when it is asked for
    assert byte_bpe.model_at(tokenizer_path("byte_bpe_50k.json")).encode(["a b"])[0]
    wordhash.start_afresh()
