"""Operators on small hand-made tables."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import audit, cluster, crawl, graph, keywords, linking, sync, vector
from corpusloom.plans.scratch import Scratch
from corpusloom.sources import sinks, tables
from corpusloom.sources.content import pages, read_markdown


def rows(frame, *by):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (129, 128)]
    got = dict(rows(graph.components(spark.createDataFrame(chain + star, "a long, b long"), Scratch(spark, "t"))))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert rows(graph.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"))) == []


def test_similarity(spark):
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 0.0]), (6, [2.0, 0.0])]
    frame = spark.createDataFrame(data, "id long, vec array<double>")
    assert [r[:2] for r in rows(vector.threshold_pairs(frame, 0.99))] == [(1, 2), (1, 6), (2, 6)]
    near = {(r.a, r.rank): r.b for r in vector.top_neighbours(frame, 1).collect()}
    assert near[(1, 1)] == 6 and near[(6, 1)] == 1 and (4, 1) not in near
    assert [r[:2] for r in rows(vector.duplicate_pairs(frame, 0.99))] == [(1, 2), (1, 6), (2, 6)]


def test_nearest_of_blocks_are_those_of_all(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = rng.integers(-1, 2, (300, 4)).astype(float)  # many ties
    points[:, 0] += 0.5
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    sims = np.round(units @ units.T, 12)
    want = {(a, b, r + 1) for a in range(300) for r, b in enumerate(sorted((b for b in range(300) if b != a), key=lambda b: (-sims[a, b], b))[:5])}
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(points)], "id long, vec array<double>")
    scored, pairs = [], vector.block_pairs
    monkeypatch.setattr(vector, "block_pairs", lambda *rest, **named: scored.append(pairs(*rest, **named)) or scored[-1])
    for size in (64, 10_000):
        monkeypatch.setattr(vector, "BLOCK_ROWS", size)
        assert {(r.a, r.b, r["rank"]) for r in vector.top_neighbours(frame, 5).collect()} == want
    # five blocks: each vector goes to as many pairs of blocks, not to twice as many
    assert scored[0].count() == 5 * 300
    other = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id long, vec array<double>")
    with pytest.raises(Exception, match="different lengths"):
        vector.top_neighbours(other, 1).collect()


def test_equal_vectors_add_no_pairs(spark):
    frame = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5, 0, -1)] + [(9, [2.0, 1.0]), (10, [0.0, 0.0])], "id long, vec array<double>")
    assert rows(vector.equal_classes(frame).select("id", "class_id", "copies")) == [(1, 1, 5), (2, 1, 5), (3, 1, 5), (4, 1, 5), (5, 1, 5), (9, 9, 1)]


def test_percentiles_near_and_far(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = [("a", float(x)) for x in rng.normal(size=3000)] + [("b", 1.0)] * 50 + [("c", None)]
    frame = spark.createDataFrame(data, "g string, v double")
    want = {"a": np.percentile([x for g, x in data if g == "a"], [5, 95]).tolist(), "b": [1.0, 1.0]}
    for small in (10_000, 1000):
        monkeypatch.setattr(audit, "SMALL_GROUP", small)
        got = {r.g: [r.lo, r.hi] for r in audit.percentiles(frame, "v", {"lo": 0.05, "hi": 0.95}, "g").collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[g], want[g]) for g in want)
    whole = audit.percentiles(frame, "v", {"m": 0.5}).first().m
    assert np.isclose(whole, np.median([x for _, x in data if x is not None]))


def test_similarity_members(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (2, 3, 0.8), (7, 8, 0.7)], "a long, b long, sim double")
    found, members = graph.groups(pairs, Scratch(spark, "t"))
    assert rows(found) == [(1, 3, 0.9), (7, 2, 0.7)]
    assert [tuple(r) for r in members.orderBy("group_id", "rank").collect()] == [(1, 2, 2, 1), (1, 1, 1, 2), (1, 3, 1, 3), (7, 7, 1, 1), (7, 8, 1, 2)]


def test_scratch_needs_a_shared_folder():
    class Context:
        master = "spark://x:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()
        conf = {}  # noqa: RUF012

    import pytest

    from corpusloom.plans.scratch import shared_folder

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())


def test_cache_encodes_each_text_once(spark):
    seen = []
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, text string")
    cache = spark.createDataFrame([], "model string, text_hash string, dim int, vec array<float>")
    got, append = vector.encode_cached(texts, cache, "m", vector.hashing_encoder(8))
    assert append.count() == 3 and got.where("vec IS NOT NULL").count() == 4 and not seen


def test_audit(spark):
    data = [(i, "s", [1.0, 0.01 * i]) for i in range(20)] + [(90, "t", [0.0, 1.0])]
    drift = audit.with_drift(spark.createDataFrame(data, "id long, section string, vec array<double>"))
    report = {r.section: r for r in audit.section_report(drift).collect()}
    assert report["t"].n_pages == 1 and abs(report["t"].focus - 1) < 1e-9 and report["s"].focus > 0.99
    advice = {r.id: r.recommendation for r in audit.outliers(drift).collect()}
    assert advice[90].startswith("section too small") and 0 in advice
    assert {r.section: r.medoid for r in audit.medoids(drift.select("id", "section", "vec"), "section").collect()}["t"] == 90


def test_outliers_judge_by_the_numbers_they_return(spark):
    def last_digits(x):
        return x + float(np.random.default_rng().random()) * 1e-12

    # the 95th percentile of 21 rows is a row's value, and only one lies above it
    noisy = F.udf(last_digits, "double").asNondeterministic()
    drift = spark.range(21 * 30).select("id", (F.col("id") % 30).cast("string").alias("section"), (F.floor(F.col("id") / 30) / 100).alias("d"))
    drift = drift.select("id", "section", noisy("d").alias("dist_section"), F.lit(0.1).alias("dist_site"))
    found = audit.outliers(drift).collect()
    assert len(found) == 30 and {r.id // 30 for r in found} == {20} and all(r.dist_section > r.p95_dist for r in found)


def test_broken_links(spark):
    html = spark.createDataFrame([("https://h.com/a", '<a href="/x"><a href="/y">'), ("https://h.com/b", '<a href="/x">'), ("https://h.com/c", None)], "url string, html string")
    links = crawl.page_links(html, internal="h.com")
    status = spark.createDataFrame([("https://h.com/x", 404)], "url string, status int")
    assert [tuple(r) for r in crawl.broken_links(links, status).collect()] == [(404, "https://h.com/x", "404", "https://h.com/a"), (404, "https://h.com/x", "404", "https://h.com/b")]
    assert rows(crawl.unknown_links(links, status)) == [("https://h.com/y",)]


def test_sitemap(spark):
    data = [(i, f"https://b.co/football/{i}" if i % 2 else f"/x/{i}", "2025-01-0%d" % (i % 9 + 1)) for i in range(25)] + [(25, None, None)]
    chunks = crawl.split_sitemap(spark.createDataFrame(data, "pos long, loc string, lastmod string"), 5)
    assert rows(chunks.groupBy("section", "chunk").count()) == [("football", 0, 5), ("football", 1, 5), ("football", 2, 2), ("general", 0, 5), ("general", 1, 5), ("general", 2, 4)]
    assert crawl.site_base(spark.createDataFrame(data[1:], "pos long, loc string, lastmod string")).first().base == "https://b.co"
    assert sinks.sitemap_index(chunks, "https://b.co").first().section == "general"


def test_keywords(spark):
    frame = spark.createDataFrame([("s", "red dogs run. red dogs sleep"), ("s", None)], "source string, text string")
    assert keywords.group_keywords(frame, "source", "text").where("rank = 1").first().phrase == "red dogs"
    assert keywords.yake("") == [] and keywords.yake("Vector search engines. Vector search is fast.")[0][0].startswith("vector")


def test_link_rules(spark):
    page = "<html><head><title>bot</title></head><body><h1>bot</h1><p>A chat-bot and a bot here, <a href='/z'>bot</a> bot</p><div class='no-linkbuilding'>shop</div><p>Shop</p></body></html>"
    html, done = linking.apply_rules(page, [("bot", "/bot/", "T"), ("shop", "/shop/", ""), ("here", "/bot/", "")])
    assert done == [("bot", "/bot/"), ("shop", "/shop/")]
    assert 'a <a href="/bot/" title="T" class="prose-links">bot</a> here' in html and '<p><a href="/shop/" class="prose-links">Shop</a></p>' in html
    rules = spark.createDataFrame([("bot", "/bot/", "T", 1)], "keyword string, url string, title string, priority int")
    frame = spark.createDataFrame([(1, page), (2, None)], "id long, html string")
    wordless = spark.createDataFrame([("...", "/dots/", "T", 1), (" ", "/x/", "T", 1)], "keyword string, url string, title string, priority int")
    for some in (rules, rules.union(wordless)):
        assert {r.id: r.n_links for r in linking.link_pages(frame, some).collect()} == {1: 1, 2: 0}


def test_recommendations(spark):
    text = "Our team wrote about vector search engines because vector search engines find similar pages in large collections of many documents every single day"
    page = [(1, "/a/", "Start page", "", [], [], [1.0, 0.0]), (2, "/vector-search/", "Vector search engines", "", ["vector search"], [], [0.9, 0.43589])]
    par = [(1, 0, text, [0.9, 0.43589]), (1, 1, text.replace("vector search", "garden tools"), [1.0, 0.0])]
    pages_ = spark.createDataFrame(page, "id long, url string, title string, description string, keywords array<string>, existing array<string>, vec array<double>")
    got = linking.recommend_links(pages_, spark.createDataFrame(par, "id long, para int, text string, vec array<double>")).collect()
    assert [(r.source, r.paragraph_index, r.target, r.text) for r in got] == [(1, 0, 2, "vector search")]
    # no anchor passes by its words: with an encoder the finalists are scored by their vectors
    strict = linking.LinkLimits(anchor=1.12, preferred_anchor=1.12)
    assert linking.recommend_links(pages_, spark.createDataFrame(par, "id long, para int, text string, vec array<double>"), strict).count() == 0
    same = lambda texts: np.array([[0.9, 0.43589]] * len(texts))
    by_vector = linking.recommend_links(pages_, spark.createDataFrame(par, "id long, para int, text string, vec array<double>"), strict, encode=same).collect()
    assert [(r.source, r.target, r.anchor_confidence) for r in by_vector] == [(1, 2, 1.0)]
    assert linking.distinct_links(spark.createDataFrame(got)).count() == 1


def test_resolve_urls(spark):
    columns = "rel_path string, lang string, en_url string, translated_url string, section_prefix string"
    data = [
        ("blog/a.md", "de", "/blog/big-news/", "/blog/große-neuigkeit/", "de/blog"),
        ("blog/b.md", "de", "/blog/acme-help/", "/blog/hilfe/", "de/blog"),
        ("blog/c.md", "de", "/blog/c/", "/blog/taken/", "de/blog"),
        ("blog/d.md", "de", "/blog/d/", "/blog/neu/", "de/blog"),
        ("blog/_index.md", "de", "/blog/", "/blog/", None),
        ("blog/e.md", "de", None, "/x/", None),
        ("blog/f.md", "ja", "/blog/f/", "/blog/日本/", "ja/blog"),
    ]
    owned = spark.createDataFrame([("de", "/de/blog/taken/", "other.md")], "lang string, address string, owner string")
    history = spark.createDataFrame([("blog/d.md", "de", "/de/blog/alt/")], "rel_path string, lang string, previous string")
    brands = spark.createDataFrame([("acme",)], "word string")
    got = {r.rel_path: r for r in sync.resolve_urls(spark.createDataFrame(data, columns), owned, history, brands, [], ["ja"]).collect()}
    assert got["blog/a.md"].url == "/de/blog/grosse-neuigkeit/" and got["blog/a.md"].alias == "/de/blog/big-news/"
    assert got["blog/b.md"].url == "/de/blog/acme-help/" and "brand" in got["blog/b.md"].reason
    assert got["blog/c.md"].url == "/de/blog/c/" and "collided with other.md" in got["blog/c.md"].reason
    assert got["blog/d.md"].url == "/de/blog/alt/"
    assert got["blog/_index.md"].url is None and got["blog/e.md"].reason == "english page has no explicit url"
    assert got["blog/f.md"].url == "/ja/blog/f/"


def test_sync(spark):
    i18n = spark.createDataFrame([("en", "a", "A"), ("en", "b", "B"), ("de", "a", "Ä")], "lang string, key string, value string")
    assert rows(sync.missing_keys(i18n)) == [("de", "b", "B")]
    attrs = spark.createDataFrame([("x.md", "en", {"image": "1", "date": "d"}), ("x.md", "de", {"image": "2", "date": "d"})], "rel_path string, lang string, attrs map<string,string>")
    assert rows(sync.attribute_changes(attrs, ["image", "date"])) == [("x.md", "de", {"image": "1"})]
    index = spark.createDataFrame([("de", "blog", "/de/nachrichten/"), ("de", "", "/de/"), ("en", "blog", "/x/"), ("de", "ok", "/de/ok/")], "lang string, dir string, url string")
    assert rows(sync.redirects(index)) == [("/de/blog/", "/de/nachrichten/", "301"), ("/de/blog/*", "/de/nachrichten/:splat", "301")]
    slugs = spark.createDataFrame([("de", "blog", "nachrichten")], "lang string, dir string, slug string")
    assert rows(sync.directory_urls(slugs, spark.createDataFrame([("de", "blog/sub")], "lang string, dir string"))) == [("de", "blog/sub", "/de/nachrichten/sub/")]


def test_sources(spark, tmp_path):
    site = tmp_path / "content"
    (site / "en" / "blog").mkdir(parents=True)
    (site / "en" / "blog" / "a.md").write_text('+++\ntitle = "T"\nurl = "/u/"\n+++\nBody\n')
    (site / "en" / "_index.md").write_text("no front matter")
    got = {r.rel_path: r for r in pages(read_markdown(spark, str(site), Scratch(spark, 'site'))).collect()}
    assert got["blog/a.md"].title == "T" and got["blog/a.md"].section == "blog" and got["blog/a.md"].body == "Body\n"
    assert got["_index.md"].is_index and got["_index.md"].body == "no front matter"
    (tmp_path / "t.csv").write_text("flow_input;filename\n a ; x \n;y\n")
    assert rows(tables.read_topics(spark, str(tmp_path / "t.csv"))) == [("a", "x")]
    (tmp_path / "en.yaml").write_text("a: A\nb: B\n")
    assert rows(tables.read_yaml_keys(spark, str(tmp_path / "en.yaml"))) == [("en", "a", "A"), ("en", "b", "B")]
    (tmp_path / "s.xml").write_text('<urlset><url><loc>https://h/a</loc></url><url><loc>https://h/b</loc><lastmod>2025</lastmod></url></urlset>')
    assert [r[1:] for r in rows(tables.read_sitemap(spark, str(tmp_path / "s.xml")))] == [("https://h/a", None), ("https://h/b", "2025")]
    robots = spark.createDataFrame([("User-agent: *\nsitemap: https://h/s.xml\n",)], "x string")
    assert robots.select(tables.robots_sitemaps(F.col("x"))).first()[0] == ["https://h/s.xml"]
    rules = spark.createDataFrame([("Bot", "/b/", 1), ("bot", "/b/", 3), ("", "/c/", 1)], "keyword string, url string, priority int")
    assert [r[:2] for r in rows(tables.keyword_rules(rules))] == [("bot", "/b/")]


def test_stream_cache(spark, tmp_path):
    from corpusloom.streaming.events import CACHE_SCHEMA, cache_batches

    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, text string").write.parquet(source)
    stream = spark.readStream.schema("id long, text string").parquet(source)
    cache_batches(stream, str(tmp_path / "cache"), "m", vector.hashing_encoder(4), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.schema(CACHE_SCHEMA).parquet(str(tmp_path / "cache")).count() == 2


def test_keywords_of_groups_against_the_definition(spark, monkeypatch):
    """Few slots and short slices: slots are shared and bounds come from many parts. Digits above the line are parts of words, as in the SQL."""
    monkeypatch.setattr(keywords, "SLOTS", 1 << 8)
    monkeypatch.setattr(keywords, "ROW", 1 << 4)
    rng = random.Random(3)
    words = ["the", "and", "div", "of", "km²", "abc½", "naïve", "café", "नमस्ते", "x_y", "red", "dogs", "run", "far", "away"]
    rows = [(rng.choice(["a", "b", None]), " ".join(rng.choices(words, range(1, 16), k=rng.randint(0, 60))) + rng.choice(["", "!", "\n\t", " A-B"])) for _ in range(300)]
    rows += [("one", "Only these words"), ("none", None), ("short", "a b c")]
    count: dict = {}
    for group, text in rows:
        found = [w for w in "".join(c if unicodedata.category(c)[0] in "LMN" or c == "_" else " " for c in (text or "").lower()).split(" ") if len(w) > 2]
        for n in (2, 3, 4):
            for k in range(len(found) - n + 1):
                gram = found[k : k + n]
                if not set(gram) & set(keywords.NOISE) and set(gram) - set(keywords.NOISE) - set(X.STOPWORDS):
                    key = (group, " ".join(gram))
                    count[key] = count.get(key, 0) + 1
    want = {}
    for group in {g for g, _ in count}:
        best = sorted((-n, p.encode(), p) for (g, p), n in count.items() if g == group)[:20]
        want |= {(group, p): (-n, rank + 1) for rank, (n, _, p) in enumerate(best)}
    frame = spark.createDataFrame(rows, "source string, text string").repartition(5)
    got = {(r.source, r.phrase): (r.n, r["rank"]) for r in keywords.group_keywords(frame, "source", "text").collect()}
    assert got == want
    assert keywords.group_keywords(frame.limit(0), "source", "text").collect() == []
