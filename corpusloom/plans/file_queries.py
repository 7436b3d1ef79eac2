"""Queries over the texts of files: front matter, markup, site maps, caches; and their SQL.

The files' texts are made of the columns of the test tables, alike in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import slugs as S
from corpusloom.functions import text as X
from corpusloom.plans.scratch import Scratch
from corpusloom.operators import cluster, keywords, linking, sync
from corpusloom.plans.queries import read
from corpusloom.sources import content, sinks, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


# ---- front matter ----

_TOML = """+++\ntitle = "%s"\nurl = '/%s/'\naliases = ["/a/", '/b/%d/']\ntags = ["x", "%s"]\ndraft = false\n+++\n"""


def _file():
    """A markdown file: TOML for most, YAML for German, one bad line for Spanish, no front matter for French; a mark of byte order for English."""
    toml = F.format_string(_TOML, "source", "lang", "doc_id", "lang")
    bad = F.format_string('+++\ntitle == "%s"\nkind = "%s"\n+++\n', "source", "lang")
    yaml = F.format_string("---\ntitle: %s\ndraft: true\n---\n", "source")
    start = F.when(F.col("lang") == "de", yaml).when(F.col("lang") == "es", bad).when(F.col("lang") == "fr", "").otherwise(F.concat(F.lit("﻿"), toml))
    return F.concat(start, "text")


@query("""
    SELECT doc_id, CASE lang WHEN 'en' THEN source WHEN 'de' THEN source WHEN 'es' THEN source END AS title, CASE WHEN lang = 'en' THEN '["x","en"]' END AS tags, md5(text) AS body,
           CASE WHEN lang = 'en' THEN source END AS by_pattern, CASE WHEN lang = 'en' THEN ['/a/', '/b/' || doc_id || '/'] ELSE [] END AS aliases FROM documents
""")
def front_matter_fields(spark, sf_dir):
    """Metadata and body of files with TOML, YAML, broken TOML and none, and fields by pattern alone."""
    rows = _docs(spark, sf_dir).select("doc_id", _file().alias("raw"))
    rows = rows.withColumn("f", content.front_matter(F.col("raw"), yaml_too=True, recover=True))
    return rows.select("doc_id", F.get_json_object("f.meta", "$.title").alias("title"), F.get_json_object("f.meta", "$.tags").alias("tags"), F.md5(F.col("f.body").cast("binary")).alias("body"), content.field(F.col("raw"), "title").alias("by_pattern"), content.aliases(F.col("raw")).alias("aliases"))


@query("""
    SELECT doc_id, CASE WHEN lang = 'en' THEN source END AS title, CASE WHEN lang = 'en' THEN '/en/' END AS url, CASE WHEN lang = 'en' THEN false END AS draft, CASE WHEN lang = 'en' THEN ['x', 'en'] END AS tags,
           CASE WHEN length(source) = 4 THEN '' ELSE source END AS section, length(source) = 5 AS is_index FROM documents
""")
def page_records(spark, sf_dir):
    """Page records of markdown files (S1's records, K14)."""
    name = F.when(F.length("source") == 4, F.format_string("p%d.md", "doc_id")).when(F.length("source") == 5, F.concat("source", F.lit("/_index.md"))).otherwise(F.format_string("%s/p%d.md", "source", "doc_id"))
    raw = F.when(F.col("lang") == "en", _file()).otherwise(F.col("text"))
    made = content.pages(_docs(spark, sf_dir).select("doc_id", name.alias("rel_path"), raw.alias("raw")))
    return made.select("doc_id", "title", "url", "draft", "tags", "section", "is_index")


@query("""
    SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE 'New' END AS title, '/n/' || doc_id || '/' AS url, ['/old/'] AS aliases, md5(text) AS body FROM documents
""")
def rewritten_front_matter(spark, sf_dir):
    """Address and former addresses written into files; the body stays as it is."""
    raw = F.when(F.col("lang") == "en", F.concat(F.format_string(_TOML, "source", "lang", "doc_id", "lang"), "text")).otherwise(F.col("text"))
    fields = F.struct(F.when(F.col("lang") != "en", "New").alias("title"), F.format_string("/n/%d/", "doc_id").alias("url"), F.array(F.lit("/old/")).alias("aliases"))
    rows = _docs(spark, sf_dir).select("doc_id", content.set_fields(raw, F.to_json(fields)).alias("raw"))
    rows = rows.withColumn("f", content.front_matter(F.col("raw")))
    return rows.select("doc_id", F.get_json_object("f.meta", "$.title").alias("title"), content.field(F.col("raw"), "url").alias("url"), content.aliases(F.col("raw")).alias("aliases"), F.md5(F.col("f.body").cast("binary")).alias("body"))


# ---- markup ----


@query("""
    SELECT page_id, list_sort(['https://h.org/a.png', 'https://h.org/b.png', 'https://h.org/bg.jpg', 'https://h.org/m.png', 'https://h.org/p/rel/', 'http://x.org/' || page_id]) AS links FROM pages
""")
def links_of_all_kinds(spark, sf_dir):
    """Addresses in sources, source sets, styles and meta tags, absolute, without fragments and mail."""
    page = F.format_string(
        '<meta property="og:image" content="/m.png"><meta name="author" content="/none"><img srcset="/a.png 1x, /b.png 2x" src="/a.png#x"><a href="rel/#top">r</a><a href="mailto:a@b.c">m</a>'
        "<div style=\"background: url('/bg.jpg')\"></div><a href=\"http://x.org/%d#f\">x</a>", "page_id"
    )
    return read(spark, sf_dir, "pages").select("page_id", H.links(page, F.lit("https://h.org/p/")).alias("links"))


@query("SELECT doc_id, source || ' & ' || lang AS title FROM documents")
def clean_titles(spark, sf_dir):
    """Titles without tags and entities (C11)."""
    title = F.format_string("<b>%s</b>  &amp;\n<i>%s</i>", "source", "lang")
    return _docs(spark, sf_dir).select("doc_id", H.clean_title(title).alias("title"))


@query("""
    SELECT doc_id, [source || ' and link', lang || ' item'] AS blocks, 'Head ' || source || ' and link ' || lang || ' item' AS text FROM documents
""")
def markdown_paragraphs(spark, sf_dir):
    """Paragraphs and prose of markdown without shortcodes, code and marks (H3, H4, H5)."""
    body = F.format_string("# Head\n\n{{< box >}}\nhidden\n{{< /box >}}\n**%s** and [link](/x)\n\n- %s `code` item\n\n```\ncode\n```\n", "source", "lang")
    rows = _docs(spark, sf_dir).withColumn("p", H.paragraphs(body))
    return rows.select("doc_id", "p.blocks", H.markdown_text(body).alias("text"))


@query("SELECT doc_id, source || ' seen ' || lang AS body FROM documents")
def cleaned_bodies(spark, sf_dir):
    """Markdown cleaned for keywords (H6)."""
    body = F.format_string("## %s {{< a >}}x{{< /a >}} {{< b >}} <em>seen</em> [{ \"k\": 1 }] [%s](/x) `c`", "source", "lang")
    return _docs(spark, sf_dir).select("doc_id", X.clean_body(body).alias("body"))


@query("""
    SELECT doc_id, ['https://i.org/' || source || '.png', 'http://i.org/b.jpg', 'https://i.org/c.webp'] AS images,
           '![x](/l/' || source || '.png) <img src="http://i.org/b.jpg"> {{< c image="https://i.org/c.webp" >}} ![y](/local.png)' AS body FROM documents
""")
def image_addresses(spark, sf_dir):
    """Addresses of images in markdown, markup and shortcodes, and the text with one replaced."""
    body = F.format_string('![x](https://i.org/%s.png) <img src="http://i.org/b.jpg"> {{< c image="https://i.org/c.webp" >}} ![y](/local.png)', "source")
    moved = F.create_map(F.format_string("https://i.org/%s.png", "source"), F.format_string("/l/%s.png", "source"))
    return _docs(spark, sf_dir).select("doc_id", H.image_urls(body).alias("images"), H.rewrite_urls(body, moved).alias("body"))


# ---- site maps, caches, streams ----


@query("""
    SELECT DISTINCT 'https://h.org/' || lang || '/' || source || '/?a=1&b=2' AS loc FROM documents UNION ALL SELECT 'https://h.org/direct/'
""")
def expanded_sitemaps(spark, sf_dir):
    """Addresses of a site map and of those that an index names, each once (S10, S11, SE2)."""
    rows = _docs(spark, sf_dir).select("lang", F.format_string("<url><loc> https://h.org/%s/%s/?a=1&amp;b=2 </loc></url>", "lang", "source").alias("u"))
    maps = rows.groupBy("lang").agg(F.concat_ws("", F.collect_set("u")).alias("xml")).select(F.format_string("https://h.org/%s.xml", "lang").alias("url"), F.concat(F.lit("<urlset>"), "xml", F.lit("</urlset>")).alias("xml"))
    index = maps.agg(F.concat(F.lit("<sitemapindex>"), F.concat_ws("", F.collect_list(F.format_string("<sitemap><loc>%s</loc></sitemap>", "url"))), F.lit("</sitemapindex>")).alias("xml")).select(F.lit("https://h.org/index.xml").alias("url"), "xml")
    direct = spark.createDataFrame([("https://h.org/own.xml", "<urlset><url><loc>https://h.org/direct/</loc></url></urlset>")], "url string, xml string")
    start = spark.createDataFrame([(0, "https://h.org/index.xml"), (1, "https://h.org/own.xml"), (2, "https://h.org/none.xml")], "pos int, url string")
    return tables.expand_sitemaps(maps.union(index).union(direct), start).select("loc")


@query("SELECT DISTINCT lang, ['https://h.org/' || lang || '.xml', 'https://h.org/all.xml'] AS maps FROM documents")
def robots_maps(spark, sf_dir):
    """Site maps that robots texts name."""
    robots = F.format_string("User-agent: *\r\nSitemap: https://h.org/%s.xml\r\nDisallow: /x\nsitemap:https://h.org/all.xml ", "lang")
    return _docs(spark, sf_dir).select("lang").distinct().select("lang", tables.robots_sitemaps(robots).alias("maps"))


@query("""
    WITH d AS (SELECT DISTINCT sha256(text) AS h, length(text) AS n FROM documents) SELECT h AS text_hash, CASE WHEN n % 2 = 0 THEN n * 1.0 END AS first FROM d
""")
def vectors_by_key(spark, sf_dir):
    """Cached vectors of one model for the wanted hashes; misses have none."""
    rows = _docs(spark, sf_dir).select(F.sha2("text", 256).alias("text_hash"), F.length("text").alias("n"))
    cache = rows.where("n % 2 = 0").select(F.lit("m").alias("model"), "text_hash", F.array(F.col("n").cast("double")).alias("vec"))
    other = rows.select(F.lit("o").alias("model"), "text_hash", F.array(F.lit(0.5)).alias("vec"))
    return tables.cached_vectors(cache.union(other), "m", rows).select("text_hash", F.col("vec")[0].alias("first"))


@query("SELECT doc_id AS path, md5(text) AS hash, CASE WHEN n_chars % 2 = 0 THEN n_chars END AS first FROM documents")
def vectors_by_path(spark, sf_dir):
    """Vectors kept by path, valid while the content's hash is the same."""
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("path"), F.md5(F.col("text").cast("binary")).alias("hash"), "n_chars")
    cache = rows.select("path", F.when(F.col("n_chars") % 2 == 0, F.col("hash")).otherwise("old").alias("hash"), F.array("n_chars").alias("vec"))
    return tables.path_cache(rows, cache).select("path", "hash", F.col("vec")[0].alias("first"))


@query("SELECT max(ts) + INTERVAL 1 MICROSECOND AS cursor FROM events")
def poll_cursor(spark, sf_dir):
    """Where the next poll begins (ST1)."""
    from corpusloom.streaming.events import next_cursor

    return next_cursor(read(spark, sf_dir, "events"))


# ---- links, names and clusters ----


@query("""
    WITH r AS (SELECT doc_id, source, lower(lang) AS text, lang AS target_url, n_chars % 50 AS lift, length(text) AS score FROM documents)
    SELECT source, target_url, max(lift) AS lift, arg_max(score, lift * 1000000 + score) AS anchor_score FROM r GROUP BY source, target_url
""")
def kept_recommendations(spark, sf_dir):
    """Of equal anchors to one address the one of highest lift, then score."""
    rows = _docs(spark, sf_dir).select("source", F.when(F.col("doc_id") > 5, F.upper("lang")).otherwise(F.col("lang")).alias("text"), F.col("lang").alias("target_url"), (F.col("n_chars") % 50).alias("lift"), F.length("text").alias("anchor_score"))
    return linking.distinct_links(rows).select("source", "target_url", "lift", "anchor_score")


@query("""
    WITH p AS (SELECT DISTINCT '/' || lang || '/' || source || '/' AS url FROM documents)
    SELECT url, CASE WHEN contains(url, '/de/') THEN 3.0 WHEN contains(url, '/en/') THEN 2.5 ELSE 1.0 END AS weight FROM p
""")
def preferred_pages(spark, sf_dir):
    """Preferred targets by file, else by address, the largest weight each."""
    pages = _docs(spark, sf_dir).select(F.format_string("%s/%s.md", "lang", "source").alias("rel_path"), F.format_string("/%s/%s/", "lang", "source").alias("url")).distinct()
    base = pages.withColumn("pos", F.xxhash64("url"))
    by_file = base.where("url LIKE '/en/%'").select("pos", F.col("rel_path").alias("file"), F.lit("").alias("url"), F.lit("2.5").alias("weight"))
    by_url = base.select("pos", F.lit("none.md").alias("file"), F.rtrim(F.col("url"), F.lit("/")).alias("url"), F.when(F.col("url").contains("/de/"), "3").otherwise("much").alias("weight"))
    missing = spark.createDataFrame([(1, "gone.md", "/gone/", "9")], "pos long, file string, url string, weight string")
    return linking.preferred_targets(by_file.union(by_url).union(missing), pages, 1_000_000).select("url", "weight")


@query("""
    SELECT DISTINCT lang || 'x' AS word FROM documents WHERE lang <> 'de' UNION SELECT DISTINCT source FROM documents WHERE length(source) = 5 UNION SELECT 'acme'
""")
def product_words(spark, sf_dir):
    """Product names in English file names."""
    docs = _docs(spark, sf_dir)
    named = docs.where("lang <> 'de'").select(F.lit("en").alias("lang"), F.format_string("integrations/%sx-api.md", "lang").alias("rel_path"))
    versus = docs.where("length(source) = 5").select(F.lit("en").alias("lang"), F.concat("source", F.lit("-alternative.md")).alias("rel_path"))
    other = docs.select("lang", F.lit("blog/none-of-it.md").alias("rel_path")).union(docs.select(F.lit("de").alias("lang"), F.lit("integrations/kein.md").alias("rel_path")))
    return S.brand_words(named.union(versus).union(other), ["integrations"], ["-alternative"], ["Acme"])


@query("""
    WITH p AS (SELECT DISTINCT source AS s, lang FROM documents WHERE lang <> 'en')
    SELECT s || '.md' AS rel_path, lang, '/' || lang || '/' || CASE WHEN lang = 'de' THEN 'neu-' || s ELSE s END || '/' AS url,
           CASE lang WHEN 'de' THEN 'translated slug' WHEN 'es' THEN 'language "es" keeps the english slug' ELSE 'flow returned the english slug unchanged' END AS reason FROM p
""")
def resolved_addresses(spark, sf_dir):
    """Addresses of translated pages: translated slug, kept English one, unchanged one."""
    pages = _docs(spark, sf_dir).where("lang <> 'en'").select("source", "lang").distinct()
    translated = F.when(F.col("lang") == "de", F.concat(F.lit("/neu-"), "source", F.lit("/"))).otherwise(F.concat(F.lit("/"), "source", F.lit("/")))
    rows = pages.select(F.concat("source", F.lit(".md")).alias("rel_path"), "lang", F.concat(F.lit("/"), "source", F.lit("/")).alias("en_url"), translated.alias("translated_url"), F.lit(None).cast("string").alias("section_prefix"))
    none = spark.createDataFrame([], "lang string, address string, owner string")
    history = spark.createDataFrame([], "rel_path string, lang string, previous string")
    return sync.resolve_urls(rows, none, history, spark.createDataFrame([("acme",)], "word string"), [], ["es"]).select("rel_path", "lang", "url", "reason")


@query("SELECT label % 3 AS cluster, label AS section, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rank FROM embeddings")
def cluster_sections(spark, sf_dir):
    """Pages of each cluster by section, in order of title."""
    rows = read(spark, sf_dir, "embeddings")
    clusters = rows.select(F.col("vec_id").alias("id"), (F.col("label") % 3).alias("cluster"))
    pages = rows.select(F.col("vec_id").alias("id"), F.col("label").alias("section"), F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("title"))
    return cluster.subclusters(clusters, pages, Scratch(spark, "sections")).select("cluster", "section", "id", "rank")


@query("""
    WITH c AS (SELECT source, lang || ' page' AS phrase, count(*) AS n FROM documents GROUP BY source, lang), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, phrase) AS rank FROM c)
    SELECT source, upper(left(phrase, 1)) || substr(phrase, 2, 1) || ' Page' AS name FROM r WHERE rank = 1
""")
def cluster_names(spark, sf_dir):
    """Names of groups by their first keyword."""
    from pyspark.sql import Window

    counted = _docs(spark, sf_dir).groupBy("source", F.concat("lang", F.lit(" page")).alias("phrase")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy(F.col("n").desc(), "phrase")
    return keywords.group_names(counted.withColumn("rank", F.row_number().over(order)), "source")


@query("""
    SELECT '/' || lang || '/* /' || source || '/:splat 301' AS line, '{"source":"/' || lang || '/<*>","target":"/' || source || '/<*>","status":"301"}' AS json FROM documents
""")
def redirect_file(spark, sf_dir):
    """Lines and JSON of a redirects file."""
    rows = _docs(spark, sf_dir).select(F.format_string("/%s/*", "lang").alias("source"), F.format_string("/%s/:splat", "source").alias("target"), F.lit("301").alias("status"))
    return sinks.redirect_lines(rows)
