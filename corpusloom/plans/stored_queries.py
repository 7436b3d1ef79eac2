"""Named queries whose results go through files: published reports, trees of files, archives, a polled stream; and their SQL.

Everything is written below the scratch folder of the run and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import audit, sync, vector
from corpusloom.plans.queries import ORACLES as OTHER
from corpusloom.plans.queries import page_vectors, read, six
from corpusloom.plans.scratch import Scratch
from corpusloom.sources import content, npz, sinks, stores, tables
from corpusloom.sources.published import publish, read_published

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


def _through(rows, name: str, kind: str, by: list[str] | None = None, order: list[str] | None = None):
    """The rows, published and read again."""
    spark = rows.sparkSession
    scratch = Scratch(spark, name)
    publish(scratch.table(rows, "rows"), f"{scratch.root}/published", kind, by, order)
    return read_published(spark, f"{scratch.root}/published")


# ---- published results ----


@query(f"SELECT e.label AS section, r.a AS slug, r.rank, r.b AS related, r.sim FROM ({OTHER['related_top3']}) r JOIN embeddings e ON e.vec_id = r.a")
def related_files(spark, sf_dir):
    """Related pages as JSON, a folder a section, published whole and read back (K1)."""
    rows = page_vectors(spark, sf_dir).withColumns({"path": F.col("id").cast("string"), "is_index": F.lit(False)})
    near = vector.related(rows.withColumn("section", F.col("section").cast("string")))
    own = rows.select(F.col("id").alias("a"), "section")
    out = near.join(own, "a").select("section", F.col("a").alias("slug"), "rank", F.col("b").alias("related"), six("sim").alias("sim"))
    return _through(out, "related", "json", ["section"], ["slug", "rank"])


@query(OTHER["section_focus_report"])
def focus_csv(spark, sf_dir):
    """The focus report as CSV with a header (K4)."""
    report = audit.section_report(audit.with_drift(page_vectors(spark, sf_dir)))
    return _through(report.select("section", *[six(c).alias(c) for c in ("focus", "radius", "mean_dist", "p95_dist", "max_dist")], "n_pages"), "focus", "csv")


@query(OTHER["site_focus_report"])
def metrics_json(spark, sf_dir):
    """Metrics of the site as JSON (K5)."""
    report = audit.site_report(audit.with_drift(page_vectors(spark, sf_dir)))
    return _through(report.select(*[six(c).alias(c) for c in ("focus", "radius", "mean_dist", "p95_dist", "max_dist")], "n_pages", "n_sections"), "metrics", "json")


@query("""
    SELECT 'dir' || q.conv_id % 7 AS folder, q.conv_id AS file, trim(q.text) || ' ' || trim(a.text) AS text
    FROM conversations q JOIN conversations a USING (conv_id) WHERE a.turn = q.turn + 1 AND q.role = 'user' AND trim(q.text) <> '' AND trim(a.text) <> ''
""")
def faq_files(spark, sf_dir):
    """Questions and answers as CSV, a folder a directory, quotes and line breaks kept."""
    rows = read(spark, sf_dir, "conversations")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = rows.where("role = 'user'").join(after, ["conv_id", "turn"])
    faq = sync.faq_rows(pairs.select(F.col("conv_id").alias("file"), F.array(F.struct(F.col("text").alias("question"), "answer")).alias("faq")))
    return _through(faq.select(F.concat(F.lit("dir"), (F.col("file") % 7).cast("string")).alias("folder"), "file", "text"), "faq", "csv", ["folder"], ["file"])


@query("""
    WITH m AS (SELECT source, lang, CAST(min(doc_id) AS VARCHAR) AS url FROM documents GROUP BY source, lang)
    SELECT replace(source, '-', '_') AS folder, lang, url FROM m
""")
def folder_files(spark, sf_dir):
    """Addresses of all languages as JSON, a folder a content folder, hyphens as underscores."""
    rows = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.min("doc_id").cast("string").alias("url"))
    return _through(rows.select(F.translate("source", "-", "_").alias("folder"), "lang", "url"), "folders", "json", ["folder"], ["lang"])


@query("""
    WITH o AS (SELECT DISTINCT url, 200 AS status FROM pages), n AS (SELECT DISTINCT url, 404 AS status FROM pages WHERE length(url) % 3 = 0)
    SELECT o.url, coalesce(n.status, o.status) AS status, n.url IS NOT NULL AS again FROM o LEFT JOIN n ON o.url = n.url
""")
def status_cache(spark, sf_dir):
    """States of addresses kept as a published table: new ones take the place of old ones, and a run without any leaves it."""
    scratch = Scratch(spark, "status")
    root = f"{scratch.root}/cache"
    urls = read(spark, sf_dir, "pages").select("url").distinct()
    publish(scratch.table(urls.select("url", F.lit(200).alias("status"), F.lit(False).alias("again")), "first"), root, "parquet")
    new = urls.where(F.length("url") % 3 == 0).select("url", F.lit(404).alias("status"), F.lit(True).alias("again"))
    for _ in range(2):
        publish(scratch.table(sinks.upsert(read_published(spark, root), new, ["url"]), "next"), root, "parquet")
    return read_published(spark, root)


@query("""
    WITH r AS (SELECT doc_id AS pos, 'https://h/' || CASE WHEN lang = 'en' THEN 'football' ELSE 'x' END || '/' || doc_id || '?a=1&b=2' AS loc, CASE WHEN lang = 'en' THEN 'football' ELSE 'general' END AS section, '2025-01-0' || (1 + n_chars % 9) AS lastmod FROM documents),
    k AS (SELECT *, (row_number() OVER (PARTITION BY section ORDER BY pos) - 1) // 50 AS chunk FROM r)
    SELECT section, CAST(chunk AS INT) AS chunk, loc, lastmod FROM k
""")
def sitemap_documents(spark, sf_dir):
    """Site map files of fifty addresses as XML, written and read back (K9)."""
    from corpusloom.operators import crawl

    scratch = Scratch(spark, "sitemap")
    day = F.concat(F.lit("2025-01-0"), (F.col("n_chars") % 9 + 1).cast("string"))
    loc = F.concat(F.lit("https://h/"), F.when(F.col("lang") == "en", "football").otherwise("x"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("?a=1&b=2"))
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), loc.alias("loc"), day.alias("lastmod"))
    sinks.sitemap_files(crawl.split_sitemap(rows, 50), f"{scratch.root}/files")
    lines = spark.read.text(f"{scratch.root}/files").where(F.col("value").contains("<url>"))
    part = lambda tag: F.replace(F.regexp_extract("value", f"<{tag}>([^<]*)</{tag}>", 1), F.lit("&amp;"), F.lit("&"))
    return lines.select("section", F.col("chunk").cast("int").alias("chunk"), part("loc").alias("loc"), part("lastmod").alias("lastmod"))


# ---- files as sources ----


def _tree(rows, name: str) -> tuple[str, Scratch]:
    """Writes a file a row (inside, text); gives their root."""
    scratch = Scratch(rows.sparkSession, name)
    root = f"{scratch.root}/files"
    scratch.table(stores.write_texts(rows, root), "written")
    return root, scratch


@query("SELECT lang, source || '/_' || doc_id || '.md' AS rel_path, md5(text) AS body FROM documents WHERE lang IN ('de', 'fr')")
def site_files(spark, sf_dir):
    """All documents as a tree of markdown files; those of two languages listed by tasks and read back."""
    rows = read(spark, sf_dir, "documents")
    root, scratch = _tree(rows.select(F.concat_ws("/", "lang", "source", F.concat(F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("inside"), "text"), "site")
    files = content.read_markdown(spark, root, scratch, ["de", "fr"])
    return files.select("lang", "rel_path", F.md5(F.col("raw").cast("binary")).alias("body"))


@query("SELECT lang || '/' || source || '.md' AS inside, CAST(sum(n_chars) AS VARCHAR) AS raw FROM documents WHERE lang <> 'en' GROUP BY lang, source")
def changed_files(spark, sf_dir):
    """Files written after a moment, listed and read without the older ones (S19, ST5)."""
    import datetime
    import time

    rows = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum("n_chars").cast("string").alias("text"))
    files = rows.select("lang", F.concat("lang", F.lit("/"), "source", F.lit(".md")).alias("inside"), "text")
    root, scratch = _tree(files, "changed")
    time.sleep(1.1)
    moment = datetime.datetime.now(datetime.UTC)
    time.sleep(1.1)
    scratch.table(stores.write_texts(files.where("lang <> 'en'"), root), "again")
    found = content.read_markdown(spark, root, scratch, since=moment)
    return found.select(F.concat("lang", F.lit("/"), "rel_path").alias("inside"), "raw")


@query("""
    WITH t AS (SELECT DISTINCT source || ', ' || lang AS flow_input, source || '-' || lang AS filename FROM documents)
    SELECT 'csv' AS kind, flow_input, filename FROM t UNION ALL SELECT 'text', flow_input, replace(flow_input, ', ', '-') FROM t
""")
def topic_files(spark, sf_dir):
    """Topics from a CSV whose delimiter is found, and from a text file."""
    rows = read(spark, sf_dir, "documents").select(F.concat("source", F.lit(", "), "lang").alias("flow_input"), F.concat("source", F.lit("-"), "lang").alias("filename")).distinct()
    scratch = Scratch(spark, "topics")
    rows.write.option("header", "true").option("sep", ";").csv(f"{scratch.root}/topics.csv")
    rows.select(F.concat(F.lit("  "), "flow_input")).write.text(f"{scratch.root}/topics.txt")
    both = [tables.read_topics(spark, f"{scratch.root}/topics.{end}").select(F.lit(kind).alias("kind"), "flow_input", "filename") for end, kind in (("csv", "csv"), ("txt", "text"))]
    return both[0].unionByName(both[1])


@query("SELECT lang, source AS key, 'n: ' || count(*) AS value FROM documents GROUP BY lang, source")
def yaml_files(spark, sf_dir):
    """Keys of YAML files named after their language."""
    rows = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    line = F.format_string('%s: "n: %d"', "source", "n")
    # as many lines a file as a language has sources
    files = rows.groupBy("lang").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    root, _ = _tree(files.select(F.concat("lang", F.lit(".yaml")).alias("inside"), "text"), "yaml")
    return tables.read_yaml_keys(spark, root)


@query("SELECT lang || '/' || doc_id || '.PNG' AS name, octet_length(encode(text)) AS length, sha256(text) AS digest FROM documents WHERE lang = 'es'")
def image_files(spark, sf_dir):
    """Image files of a tree by ending, processed copies passed over."""
    end = F.when(F.col("lang") == "es", ".PNG").when(F.col("lang") == "de", ".txt").otherwise(".jpg")
    folder = F.when(F.col("lang") == "fr", "processed").otherwise(F.when(F.col("lang") == "en", "processed/en").otherwise(F.col("lang")))
    root, _ = _tree(read(spark, sf_dir, "documents").select(F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), end).alias("inside"), "text"), "images")
    found = tables.read_images(spark, root)
    return found.select(F.regexp_extract("path", r"/files/(.*)\z", 1).alias("name"), "length", "digest")


@query("SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 6)) AS vec FROM embeddings")
def npz_vectors(spark, sf_dir):
    """All vectors written as npz archives and read back by ranges of rows."""
    scratch = Scratch(spark, "npz")
    written = scratch.table(npz.write_npz(page_vectors(spark, sf_dir), f"{scratch.root}/archives", 700), "written")
    found = npz.read_npz(written, f"{scratch.root}/archives", 300)
    return found.select("id", F.transform(V.doubles(F.col("vec")), lambda x: V.rounded(x)).alias("vec"))


@query("SELECT event_id, ts, event_type, round(value, 4) AS value FROM events")
def drained_events(spark, sf_dir):
    """The table of events drained by a polled source in steps of ten days, whose cursor moves after each batch (ST1)."""
    from corpusloom.streaming.polled import polled

    scratch = Scratch(spark, "drained")
    path = f"{sf_dir}/events.parquet"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    stream = polled(spark, path, schema, f"{scratch.root}/progress", step_seconds=10 * 86_400)
    drain = stream.writeStream.format("parquet").option("checkpointLocation", f"{scratch.root}/checkpoint").start(f"{scratch.root}/events")
    try:
        drain.processAllAvailable()
    finally:
        drain.stop()
    out = spark.read.schema(schema).parquet(f"{scratch.root}/events")
    return out.select("event_id", "ts", "event_type", F.round("value", 4).alias("value"))
