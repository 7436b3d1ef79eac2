"""Queries over a site's pages, lookups, values and addresses, and the SQL that gives the same rows.

The test tables stand for a site: documents for pages (lang and source as language and
section), pages for fetched HTML, conversations for questions and answers. Where an operator
needs markup, titles or states that the tables lack, they are made from the columns, alike in both.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import text as X
from corpusloom.functions import urls as U
from corpusloom.functions import values as W
from corpusloom.functions import vectors as V
from corpusloom.operators import crawl, linking, site, sync, vector
from corpusloom.plans.queries import read, six
from corpusloom.plans.scratch import Scratch

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


def _entries(column) -> F.Column:
    """Entries of a map of texts as sorted ``key=value``."""
    return F.array_sort(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"])))


# ---- pages and lookups ----


@query("SELECT doc_id, source || '/' || doc_id || '.md' AS rel_path FROM documents WHERE source NOT IN ('src1', 'src2')")
def excluded_sections(spark, sf_dir):
    """Pages outside of excluded sections (F1)."""
    return site.without_excluded(_docs(spark, sf_dir).select("doc_id", F.format_string("%s/%d.md", "source", "doc_id").alias("rel_path")), ["src1", "src2/"])


_TITLED = "SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN '  ' ELSE lang END AS title, CASE WHEN n_chars % 2 = 0 THEN NULL ELSE source END AS description FROM documents"


@query(f"WITH t AS ({_TITLED}) SELECT doc_id, trim(title) <> '' AS titled FROM t WHERE trim(title) <> '' OR trim(coalesce(description, '')) <> ''")
def titled_pages(spark, sf_dir):
    """Pages with a title or a description, and whether they have the first (F2)."""
    rows = _docs(spark, sf_dir).select("doc_id", F.when(F.col("n_chars") % 3 == 0, "  ").otherwise(F.col("lang")).alias("title"), F.when(F.col("n_chars") % 2 == 0, F.lit(None)).otherwise(F.col("source")).alias("description"))
    with_title = site.titled(rows).select("doc_id", F.lit(True).alias("titled"))
    return site.titled(rows, or_described=True).join(with_title, "doc_id", "left").select("doc_id", F.coalesce("titled", F.lit(False)).alias("titled"))


@query("SELECT doc_id AS path FROM documents WHERE lang = 'en' ORDER BY CASE WHEN n_chars % 4 = 0 THEN 2147483647 ELSE n_chars % 4 END, n_chars DESC, source, doc_id LIMIT 10")
def latest_posts(spark, sf_dir):
    """The ten first pages of a type, a top-k report."""
    rows = _docs(spark, sf_dir).select(F.col("lang").alias("type"), (F.col("n_chars") % 4).cast("int").alias("weight"), F.col("n_chars").alias("date"), F.col("source").alias("title"), F.col("doc_id").alias("path"))
    return site.latest(rows, "en", 10).select("path")


@query("SELECT page_id AS path, length(html) % 3 = 0 AS video FROM pages")
def video_pages(spark, sf_dir):
    """Pages that carry a mark of a video."""
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.when(F.length("html") % 3 == 0, F.concat("html", F.lit("<i data-video-id='1'>"))).otherwise(F.col("html")).alias("content"))
    return site.needs_video(rows, spark.createDataFrame([("data-menu",), (None,)], "data_attr string"))


@query("""
    WITH a AS (SELECT DISTINCT source, upper(source) AS name, CASE WHEN length(source) = 4 THEN ' ' ELSE 'editor' END AS role FROM documents)
    SELECT d.doc_id, a.name, a.role FROM documents d LEFT JOIN a ON a.source = d.source AND trim(a.role) <> ''
""")
def page_authors(spark, sf_dir):
    """Pages with their author, where one with a role is known."""
    docs = _docs(spark, sf_dir)
    role = F.when(F.length("source") == 4, " ").otherwise("editor")
    authors = docs.select("source").distinct().select(F.concat(F.lit("author/"), "source").alias("path"), F.upper("source").alias("title"), role.alias("role"), F.lit(None).cast("string").alias("image"), F.lit("").alias("description"))
    return site.with_author(docs.select("doc_id", F.col("source").alias("author")), authors).select("doc_id", "by.name", "by.role")


@query("""
    WITH d AS (SELECT lang, source, CAST(min(n_chars) AS VARCHAR) AS n FROM documents WHERE lang <> 'fr' GROUP BY lang, source)
    SELECT f.lang || '-pages' AS folder, coalesce((SELECT list_sort(list(source || '=' || n)) FROM d WHERE d.lang = f.lang), []) AS urls FROM (SELECT DISTINCT lang FROM documents) f
""")
def folder_translation_maps(spark, sf_dir):
    """The address map of each folder, empty where its data file is missing."""
    docs = _docs(spark, sf_dir)
    one = docs.where("lang <> 'fr'").groupBy("lang", "source").agg(F.min("n_chars").cast("string").alias("n"))
    data = one.groupBy(F.concat("lang", F.lit("_pages")).alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("urls"))
    folders = docs.select(F.concat("lang", F.lit("-pages")).alias("folder")).distinct()
    return site.folder_translations(folders, data).select("folder", _entries(F.col("urls")).alias("urls"))


@query("""
    SELECT '/' || lang || '/' || source || '/' || doc_id || '/' AS url, 'Start > ' || upper(lang) || ' > ' || doc_id AS names, 3 AS n FROM documents
    UNION ALL SELECT DISTINCT '/' || lang || '/', 'Start > ' || upper(lang), 2 FROM documents UNION ALL SELECT '/', 'Start', 1
""")
def breadcrumb_chains(spark, sf_dir):
    """Home, existing ancestors and the page itself (J17); a folder without a page is left out."""
    docs = _docs(spark, sf_dir)
    leaves = docs.select(F.format_string("/%s/%s/%d/", "lang", "source", "doc_id").alias("url"), F.col("doc_id").cast("string").alias("title"))
    tops = docs.select(F.format_string("/%s/", "lang").alias("url"), F.upper("lang").alias("title")).distinct()
    rows = leaves.union(tops).union(spark.createDataFrame([("/", "Home page")], "url string, title string"))
    return site.breadcrumbs(rows, "Start").select("url", F.array_join(F.transform("crumbs", lambda c: c["name"]), " > ").alias("names"), F.size("crumbs").alias("n"))


@query("""
    WITH t AS (SELECT doc_id, 0 AS position, source AS term FROM documents UNION ALL SELECT doc_id, 1, lang FROM documents)
    SELECT doc_id AS path, CAST(position AS INT) AS position, term, upper(term) AS title FROM t WHERE term <> 'src3'
""")
def terms_of_pages(spark, sf_dir):
    """Terms of each page, in its order, that the taxonomy knows."""
    docs = _docs(spark, sf_dir)
    names = docs.select(F.explode(F.array("source", "lang")).alias("term")).distinct().where("term <> 'src3'")
    terms = names.select(F.lit("tags").alias("taxonomy"), "term", F.upper("term").alias("title"), F.format_string("/tags/%s/", "term").alias("url"))
    pages = docs.select(F.col("doc_id").alias("path"), F.array("source", F.concat(F.lit(" "), F.upper("lang")), "lang", F.lit("")).alias("tags"))
    return site.page_terms(pages, terms, "tags").select("path", "position", "term", "title")


@query("""
    SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' END AS name,
           CASE lang WHEN 'en' THEN 'Englisch' ELSE upper(lang) END AS own, source AS unknown FROM documents
""")
def language_names(spark, sf_dir):
    """Names of languages, of a site's own list, and of a code without a name."""
    return _docs(spark, sf_dir).select("doc_id", site.language_name(F.upper("lang")).alias("name"), site.language_name(F.col("lang"), {"en": "Englisch"}, upper=True).alias("own"), site.language_name(F.col("source")).alias("unknown"))


@query("""
    SELECT doc_id, length(source) = 5 OR lang = 'de' AS found,
           CASE WHEN length(source) = 5 THEN 'static/images/' || source || lang || '.png' WHEN lang = 'de' THEN 'cdn-assets/' || source || lang || '.png' ELSE '' END AS actual FROM documents
""")
def asset_lookup(spark, sf_dir):
    """Where a file lies: among static files first, then among those of the content network."""
    docs = _docs(spark, sf_dir)
    name = F.concat("source", "lang", F.lit(".png"))
    static = docs.where(F.length("source") == 5).select(F.concat(F.lit("static/images/"), name).alias("name"))
    files = static.union(docs.where("lang = 'de'").select(F.concat(F.lit("cdn-assets/"), name))).distinct()
    wanted = docs.select(F.concat(F.lit("/images/"), name).alias("path")).distinct()
    found = site.asset_paths(wanted, files)
    return docs.withColumn("path", F.concat(F.lit("/images/"), name)).join(found, "path").select("doc_id", "found", "actual")


@query("""
    SELECT d.doc_id, m.lang AS name, '/' || m.lang || '/' AS url, d.lang = m.lang AS active FROM documents d CROSS JOIN (SELECT DISTINCT lang FROM documents) m
""")
def menu_states(spark, sf_dir):
    """Entries of the main menu on each page, and which is the page's own."""
    docs = _docs(spark, sf_dir)
    menus = docs.select("lang").distinct().select(F.lit("main").alias("menu"), F.lit(1).alias("weight"), F.col("lang").alias("name"), F.format_string("/%s/", "lang").alias("url"))
    other = spark.createDataFrame([("footer", 1, "x", "/x/")], "menu string, weight int, name string, url string")
    paths = docs.select(F.format_string("/%s/", "lang").alias("path")).distinct()
    states = site.menu_entries(paths, menus.union(other), "main")
    return docs.withColumn("path", F.format_string("/%s/", "lang")).join(states, "path").select("doc_id", "name", "url", "active")


@query("""
    WITH u AS (SELECT conv_id, list(md5(text) ORDER BY turn) AS q FROM conversations WHERE role = 'user' AND length(text) % 2 = 0 GROUP BY conv_id)
    SELECT c.conv_id AS path, coalesce(u.q, ['own']) AS questions FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN u USING (conv_id)
""")
def page_questions(spark, sf_dir):
    """Questions shown on a page, or its own where none is shown."""
    rows = read(spark, sf_dir, "conversations")
    shown = rows.where("role = 'user' AND length(text) % 2 = 0").select(F.col("conv_id").alias("path"), F.col("turn").alias("position"), F.md5(F.col("text").cast("binary")).alias("question"), F.lit("a").alias("answer"))
    own = F.array(F.struct(F.lit("own").alias("question"), F.lit("b").alias("answer")))
    found = site.page_faqs(rows.select(F.col("conv_id").alias("path")).distinct().withColumn("faq", own), shown)
    return found.select("path", F.transform("faq", lambda q: q["question"]).alias("questions"))


_SAME = """
    v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    p AS (SELECT a.label AS g, a.id AS a, b.id AS b, list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) AS sim FROM v a JOIN v b ON a.label = b.label AND a.id < b.id),
    s AS (SELECT * FROM p WHERE sim >= 0.3)
"""


@query(f"""
    WITH {_SAME}, c AS (SELECT g, count(*) AS n, max(sim) AS most FROM s GROUP BY g),
    r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY sim DESC, a, b) AS k FROM s), m AS (SELECT label AS g, count(*) AS n FROM v GROUP BY label)
    SELECT c.g AS group_id, 0 AS part, 0 AS rank, m.n || ' pages | ' || printf('%.1f%%', most * 100) || ' max | Sections: ' || CASE WHEN c.g = 0 THEN 'root' ELSE 's' || c.g END AS line FROM c JOIN m ON c.g = m.g
    UNION ALL SELECT c.g, 1, id, '[' || CASE WHEN c.g = 0 THEN '' ELSE 's' || c.g END || '] /' || id || '/ | t' FROM c JOIN v ON v.label = c.g
    UNION ALL SELECT g, 2, k, printf('%.1f%%', sim * 100) || ': /' || a || '/ <-> /' || b || '/' FROM r WHERE k <= 10
    UNION ALL SELECT g, 3, 0, '... and ' || (n - 10) || ' more pairs' FROM c WHERE n > 10
""")
def similarity_report(spark, sf_dir):
    """Lines of the report of similar pages, with the first ten pairs of each group (K6)."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("group_id"), F.col("embedding").alias("vec"))
    counts, best = vector.pair_summary(rows, 0.3, "group_id", 10)
    section = F.when(F.col("group_id") == 0, "").otherwise(F.concat(F.lit("s"), F.col("group_id").cast("string")))
    members = rows.select("group_id", "id", section.alias("section"), F.format_string("/%d/", "id").alias("url"), F.lit("t").alias("title"))
    return site.similarity_lines(members, counts, best)


@query("SELECT doc_id AS source FROM documents ORDER BY n_chars % 100 DESC, length(source) DESC, doc_id LIMIT 10")
def top_links(spark, sf_dir):
    """The ten recommendations of highest lift, a top-k report."""
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("source"), F.lit(0).alias("paragraph_index"), (F.col("n_chars") % 100).alias("lift"), F.length("source").alias("anchor_score"))
    return site.top_recommendations(rows, 10).select("source")


# ---- values ----


@query("""
    SELECT doc_id, upper(left(lang || ' page', 1)) || substr(lang || ' page', 2) AS human, CASE WHEN starts_with(source, 'src') THEN substr(source, 4) ELSE source END AS bare,
           regexp_replace(source, '[0-9]+', '#', 'g') AS replaced, contains(text, ' the ') OR contains(text, ' der ') AS known FROM documents
""")
def template_strings(spark, sf_dir):
    """String helpers of templates."""
    return _docs(spark, sf_dir).select(
        "doc_id", W.humanize(F.concat("lang", F.lit("_page"))).alias("human"), W.trim_prefix(F.col("source"), "src").alias("bare"), W.replace_pattern(F.col("source"), "[0-9]+", "#").alias("replaced"), W.any_in(F.col("text"), [" the ", " der "]).alias("known")
    )


@query("SELECT doc_id, CASE WHEN n_chars % 4 = 0 THEN -1 ELSE n_chars % 4 END AS number, CASE WHEN lang = 'en' THEN 'none' ELSE lang END AS word, CASE WHEN lang = 'de' THEN 'd' ELSE 'e' END AS filled FROM documents")
def template_defaults(spark, sf_dir):
    """Defaults for zero, empty text and empty lists."""
    docs = _docs(spark, sf_dir)
    word = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    items = F.when(F.col("lang") == "de", F.array(F.lit("d"))).otherwise(F.array().cast("array<string>"))
    return docs.select("doc_id", X.default(F.col("n_chars") % 4, F.lit(-1)).cast("long").alias("number"), X.default(word, F.lit("none")).alias("word"), X.default(items, F.array(F.lit("e")))[0].alias("filled"))


def _json():
    pair = F.array(F.struct(F.col("lang").alias("src"), F.lit(1).alias("n")), F.struct(F.lit(None).cast("string").alias("src"), F.lit(2).alias("n")), F.struct(F.col("source").alias("src"), F.lit(3).alias("n")))
    return F.to_json(F.struct(F.struct(F.col("lang").alias("image"), F.col("n_chars").alias("n")).alias("content"), F.struct(pair.alias("images")).alias("gallery")))


@query("SELECT doc_id, [lang] AS image, [CAST(n_chars AS VARCHAR)] AS n, [lang, source] AS srcs, NULL::VARCHAR[] AS none FROM documents")
def nested_values(spark, sf_dir):
    """Nested attributes by path, of lists too (R2)."""
    rows = _docs(spark, sf_dir).select("doc_id", _json().alias("j"))
    get = lambda path: W.nested_get(F.col("j"), path)
    return rows.select("doc_id", get("content.image").alias("image"), get("content.n").alias("n"), get("gallery.images[].src").alias("srcs"), get("gallery.none[].src").alias("none"))


@query("SELECT doc_id, ['new'] AS image, [lang, 'late'] AS srcs, [lang, source] AS kept, [source] AS made FROM documents")
def nested_updates(spark, sf_dir):
    """Nested attributes set by path (R2)."""
    j = F.col("j")
    rows = _docs(spark, sf_dir).select("doc_id", "source", _json().alias("j"))
    put = lambda path, new, index=None: W.nested_set(j, path, new, index)
    return rows.select(
        "doc_id", W.nested_get(put("content.image", F.lit("new")), "content.image").alias("image"), W.nested_get(put("gallery.images[].src", F.lit("late"), 2), "gallery.images[].src").alias("srcs"),
        W.nested_get(put("gallery.images[].src", F.lit("out"), 9), "gallery.images[].src").alias("kept"), W.nested_get(put("meta.by.name", F.col("source")), "meta.by.name").alias("made"),
    )


@query("""
    SELECT doc_id, ['lang=' || lang, 'n=1', 'source=x'] AS merged, ['lang=' || lang, 'source=' || source] AS kept, [lang, source, 'end'] AS items, source AS second, NULL::VARCHAR AS beyond FROM documents
""")
def maps_and_lists(spark, sf_dir):
    """Maps merged and cut to a list of names, lists appended to and indexed."""
    attributes = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("n"), F.lit("1"))
    items = W.appended(F.array("lang", "source"), F.lit("end"))
    return _docs(spark, sf_dir).select(
        "doc_id", _entries(W.merged(attributes, F.create_map(F.lit("source"), F.lit("x")))).alias("merged"), _entries(W.subset(attributes, ["lang", "source", "none"])).alias("kept"),
        items.alias("items"), W.item(items, 1).alias("second"), W.item(items, 7).alias("beyond"),
    )


@query("""SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, '{"type":"' || event_type || '","k":' || (props->>'$.k') || '}' AS json FROM events""")
def parameters(spark, sf_dir):
    """JSON parameters read and written."""
    rows = read(spark, sf_dir, "events").withColumn("p", W.parsed(F.col("props"), "k long"))
    return rows.select("event_id", F.col("p.k").alias("k"), W.jsonified(F.struct(F.col("event_type").alias("type"), F.col("p.k").alias("k"))).alias("json"))


@query("""
    SELECT o_orderkey, strftime(o_orderdate, '%b %-d, %Y') AS short, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%A, %B %-d %Y') END AS own,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' AS stamp FROM orders
""")
def formatted_dates(spark, sf_dir):
    """Dates by a layout, by a language's own, and as a stamp."""
    date = F.col("o_orderdate").cast("timestamp")
    own = W.format_date(date, {"F": "02.01.2006"}, F.col("o_orderstatus"), "Monday, January 2 2006")
    return read(spark, sf_dir, "orders").select("o_orderkey", W.format_date(date).alias("short"), own.alias("own"), W.iso_stamp(W.default_date(date)).alias("stamp"))


@query("SELECT doc_id, lang IN ('de', 'es') AS wrong FROM documents")
def front_matter_problems(spark, sf_dir):
    """Files whose front matter does not parse or is missing."""
    raw = (
        F.when(F.col("lang") == "de", F.concat(F.lit('+++\ntitle = "a" "b"\n+++\n'), "text"))
        .when(F.col("lang") == "es", F.col("text"))
        .otherwise(F.concat(F.lit('+++\ntitle = "'), "source", F.lit('"\n+++\n'), "text"))
    )
    return _docs(spark, sf_dir).select("doc_id", W.front_matter_problem(raw, required=True).isNotNull().alias("wrong"))


# ---- text ----


@query(r"""
    WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[\p{L}][\p{L}\p{M}\p{N}\p{Pc}''’.\-]*'), lambda w: trim(w, '.,;:!?()[]{}"“”')), lambda w: w <> '') AS w FROM documents)
    SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS words FROM t
""")
def word_tokens(spark, sf_dir):
    """Tokens that begin with a letter (C4)."""
    rows = _docs(spark, sf_dir).select("doc_id", X.tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("words"))


@query(r"""
    WITH t AS (SELECT *, len(list_filter(list_transform(regexp_extract_all(text, '[\p{L}][\p{L}\p{M}\p{N}\p{Pc}''’.\-]*'), lambda w: trim(w, '.,;:!?()[]{}"“”')), lambda w: w <> '')) AS n FROM (SELECT doc_id, split_part(text, chr(10), 1) || CASE WHEN lang = 'en' THEN ' Get started' ELSE '' END AS text FROM documents))
    SELECT doc_id, n >= 18 AND NOT ((contains(lower(text), 'try it free') OR contains(lower(text), 'get started') OR contains(lower(text), 'book a demo') OR contains(lower(text), 'schedule a demo') OR contains(lower(text), 'sign up')) AND n < 35) AS eligible FROM t
""")
def eligible_paragraphs(spark, sf_dir):
    """Paragraphs long enough to carry a link, first lines with and without a call to action."""
    text = F.concat(F.substring_index("text", "\n", 1), F.when(F.col("lang") == "en", " Get started").otherwise(""))
    return _docs(spark, sf_dir).select("doc_id", X.paragraph_eligible(text).alias("eligible"))


@query(r"""
    SELECT doc_id, concat_ws('. ', nullif(source, ''), CASE WHEN lang = 'en' THEN NULL ELSE lang END, 'x') AS embed,
           '/' || lang || '/my-' || source || '/ ' || lang || ' my ' || source || ' ' || upper(source) || ' d ' || array_to_string(['k', lang], ' ') AS label,
           upper(left(lang, 1)) || substr(lang, 2) || ' ' || upper(left(source, 1)) || substr(source, 2) AS section, [lang, source, ''] AS badges FROM documents
""")
def page_texts(spark, sf_dir):
    """Texts of a page for encoders, labels, section titles and badges."""
    url = F.format_string("/%s/my-%s/", "lang", "source")
    return _docs(spark, sf_dir).select(
        "doc_id", X.embed_text(F.col("source"), F.when(F.col("lang") != "en", F.col("lang")), F.lit("x")).alias("embed"), X.page_label(url, F.upper("source"), F.lit("d"), F.array(F.lit("k"), F.col("lang"))).alias("label"),
        X.section_title(F.concat("lang", F.lit("-"), "source")).alias("section"), X.split_badges(F.concat("lang", F.lit(" , "), "source", F.lit(","))).alias("badges"),
    )


@query(r"""
    SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '>\s+<', '><', 'g')) AS squeezed,
           right(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_-]', '_', 'g'), '-{2,}', '-', 'g'), 100) AS file, md5(trim(text, chr(10) || chr(13) || ' ' || chr(9))) AS unwrapped FROM documents
""")
def cleaned_texts(spark, sf_dir):
    """Squeezed markup, safe names and texts out of their code fence."""
    fenced = F.concat(F.lit("```markdown\n"), F.trim(F.regexp_replace("text", r"\A\s+|\s+\z", "")), F.lit("\n```"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.squeeze_markup(F.col("text")).cast("binary")).alias("squeezed"), X.safe_filename(F.col("text")).alias("file"), F.md5(X.unwrap_fence(fenced).cast("binary")).alias("unwrapped"))


_MARKDOWN = r"regexp_replace(regexp_replace(regexp_replace(text, ' (the|de|der|la) ', chr(10) || '## Part ', 'g'), ' (of|und|le|el) ', chr(10) || '### Sub ', 'g'), ' (and|die|que) ', ' [to](/p/x) ', 'g')"


def _markdown(column: str = "text"):
    """Texts with headings and links where common words stand."""
    out = F.regexp_replace(column, " (the|de|der|la) ", "\n## Part ")
    return F.regexp_replace(F.regexp_replace(out, " (of|und|le|el) ", "\n### Sub "), " (and|die|que) ", " [to](/p/x) ")


@query(rf"""
    WITH m AS (SELECT doc_id, source, {_MARKDOWN} AS body FROM documents), h AS (SELECT doc_id, source, len(regexp_extract_all(body, '(?m)^##\s+\S')) AS h2, len(regexp_extract_all(body, '(?m)^###\s+\S')) AS h3, body FROM m)
    SELECT h.doc_id, h.h2, h.h3, CASE WHEN contains(body, '[to](/p/x)') THEN ['/p/x/'] ELSE [] END AS links FROM h
""")
def markdown_structure(spark, sf_dir):
    """Headings by level and links of markdown."""
    rows = _docs(spark, sf_dir).select("doc_id", _markdown().alias("body"))
    n = lambda level: F.coalesce(F.try_element_at(X.heading_counts(F.col("body")), F.lit(level)), F.lit(0))
    return rows.select("doc_id", n(2).alias("h2"), n(3).alias("h3"), X.link_targets(F.col("body")).alias("links"))


@query(rf"""
    WITH m AS (SELECT doc_id, source, {_MARKDOWN} AS body FROM documents), h AS (SELECT doc_id, source, len(regexp_extract_all(body, '(?m)^##\s+\S')) AS h2, len(regexp_extract_all(body, '(?m)^###\s+\S')) AS h3 FROM m),
    r AS (SELECT source, arg_min(h2, doc_id) AS r2, arg_min(h3, doc_id) AS r3 FROM h GROUP BY source)
    SELECT h.doc_id, list_filter([CASE WHEN h2 <> r2 THEN h2 || ' headings of level 2, the source has ' || r2 END, CASE WHEN h3 <> r3 THEN h3 || ' headings of level 3, the source has ' || r3 END], lambda x: x IS NOT NULL) AS problems
    FROM h JOIN r ON h.source = r.source
""")
def body_checks(spark, sf_dir):
    """Structural differences of each text from the first of its source."""
    docs = _docs(spark, sf_dir).select("doc_id", "source", _markdown().alias("body"))
    # bodies are read once, and what is compared of them is all that is dealt
    own = F.struct(*[c.alias(name) for name, c in H.body_facts(F.col("body")).items()])
    facts = Scratch(spark, "bodies").table(docs.select("doc_id", "source", own.alias("own")), "facts")
    first = facts.groupBy("source").agg(F.min_by("own", "doc_id").alias("reference"))
    return facts.join(first, "source").select("doc_id", H.check_facts(F.col("own"), F.col("reference")).alias("problems"))


_BROKEN = "text || CASE lang WHEN 'en' THEN chr(10) || '{{< cta > %}}' WHEN 'de' THEN chr(10) || '{{% box %>}}' WHEN 'es' THEN chr(10) || '{{< box > } x' WHEN 'fr' THEN chr(10) || '{\"a\": 1,}' ELSE '' END"


@query(rf"""
    WITH b AS (SELECT doc_id, lang, {_BROKEN} AS body, len(string_split(text, chr(10))) + 1 AS line FROM documents)
    SELECT doc_id, CASE lang WHEN 'en' THEN ['malformed shortcode {{{{< cta > %}}'] WHEN 'de' THEN ['malformed shortcode {{{{% box %>}}}}'] WHEN 'es' THEN ['malformed shortcode {{{{< box > }}']
           ELSE ['line ' || line || ': Illegal trailing comma before end of object: line 1 column 8 (char 7)'] END AS problems,
           len(regexp_extract_all(body, '(?m)^##\s+\S')) < len(regexp_extract_all(body || CASE WHEN lang = 'en' THEN chr(10) || '## more' ELSE '' END, '(?m)^##\s+\S')) AS truncated
    FROM b
""")
def broken_bodies(spark, sf_dir):
    """Whole texts with a malformed shortcode or broken JSON put at their ends, and texts that lack a heading of their source."""
    end = F.when(F.col("lang") == "en", "\n{{< cta > %}}").when(F.col("lang") == "de", "\n{{% box %>}}").when(F.col("lang") == "es", "\n{{< box > } x").when(F.col("lang") == "fr", '\n{"a": 1,}').otherwise("")
    rows = _docs(spark, sf_dir).select("doc_id", F.concat("text", end).alias("body"), F.when(F.col("lang") == "en", "\n## more").otherwise("").alias("more"))
    return rows.select("doc_id", H.check_body(F.col("body"), F.lit(None).cast("string")).alias("problems"), H.truncated(F.col("body"), F.concat("body", "more")).alias("truncated"))


@query(r"""
    SELECT doc_id, list_sort(list_distinct([lang, source])) AS opened, CASE WHEN lang = 'en' THEN [] ELSE [lang] END AS closed FROM documents
""")
def shortcode_names(spark, sf_dir):
    """Names of shortcodes that open and close."""
    body = F.concat(F.lit("{{< "), "lang", F.lit(' a="b" >}} x {{% '), "source", F.lit(" %}} y "), F.when(F.col("lang") != "en", F.concat(F.lit("{{< /"), "lang", F.lit(" >}}"))).otherwise(""))
    rows = _docs(spark, sf_dir).select("doc_id", body.alias("body"))
    return rows.select("doc_id", F.map_keys(X.shortcode_counts(F.col("body"))).alias("opened"), F.map_keys(X.shortcode_counts(F.col("body"), closing=True)).alias("closed"))


# ---- anchors ----

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"""
    WITH w AS (SELECT doc_id, string_split(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), ' ') AS w FROM documents),
    p AS (SELECT doc_id, list_filter(w, lambda x: length(x) > 2)[1:7] AS w FROM w), q AS (SELECT doc_id, w, w[2:3] AS a, array_to_string(w[2:3], ' ') AS low, array_to_string(w[1:4], ' ') AS title, w[5] AS slug, array_to_string(w[6:7], ' ') AS kw FROM p WHERE len(w) = 7),
    c AS (SELECT *, list_filter(a, lambda x: NOT list_contains({_LIST(X.STOPWORDS)}, x)) AS content, list_filter(list_concat(w[1:5], w[6:7]), lambda x: NOT list_contains({_LIST(X.STOPWORDS)}, x)) AS terms,
          len(list_filter(w[6:7], lambda x: NOT list_contains({_LIST(X.STOPWORDS + X.GENERIC_TERMS)}, x))) > 0 AS own FROM q),
    s AS (SELECT *, len(list_filter(content, lambda x: list_contains(terms, x))) AS matched, len(list_filter(content, lambda x: list_contains(terms, x) AND NOT list_contains({_LIST(X.GENERIC_TERMS)}, x))) AS specific,
          CASE WHEN own AND low = kw THEN 0.16 WHEN own AND (contains(kw, low) OR contains(low, kw)) THEN 0.08 ELSE 0 END AS bonus,
          CASE WHEN low = title OR low = slug THEN 0.25 WHEN contains(title, low) OR contains(slug, low) THEN 0.12 WHEN contains(low, title) THEN 0.18 ELSE 0 END AS label FROM c)
    SELECT doc_id, low, round(CAST(CASE WHEN len(content) = 0 THEN 0 ELSE bonus + label + 0.45 * matched / len(content) + 0.35 * specific / len(content) + least(0.10, greatest(len(content) - 2, 0) * 0.025) END AS DOUBLE), 6) AS lexical,
           bonus > 0 OR (len(content) >= 2 AND specific > 0) AS specific FROM s
""")
def anchor_scores(spark, sf_dir):
    """Lexical score of an anchor for a target made of the words around it."""
    words = F.filter(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", " ")), " "), lambda x: F.length(x) > 2)
    rows = _docs(spark, sf_dir).select("doc_id", F.slice(words, 1, 7).alias("w")).where(F.size("w") == 7)
    join = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    rows = rows.select("doc_id", "w", join(2, 2).alias("low"), join(1, 4).alias("title"), F.concat(F.lit("/"), F.col("w")[4], F.lit("/")).alias("url"), F.array(join(6, 2)).alias("keywords"))
    rows = linking.target_columns(rows)
    content = F.filter(F.slice("w", 2, 2), lambda x: ~x.isin(X.STOPWORDS))
    parts = linking.lexical_parts(F.col("low"), content, F.col("t_title"), F.col("t_slug"), F.col("t_keywords"), F.col("t_terms"), frozenset(X.GENERIC_TERMS))
    rows = rows.withColumn("parts", parts)
    return rows.select("doc_id", "low", six("parts.lexical").alias("lexical"), linking.specific_anchor(F.col("parts")).alias("specific"))


@query("""
    WITH x AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS fit, CAST(embedding[2] AS DOUBLE) AS lift, abs(CAST(embedding[3] AS DOUBLE)) AS lexical, CAST(embedding[4] AS DOUBLE) AS cos FROM embeddings),
    y AS (SELECT *, least(0.14, greatest(0, fit + 0.6 - 0.55) * 0.45) + least(0.10, greatest(0, lift) * 1.8) AS extra, greatest(0, least(1, (cos + 1) / 2)) AS sure FROM x)
    SELECT vec_id, round(0.72 * lexical + extra, 6) AS score, round(least(1, 0.62 + 0.35 * lexical), 6) AS confidence, round(0.48 * sure + 0.26 * 0.5 + extra + 0.05 + 0.08, 6) AS semantic FROM y
""")
def anchor_totals(spark, sf_dir):
    """Final scores of anchors by words and by vectors."""
    at = lambda k: V.doubles(F.col("embedding"))[k]
    fit, lift, lexical = at(0) + 0.6, at(1), F.abs(at(2))
    parts = F.struct(F.lit(0.08).alias("bonus"), F.lit(0.5).alias("overlap"), F.lit(4).alias("content"))
    rows = read(spark, sf_dir, "embeddings").withColumns({"parts": parts, "sure": linking.semantic_confidence(at(3))})
    return rows.select("vec_id", six(linking.anchor_score(lexical, fit, lift)).alias("score"), six(linking.anchor_confidence(lexical)).alias("confidence"), six(linking.semantic_score(F.col("sure"), F.col("parts"), fit, lift)).alias("semantic"))


# ---- addresses ----


@query(r"""
    WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS base, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*', '') AS path FROM pages),
    q AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts, CASE WHEN ends_with(path, '/') THEN path ELSE path || '/' END AS canon FROM p)
    SELECT page_id, base, substr(canon, 2) || 'index.html' AS file, array_to_string(parts[1:len(parts) - 1], '/') AS prefix, parts[len(parts)] AS slug,
           '/' || trim(path, '/') || '/' AS slashed, 'https://cdn/' || ltrim(path, '/') AS static, false AS navigation, contains(url, '#top') AND starts_with(url, 'http://') AS skipped FROM q
""")
def url_parts(spark, sf_dir):
    """Parts and forms of addresses."""
    url, path = F.col("url"), U.path_of(F.col("url"))
    skipped = U.skipped(F.when(F.contains(url, F.lit("#top")), url).otherwise(path), ["http://"])
    return read(spark, sf_dir, "pages").select(
        "page_id", U.base_url(url).alias("base"), U.html_path(url).alias("file"), U.split_slug(path)["prefix"].alias("prefix"), U.split_slug(path)["slug"].alias("slug"),
        U.ensure_slashes(path).alias("slashed"), U.static_url(path, cdn="https://cdn/").alias("static"), U.is_navigation(url).alias("navigation"), skipped.alias("skipped"),
    )


@query(r"""
    SELECT doc_id, CASE WHEN lang = 'de' THEN '/' || source || '/' ELSE '/' || source || '/p' || doc_id || '/' END AS url, CASE WHEN lang = 'en' THEN '/own/' ELSE CASE WHEN lang = 'de' THEN '/' || source || '/' ELSE '/' || source || '/p' || doc_id || '/' END END AS page,
           lang AS language, source AS section, replace(lang || '-x', '-', '_') AS file FROM documents
""")
def file_addresses(spark, sf_dir):
    """Addresses, language and section of content files."""
    path = F.when(F.col("lang") == "de", F.concat("source", F.lit("/_index.md"))).otherwise(F.format_string("%s/p%d.md", "source", "doc_id"))
    return _docs(spark, sf_dir).select(
        "doc_id", U.url_from_path(path).alias("url"), U.page_url(F.when(F.col("lang") == "en", " /own "), path).alias("page"), U.language_of(F.concat(F.lit("/srv/content/"), "lang", F.lit("/"), path)).alias("language"),
        U.section_of(path).alias("section"), U.section_file(F.concat("lang", F.lit("-x"))).alias("file"),
    )


@query("""
    SELECT page_id, CASE CAST(length(url) % 4 AS INT) WHEN 0 THEN 'added' WHEN 1 THEN 'fixed' WHEN 2 THEN 'correct' ELSE 'correct' END AS status FROM pages
""")
def address_states(spark, sf_dir):
    """Whether a stated address is missing, wrong or right."""
    n = F.length("url") % 4
    rows = read(spark, sf_dir, "pages").select("page_id", F.when(n == 0, " ").when(n == 1, "/x/").otherwise(F.concat(F.col("url"), F.lit(" "))).alias("url"), F.col("url").alias("expected"))
    return sync.url_status(rows).select("page_id", "status")


@query(r"SELECT count(DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) = 1 AS prefix FROM pages")
def host_policy(spark, sf_dir):
    """Whether languages share a host."""
    return sync.distinct_host_policy(read(spark, sf_dir, "pages").select(U.authority(F.col("url")).alias("host")))


@query("""
    WITH e AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, CASE WHEN lang = 'en' THEN 'football' ELSE 'general' END AS section, CASE WHEN n_chars % 2 = 0 THEN ' ' ELSE '2025-01-' || (n_chars % 9) END AS lastmod FROM documents),
    k AS (SELECT *, (row_number() OVER (PARTITION BY section ORDER BY pos) - 1) // 50 AS chunk FROM e)
    SELECT section, CAST(chunk AS INT) AS chunk, 'https://h/sitemap-' || section || CASE WHEN chunk > 0 THEN '-' || (chunk + 1) ELSE '' END || '.xml' AS loc, max(nullif(trim(lastmod), '')) AS lastmod, count(*) AS n_urls FROM k GROUP BY section, chunk
""")
def sitemap_files(spark, sf_dir):
    """Files of a split site map with their newest entry."""
    from corpusloom.sources.sinks import sitemap_index

    rows = _docs(spark, sf_dir).select(
        F.col("doc_id").alias("pos"), F.concat(F.lit("https://h/"), F.when(F.col("lang") == "en", "football").otherwise("x"), F.lit("/"), F.col("doc_id").cast("string")).alias("loc"),
        F.when(F.col("n_chars") % 2 == 0, " ").otherwise(F.concat(F.lit("2025-01-"), (F.col("n_chars") % 9).cast("string"))).alias("lastmod"),
    )
    return sitemap_index(crawl.split_sitemap(rows, 50), "https://h/")


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND n_chars % 2 = 0 AND NOT coalesce(source = 'src3', false)")
def listed_pages(spark, sf_dir):
    """Pages that a language's site map lists."""
    from corpusloom.sources.sinks import sitemap_pages

    rows = _docs(spark, sf_dir).select("doc_id", "lang", (F.col("n_chars") % 2 == 1).alias("sitemap_exclude"), F.when(F.col("source") == "src3", True).alias("private"))
    return sitemap_pages(rows, "de").select("doc_id")


@query("SELECT DISTINCT lang, 'User-agent: *' || chr(10) || 'Allow: /' || chr(10) || 'Sitemap: https://h/' || lang || '/sitemap.xml' AS value FROM documents")
def robots_lines(spark, sf_dir):
    """Robots text of each language."""
    from corpusloom.sources.sinks import robots_text

    return robots_text(_docs(spark, sf_dir).select("lang").distinct(), "https://h/")


@query("""
    SELECT '{"title":"' || source || '","permalink":"/' || doc_id || '/","description":"' || lang || '","tags":["' || lang || '"],"kind":"page"}' AS value FROM documents
    UNION ALL SELECT DISTINCT '{"title":"' || lang || '","permalink":"/tags/' || lang || '/","description":"","tags":[],"kind":"term"}' FROM documents
""")
def search_rows(spark, sf_dir):
    """Rows of a search index: pages and terms (K17, SE1)."""
    from corpusloom.sources.sinks import search_index

    docs = _docs(spark, sf_dir)
    pages = docs.select(F.col("source").alias("title"), F.format_string("/%d/", "doc_id").alias("permalink"), F.col("lang").alias("description"), F.array("lang").alias("tags"))
    return search_index(pages, docs.select("lang").distinct().select(F.col("lang").alias("title"), F.format_string("/tags/%s/", "lang").alias("permalink")))


@query("""
    SELECT doc_id, '{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"Home","item":"/"},{"@type":"ListItem","position":3,"name":"' || source || '","item":"/' || source || '/"}]}' AS crumbs,
           '{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[{"@type":"Question","name":"' || lang || '?","acceptedAnswer":{"@type":"Answer","text":"' || source || '"}}]}' AS faq FROM documents
""")
def structured_data_rows(spark, sf_dir):
    """JSON-LD of breadcrumbs and questions."""
    from corpusloom.sources.sinks import breadcrumb_json, faq_json

    crumb = lambda name, url: F.struct(name.alias("name"), url.alias("url"))
    crumbs = F.array(crumb(F.lit("Home"), F.lit("/")), crumb(F.lit(""), F.lit("/x/")), crumb(F.col("source"), F.format_string("/%s/", "source")))
    faq = F.array(F.struct(F.concat("lang", F.lit("?")).alias("question"), F.col("source").alias("answer")))
    return _docs(spark, sf_dir).select("doc_id", breadcrumb_json(crumbs).alias("crumbs"), faq_json(faq).alias("faq"))


# ---- languages ----


@query("""
    WITH d AS (SELECT source AS rel_path, lang, min(n_chars) AS n, max(doc_id) AS m FROM documents GROUP BY source, lang)
    SELECT o.rel_path, o.lang, list_filter([CASE WHEN e.n <> o.n THEN 'date=' || e.n END, CASE WHEN e.m <> o.m THEN 'image=' || e.m END], lambda x: x IS NOT NULL) AS changes FROM d o JOIN d e ON e.rel_path = o.rel_path AND e.lang = 'en' WHERE o.lang <> 'en' AND (e.n <> o.n OR e.m <> o.m)
""")
def attribute_changes(spark, sf_dir):
    """Attributes of the English page that a translation has otherwise."""
    rows = _docs(spark, sf_dir).groupBy(F.col("source").alias("rel_path"), "lang").agg(F.min("n_chars").cast("string").alias("n"), F.max("doc_id").cast("string").alias("m"))
    attrs = F.create_map(F.lit("date"), F.col("n"), F.lit("image"), F.col("m"), F.lit("title"), F.col("lang"))
    return sync.attribute_changes(rows.select("rel_path", "lang", attrs.alias("attrs")), ["date", "image"]).select("rel_path", "lang", _entries(F.col("changes")).alias("changes"))


@query("""
    WITH p AS (SELECT source AS rel_path, lang, CAST(min(doc_id) AS VARCHAR) AS url FROM documents GROUP BY source, lang)
    SELECT rel_path, list(lang || '=' || url ORDER BY lang) AS urls FROM p GROUP BY rel_path
""")
def translation_maps(spark, sf_dir):
    """Map from language to address of each page."""
    rows = _docs(spark, sf_dir).select(F.lit("d").alias("folder"), F.col("source").alias("rel_path"), "lang", "doc_id")
    rows = rows.groupBy("folder", "rel_path", "lang").agg(F.min("doc_id").cast("string").alias("url"))
    return sync.translation_map(rows).select("rel_path", _entries(F.col("urls")).alias("urls"))


@query("""
    WITH l AS (SELECT source AS file, doc_id AS line, lang AS key FROM documents) SELECT file, key, line FROM l QUALIFY count(*) OVER (PARTITION BY file, key) > 1
""")
def repeated_keys(spark, sf_dir):
    """Keys that a file defines more than once, and where."""
    from corpusloom.sources.tables import duplicate_keys

    lines = _docs(spark, sf_dir).select(F.col("source").alias("file"), F.col("doc_id").alias("line"), F.concat("lang", F.lit(" : x")).alias("text"))
    return duplicate_keys(lines.union(lines.select("file", F.col("line") + 10**9, F.lit("- no key"))))


@query("SELECT DISTINCT source AS flow_input, lang AS filename FROM documents WHERE lang <> 'en'")
def open_topics(spark, sf_dir):
    """Topics without an output yet."""
    from corpusloom.sources.tables import new_topics

    topics = _docs(spark, sf_dir).select(F.col("source").alias("flow_input"), F.col("lang").alias("filename")).distinct()
    return new_topics(topics, spark.createDataFrame([("en",)], "filename string"))


# ---- images and vectors ----


_NAMES = "n AS (SELECT DISTINCT left(text, 24) AS name FROM benchmark UNION SELECT left(text, 24) || ' (1).png' FROM benchmark UNION SELECT DISTINCT source FROM documents)"


def _image_names(spark, sf_dir):
    """Names with blanks, brackets and dots, of which texts have some."""
    head = F.left("text", F.lit(24))
    names = read(spark, sf_dir, "benchmark").select(F.explode(F.array(head, F.concat(head, F.lit(" (1).png")))).alias("name"))
    return names.union(_docs(spark, sf_dir).select("source")).distinct()


@query(f"WITH {_NAMES} SELECT name, CAST(doc_id AS VARCHAR) AS path FROM n JOIN documents ON contains(text, name)")
def images_in_texts(spark, sf_dir):
    """Texts that have each image's name in them."""
    return crawl.image_mentions(_image_names(spark, sf_dir), _docs(spark, sf_dir).select(F.col("doc_id").alias("path"), F.col("text").alias("body")))


@query(f"WITH {_NAMES} SELECT name FROM n WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(text, name))")
def images_without_text(spark, sf_dir):
    """Images whose name no text has."""
    return crawl.unused_images(_image_names(spark, sf_dir), _docs(spark, sf_dir).select(F.col("doc_id").alias("path"), F.col("text").alias("body")))


@query("""
    SELECT digest, path, row_number() OVER (PARTITION BY digest ORDER BY n_chars DESC, path) AS rank FROM (SELECT md5(text) AS digest, CAST(doc_id AS VARCHAR) AS path, n_chars FROM documents) QUALIFY count(*) OVER (PARTITION BY digest) > 1
""")
def equal_files(spark, sf_dir):
    """Files of equal content, the largest first."""
    from corpusloom.plans.scratch import Scratch

    rows = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.md5(F.col("text").cast("binary")).alias("digest"), F.col("n_chars").alias("pixels"))
    return crawl.duplicate_files(rows, Scratch(spark, "equal-files"))


@query("""
    WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * label) AS s FROM embeddings)
    SELECT vec_id, round(sqrt(list_inner_product(s, s)), 6) AS norm, round(CASE WHEN label = 0 THEN 0 ELSE e[1] / sqrt(list_inner_product(e, e)) END, 6) AS first, round(list_inner_product(e, s), 6) AS dot, label <> 0 AS usable FROM v
""")
def vector_scalars(spark, sf_dir):
    """Length, unit vector and product, of zero vectors too, and whether a vector is usable."""
    rows = read(spark, sf_dir, "embeddings").withColumn("s", F.transform(V.doubles(F.col("embedding")), lambda x: x * F.col("label")))
    return rows.select("vec_id", six(V.norm(F.col("s"))).alias("norm"), six(V.normalize(F.col("s"))[0]).alias("first"), six(V.dot(F.col("embedding"), F.col("s"))).alias("dot"), V.nonzero(F.col("s")).alias("usable"))


@query("SELECT label AS section, count(*) FILTER (vec_id % 7 > 2) AS n FROM embeddings GROUP BY label HAVING count(*) FILTER (vec_id % 7 > 2) > 0")
def repaired_vectors(spark, sf_dir):
    """Vectors that stay when those that were made null, zero or not finite go."""
    kind = F.col("vec_id") % 7
    filled = lambda x: F.transform("embedding", lambda _: F.lit(x).cast("float"))
    vec = F.when(kind == 0, filled(0.0)).when(kind == 1, filled(float("nan"))).when(kind > 2, F.col("embedding"))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("section"), vec.alias("vec"))
    return vector.usable(rows).groupBy("section").agg(F.count("*").alias("n"))
