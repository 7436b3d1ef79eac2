"""Named queries over the test tables, and the SQL that gives the same rows.

The tables stand for the inputs of the engine: embeddings for page vectors with label as
section, documents for pages with lang and source as language and section, pages for
fetched HTML. All queries run over whole tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import urls as U
from corpusloom.functions import vectors as V
from corpusloom.functions.html import page_text
from corpusloom.operators import audit, crawl, graph, keywords, sync, vector
from corpusloom.plans.scratch import Scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def page_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("section"), F.col("embedding").alias("vec"))


def hashed_vector(text) -> F.Column:
    """A vector of a text from the encoder that hashes words."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(vector.hashing_encoder()(texts.tolist()), dtype=np.float64)))

    return run(text)


def six(column) -> F.Column:
    return F.round(column, 6)


# ---- vectors ----

_VECTORS = """
    v AS (SELECT vec_id AS id, label AS section, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    x AS (SELECT id, section, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
    n AS (SELECT id, section, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
    sec AS (SELECT section, list(m ORDER BY i) AS c FROM (SELECT section, i, avg(x) AS m FROM x GROUP BY section, i) GROUP BY section),
    site AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM x GROUP BY i)),
    drift AS (
        SELECT id, n.section,
               1 - greatest(-1, least(1, list_inner_product(e, sec.c) / (norm * sqrt(list_inner_product(sec.c, sec.c))))) AS dist_section,
               1 - greatest(-1, least(1, list_inner_product(e, site.c) / (norm * sqrt(list_inner_product(site.c, site.c))))) AS dist_site
        FROM n JOIN sec ON n.section = sec.section CROSS JOIN site
    )
"""


@query(f"""
    WITH {_VECTORS}
    SELECT section, round(avg(1 - dist_section), 6) AS focus, round(stddev_pop(dist_section), 6) AS radius, round(avg(dist_section), 6) AS mean_dist,
           round(quantile_cont(dist_section, 0.95), 6) AS p95_dist, round(max(dist_section), 6) AS max_dist, count(*) AS n_pages
    FROM drift GROUP BY section
""")
def section_focus_report(spark, sf_dir):
    """Focus, radius and drift percentiles of each section."""
    report = audit.section_report(audit.with_drift(page_vectors(spark, sf_dir)))
    return report.select("section", *[six(c).alias(c) for c in ("focus", "radius", "mean_dist", "p95_dist", "max_dist")], "n_pages").orderBy(F.col("focus").desc(), "section")


@query(f"""
    WITH {_VECTORS}
    SELECT round(avg(1 - dist_site), 6) AS focus, round(stddev_pop(dist_site), 6) AS radius, round(avg(dist_site), 6) AS mean_dist,
           round(quantile_cont(dist_site, 0.95), 6) AS p95_dist, round(max(dist_site), 6) AS max_dist, count(*) AS n_pages, count(DISTINCT section) AS n_sections
    FROM drift
""")
def site_focus_report(spark, sf_dir):
    """Focus of the whole site."""
    report = audit.site_report(audit.with_drift(page_vectors(spark, sf_dir)))
    return report.select(*[six(c).alias(c) for c in ("focus", "radius", "mean_dist", "p95_dist", "max_dist")], "n_pages", "n_sections")


@query(f"""
    WITH {_VECTORS}, s AS (SELECT section, quantile_cont(dist_section, 0.95) AS p95, count(*) AS size FROM drift GROUP BY section)
    SELECT id, d.section, round(dist_section, 6) AS dist_section, round(dist_site, 6) AS dist_site,
           concat_ws('; ', CASE WHEN size < 3 THEN 'section too small' END, CASE WHEN dist_section > p95 THEN 'off-topic for section' END,
                     CASE WHEN dist_site > 0.65 THEN 'far from site topic' END) AS recommendation
    FROM drift d JOIN s ON d.section = s.section WHERE size < 3 OR dist_section > p95 OR dist_site > 0.65
""")
def drift_outliers(spark, sf_dir):
    """Pages that need attention, and why."""
    rows = audit.outliers(audit.with_drift(page_vectors(spark, sf_dir)))
    return rows.select("id", "section", six("dist_section").alias("dist_section"), six("dist_site").alias("dist_site"), "recommendation")


@query(f"""
    WITH {_VECTORS}, m AS (SELECT max(dist_site) AS most FROM drift)
    SELECT id, round(dist_site / greatest(most, 1e-9), 6) AS drift_norm FROM drift CROSS JOIN m
""")
def drift_normalized(spark, sf_dir):
    """Drift as a share of the largest (M6)."""
    rows = Scratch(spark, "drift").table(audit.with_drift(page_vectors(spark, sf_dir)).select("id", "dist_site"), "drift")
    most = rows.agg(F.max("dist_site").alias("most"))  # one row
    return rows.crossJoin(F.broadcast(most)).select("id", six(audit.normalized_drift(F.col("dist_site"), F.col("most"))).alias("drift_norm"))


_COSINES = """
    v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    s AS (SELECT a.id AS a, b.id AS b, a.label AS la, b.label AS lb, list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) AS sim
          FROM v a, v b WHERE a.id <> b.id)
"""


@query(f"""
    WITH {_COSINES}
    SELECT a, b, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 12) DESC, b) AS rank FROM s WHERE la = lb) WHERE rank <= 3
""")
def related_top3(spark, sf_dir):
    """The three nearest pages of the own section."""
    rows = page_vectors(spark, sf_dir).withColumns({"path": F.col("id").cast("string"), "is_index": F.lit(False)})
    return vector.related(rows.withColumn("section", F.col("section").cast("string"))).select("a", "b", six("sim").alias("sim"), "rank")


@query(f"""
    WITH {_COSINES}
    SELECT a, b, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 12) DESC, b) AS rank FROM s) WHERE rank <= 10
""")
def nearest_neighbours(spark, sf_dir):
    """The ten nearest vectors of each, exactly."""
    return vector.top_neighbours(page_vectors(spark, sf_dir), 10).select("a", "b", six("sim").alias("sim"), "rank")


@query(f"""
    WITH {_COSINES}, k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 12) DESC, b) AS rank FROM s)
    SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(sim), 6) AS sim,
           CASE WHEN max(sim) >= 0.97 THEN 'merge' WHEN max(sim) >= 0.94 THEN 'consolidate' ELSE 'review' END AS action
    FROM k WHERE rank <= 9 AND sim >= 0.4 GROUP BY 1, 2
""")
def duplicate_pairs(spark, sf_dir):
    """Near-duplicate pairs that either side sees among its nearest, and what to do (V7, SE4, F19). The threshold is lowered to where the tables have pairs."""
    pairs = vector.duplicate_pairs(page_vectors(spark, sf_dir), least=0.4)
    return pairs.select("a", "b", six("sim").alias("sim"), audit.duplicate_action(F.col("sim")).alias("action"))


def similar_edges(spark, sf_dir, scratch):
    """(classes, pairs): classes of equal vectors, and pairs over a threshold between their first members."""
    classes = scratch.table(vector.equal_classes(page_vectors(spark, sf_dir)).select("id", "vec", "class_id", "copies"), "classes")
    return classes, vector.threshold_pairs(classes.where("id = class_id").select("id", "vec"), 0.4)


@query(f"""
    WITH {_COSINES}, k AS (SELECT a.id, min(b.id) AS class_id FROM v a JOIN v b ON a.e = b.e GROUP BY a.id)
    SELECT a, b, round(sim, 6) AS sim FROM s WHERE a < b AND sim >= 0.4 AND a IN (SELECT class_id FROM k) AND b IN (SELECT class_id FROM k)
    UNION ALL SELECT class_id, id, 1 FROM k WHERE id <> class_id
""")
def similar_pairs(spark, sf_dir):
    """All pairs over a threshold between different vectors, and each copy with the first of its equals (V10's range search)."""
    classes, pairs = similar_edges(spark, sf_dir, Scratch(spark, "pairs"))
    copies = classes.where("id <> class_id").select(F.col("class_id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim"))
    return pairs.union(copies).select("a", "b", six("sim").alias("sim"))


@query(f"""
    WITH RECURSIVE {_COSINES}, e AS (SELECT a, b, sim FROM s WHERE sim >= 0.4),
    r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
    c AS (SELECT node, min(root) AS g FROM r GROUP BY node)
    SELECT g AS group_id, count(*) AS n_members, round((SELECT max(sim) FROM e JOIN c c2 ON c2.node = e.a WHERE c2.g = c.g), 6) AS max_sim FROM c GROUP BY g
""")
def similarity_groups(spark, sf_dir):
    """Connected groups of similar vectors (V8, V9, A10)."""
    scratch = Scratch(spark, "groups")
    classes, pairs = similar_edges(spark, sf_dir, scratch)
    copies = classes.where("id <> class_id").select(F.col("class_id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim"))
    found, _ = graph.groups(pairs.union(copies), scratch, ranked=False)
    return found.select("group_id", "n_members", six("max_sim").alias("max_sim"))


@query(f"""
    WITH RECURSIVE {_COSINES}, e AS (SELECT a, b, sim FROM s WHERE sim >= 0.4),
    r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
    c AS (SELECT node, min(root) AS g FROM r GROUP BY node), d AS (SELECT a AS node, count(*) AS degree FROM e GROUP BY a)
    SELECT g AS group_id, c.node AS member, degree, row_number() OVER (PARTITION BY g ORDER BY degree DESC, c.node) AS rank FROM c JOIN d ON c.node = d.node
""")
def similarity_members(spark, sf_dir):
    """Members of the groups, the best connected first (T4, A9). Copies of a vector count as one, and are linked with it."""
    scratch = Scratch(spark, "members")
    classes, pairs = similar_edges(spark, sf_dir, scratch)
    copies = classes.where("id <> class_id").select(F.col("class_id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim"))
    _, members = graph.groups(pairs.union(copies), scratch)
    return members


@query(f"""
    WITH RECURSIVE {_COSINES}, e AS (SELECT a, list_append(list(b), a) AS near FROM s WHERE sim >= 0.4 GROUP BY a),
    r(head, done) AS (
        SELECT min(a), CAST([] AS BIGINT[]) FROM e
        UNION ALL
        SELECT (SELECT min(e.a) FROM e WHERE e.a > r.head AND NOT list_has_any(e.near, list_concat(r.done, h.near))), list_concat(r.done, h.near)
        FROM r JOIN e h ON h.a = r.head
    )
    SELECT head AS group_id, unnest(near) AS member FROM (SELECT DISTINCT head FROM r WHERE head IS NOT NULL) JOIN e ON e.a = head
""")
def greedy_groups(spark, sf_dir):
    """Groups of similar vectors taken in the order of ids, none touching an earlier one."""
    scratch = Scratch(spark, "greedy")
    classes, pairs = similar_edges(spark, sf_dir, scratch)
    # copies of a vector have its neighbours: groups are found among classes, and their members are all copies
    several = classes.where("id = class_id AND copies > 1").select(F.col("id").alias("a"), F.col("id").alias("b"))
    found = graph.greedy_groups(pairs.select("a", "b").union(several), scratch, most=None)
    return found.join(classes.select(F.col("class_id").alias("member"), "id"), "member").select("group_id", F.col("id").alias("member"))


@query(f"WITH {_COSINES}, e AS (SELECT a, b FROM s WHERE sim >= 0.4) SELECT a AS node, count(*) AS degree FROM e GROUP BY a")
def similarity_degrees(spark, sf_dir):
    """Number of similar vectors of each, its copies among them."""
    classes, pairs = similar_edges(spark, sf_dir, Scratch(spark, "degrees"))
    copies = classes.where("id = class_id").select("class_id", "copies")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p")).select("p.*")
    other = ends.join(copies, ends["y"] == copies["class_id"]).groupBy(F.col("x").alias("class_id")).agg(F.sum("copies").alias("n"))
    degree = F.col("copies") - 1 + F.coalesce("n", F.lit(0))
    return classes.select("id", "class_id", "copies").join(other, "class_id", "left").select(F.col("id").alias("node"), degree.alias("degree")).where("degree > 0")


@query(f"""
    WITH {_VECTORS}, d AS (SELECT n.id, n.section, sqrt(list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist FROM n JOIN sec ON n.section = sec.section)
    SELECT section, arg_min(id, struct_pack(d := round(dist, 12), i := id)) AS medoid, round(min(dist), 6) AS dist FROM d GROUP BY section
""")
def section_medoids(spark, sf_dir):
    """The page nearest to each section's centre."""
    return audit.medoids(page_vectors(spark, sf_dir), "section").select("section", "medoid", six("dist").alias("dist"))


@query("""
    WITH v AS (SELECT vec_id AS id, embedding[1] AS x, embedding[2] AS y FROM embeddings),
    b AS (SELECT quantile_cont(x, 0.05) AS xa, quantile_cont(x, 0.95) AS xb, quantile_cont(y, 0.05) AS ya, quantile_cont(y, 0.95) AS yb FROM (SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM v))
    SELECT id, round((CAST(x AS DOUBLE) - (xa + xb) / 2) / (CASE WHEN xa = xb THEN 1 ELSE (xb - xa) / 2 END), 6) AS x,
           round((CAST(y AS DOUBLE) - (ya + yb) / 2) / (CASE WHEN ya = yb THEN 1 ELSE (yb - ya) / 2 END), 6) AS y FROM v CROSS JOIN b
""")
def robust_scale(spark, sf_dir):
    """Two coordinates rescaled to their percentiles (A4)."""
    rows = page_vectors(spark, sf_dir).select("id", V.doubles(F.col("vec"))[0].alias("x"), V.doubles(F.col("vec"))[1].alias("y"))
    return audit.robust_rescale(rows, ["x", "y"]).select("id", six("x").alias("x"), six("y").alias("y"))


@query("""
    WITH v AS (SELECT label, len(embedding) AS d FROM embeddings)
    SELECT label AS section, count(*) AS n, max(d) AS dim FROM v GROUP BY label
""")
def usable_vectors(spark, sf_dir):
    """Vectors by section after non-finite and zero ones went."""
    return vector.usable(page_vectors(spark, sf_dir)).groupBy("section").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"))


@query("""
    WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents)
    SELECT doc_id, sha256(text) AS text_hash, CASE WHEN n % 5 = 0 THEN [7.0, n] WHEN n % 3 = 0 THEN [0.0, 0.0] ELSE [n, 1.0] END AS vec FROM d
""")
def cached_encoding(spark, sf_dir):
    """Vectors of texts by content hash: cached ones as they are, others encoded, those that come out not finite as zeros (V1, V2, V4, J1, R5, ST3)."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    n = F.length("text")
    hashed = docs.select(F.sha2("text", 256).alias("text_hash"), n.alias("n")).distinct()
    held = hashed.where("n % 5 = 0").select(F.lit("m").alias("model"), "text_hash", F.lit(2).alias("dim"), F.array(F.lit(7.0), F.col("n")).cast("array<float>").alias("vec"))
    # a poisoned row and one of another model count for nothing
    bad = hashed.where("n % 5 = 1").select(F.lit("m").alias("model"), "text_hash", F.lit(2).alias("dim"), F.array(F.lit(float("nan")), F.col("n")).cast("array<float>").alias("vec"))
    other = hashed.select(F.lit("other").alias("model"), "text_hash", F.lit(2).alias("dim"), F.array(F.lit(1.0), F.lit(1.0)).cast("array<float>").alias("vec"))

    def encode(texts: list[str]) -> np.ndarray:
        return np.array([[np.nan if len(t) % 3 == 0 else len(t), 1.0] for t in texts])

    rows, _ = vector.encode_cached(docs, held.union(bad).union(other), "m", encode)
    return rows.select(F.col("id").alias("doc_id"), "text_hash", V.doubles(F.col("vec")).alias("vec"))


# ---- text ----


@query(r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\s]+') AS w FROM documents)
    SELECT doc_id, len(w) AS word_count FROM w
""")
def word_counts(spark, sf_dir):
    """Words between white space."""
    return read(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("word_count"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS clean FROM documents")
def normalized_text(spark, sf_dir):
    """White space normalised."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalize_space(F.col("text")).cast("binary")).alias("clean"))


@query(r"""
    WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
    h AS (SELECT doc_id, t, left(t, 120) AS h FROM c)
    SELECT doc_id, CASE WHEN length(t) <= 120 THEN t WHEN regexp_replace(h, ' [^ ]*$', '') = '' THEN h ELSE regexp_replace(h, ' [^ ]*$', '') END AS clipped FROM h
""")
def clipped_text(spark, sf_dir):
    """Text cut at a word's end."""
    return read(spark, sf_dir, "documents").select("doc_id", X.clip(F.col("text"), 120).alias("clipped"))


@query(r"SELECT doc_id, len(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS n_sentences FROM documents")
def sentence_counts(spark, sf_dir):
    """Sentences."""
    return read(spark, sf_dir, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).alias("n_sentences"))


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_NOISE = ", ".join(f"'{w}'" for w in keywords.NOISE)


@query(rf"""
    WITH d AS (SELECT source, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: length(w) > 2) AS w FROM documents),
    g AS (
        SELECT source, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) AS phrase FROM d
        UNION ALL SELECT source, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM d
        UNION ALL SELECT source, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) FROM d
    ), c AS (SELECT source, phrase, count(*) AS n FROM g GROUP BY source, phrase),
    k AS (SELECT * FROM c WHERE len(list_filter(string_split(phrase, ' '), lambda w: w IN ({_NOISE}))) = 0 AND len(list_filter(string_split(phrase, ' '), lambda w: w NOT IN ({_STOP}, {_NOISE}))) > 0)
    SELECT source, phrase, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, encode(phrase)) AS rank FROM k) WHERE rank <= 20
""")
def section_keywords(spark, sf_dir):
    """The twenty most frequent n-grams of each source."""
    return keywords.group_keywords(read(spark, sf_dir, "documents"), "source", "text")


@query("""
    SELECT doc_id, CASE WHEN length(text) > 120 THEN 'size-1' WHEN length(text) > 100 THEN 'size-2' WHEN length(text) > 85 THEN 'size-3' WHEN length(text) > 70 THEN 'size-4'
        WHEN length(text) > 60 THEN 'size-5' WHEN length(text) > 50 THEN 'size-6' WHEN length(text) > 40 THEN 'size-7' ELSE 'size-8' END AS font FROM documents
""")
def title_classes(spark, sf_dir):
    """Ladder of length classes (F16)."""
    return read(spark, sf_dir, "documents").select("doc_id", X.font_class(F.col("text")).alias("font"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM documents")
def escaped_text(spark, sf_dir):
    """HTML escaping of whole texts."""
    return read(spark, sf_dir, "documents").select("doc_id", X.escape_html(F.col("text")).alias("escaped"))


@query("SELECT doc_id, left(text, 2000) AS clipped FROM documents")
def hard_clipped_text(spark, sf_dir):
    """The hard clip at its own length."""
    return read(spark, sf_dir, "documents").select("doc_id", X.hard_clip(F.col("text")).alias("clipped"))


@query("SELECT doc_id, sha256(text) AS hash, sha256(text || '|' || 'model') AS model_hash FROM documents")
def content_hashes(spark, sf_dir):
    """Content hashes with and without a model's name."""
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.sha2(F.concat("text", F.lit("|model")), 256).alias("model_hash"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)(^|[^\w-])(the)([^\w-]|$)') AS named FROM documents")
def keyword_mentions(spark, sf_dir):
    """Whether a text has a keyword between word borders (C20)."""
    return read(spark, sf_dir, "documents").select("doc_id", X.mentions(F.col("text"), F.lit("the")).alias("named"))


@query("""
    SELECT doc_id, CASE WHEN text = '' THEN true ELSE (length(text) - length(translate(text, '{}[]=:"', ''))) / greatest(length(text), 1) > 0.08
        OR (contains(lower(text), 'imaged')::INT + contains(lower(text), 'imagealt')::INT + contains(lower(text), 'linktext')::INT + contains(lower(text), 'categorycolor')::INT + contains(lower(text), 'primarycta')::INT) >= 2 END AS data
    FROM documents
""")
def structured_paragraphs(spark, sf_dir):
    """Paragraphs that look like data."""
    return read(spark, sf_dir, "documents").select("doc_id", X.structured_data(F.col("text")).alias("data"))


# ---- addresses ----


@query(r"""
    WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*', ''), '[?#].*', '') AS p FROM pages),
    c AS (SELECT page_id, CASE WHEN p = '' THEN url ELSE p END AS p FROM p), d AS (SELECT page_id, CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS p FROM c)
    SELECT page_id, CASE WHEN p = '/' OR ends_with(p, '/') THEN p ELSE p || '/' END AS path FROM d
""")
def canonical_paths(spark, sf_dir):
    """Canonical paths."""
    return read(spark, sf_dir, "pages").select("page_id", U.canonical_path(F.col("url")).alias("path"))


@query(r"""
    WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '[?#].*', ''), '^/+|/+$', '', 'g'), '/') AS s, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS host FROM pages)
    SELECT host, s[1] AS first, count(*) AS n FROM p GROUP BY host, s[1]
""")
def hosts_and_sections(spark, sf_dir):
    """Pages by host and first part of the path."""
    parts = F.split(F.regexp_replace(U.path_of(F.col("url")), r"\A/+|/+\z", ""), "/")
    return read(spark, sf_dir, "pages").groupBy(U.authority(F.col("url")).alias("host"), parts[0].alias("first")).agg(F.count("*").alias("n"))


@query(r"""
    WITH r AS (SELECT page_id AS pos, url AS loc FROM pages), g AS (SELECT pos, loc, 'general' AS section FROM r),
    k AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY pos) - 1 AS rank FROM g)
    SELECT section, CAST(floor(rank / 100) AS INT) AS chunk, pos, loc FROM k
""")
def sitemap_chunks(spark, sf_dir):
    """Site map entries in chunks of their section."""
    entries = read(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.col("url").alias("loc"), F.lit("2025-01-01").alias("lastmod"))
    return crawl.split_sitemap(entries, 100).select("section", "chunk", "pos", "loc")


@query(r"""
    WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
    f AS (SELECT url AS page, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_replace(href, '#.*', '') AS link FROM l WHERE starts_with(href, '/'))
    SELECT DISTINCT link, page FROM f
""")
def link_index(spark, sf_dir):
    """Pages by the address that they refer to."""
    return crawl.inverted(crawl.page_links(read(spark, sf_dir, "pages")))


@query(r"""
    WITH l AS (SELECT url AS page, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
    f AS (SELECT DISTINCT page, regexp_extract(page, '^([a-z]+://[^/?#]*)', 1) || regexp_replace(href, '#.*', '') AS link FROM l WHERE starts_with(href, '/')),
    s AS (SELECT *, CASE length(link) % 7 WHEN 0 THEN 404 WHEN 1 THEN -3 WHEN 2 THEN 310 ELSE 200 END AS status FROM f)
    SELECT link, status, CASE status WHEN -3 THEN 'Timeout' WHEN 310 THEN 'Too Many Redirects' ELSE CAST(status AS VARCHAR) END AS label, page
    FROM s WHERE NOT (status >= 200 AND status < 400) OR status = -3
""")
def broken_link_report(spark, sf_dir):
    """Bad addresses with their pages, for states that follow from the address."""
    rows = Scratch(spark, "links").table(crawl.page_links(read(spark, sf_dir, "pages")), "links")
    n = F.length("link") % 7
    status = rows.select("link").distinct().select(F.col("link").alias("url"), F.when(n == 0, 404).when(n == 1, -3).when(n == 2, 310).otherwise(200).alias("status"))
    return crawl.broken_links(rows, status)


@query()
def page_prose(spark, sf_dir):
    """Text of pages without markup (H3)."""
    return read(spark, sf_dir, "pages").select("page_id", page_text(F.col("html")).alias("text"))


# ---- relations ----


@query("""
    WITH d AS (SELECT DISTINCT source || '/' || n_chars AS source, lang FROM documents), l AS (SELECT DISTINCT lang FROM d WHERE lang <> 'en'), e AS (SELECT DISTINCT source FROM d WHERE lang = 'en')
    SELECT e.source AS rel_path, l.lang FROM e CROSS JOIN l WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.source = e.source AND d.lang = l.lang)
""")
def missing_translations(spark, sf_dir):
    """English files without a counterpart."""
    pages = read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("n_chars").cast("string")).alias("rel_path"), "lang").distinct()
    return sync.missing_translations(pages.where("lang = 'en'"), pages.select("lang"), pages.where("lang <> 'en'"))


@query("SELECT 'd' AS folder, source AS rel_path, min(text) FILTER (lang = 'de') AS de, min(text) FILTER (lang = 'en') AS en, min(text) FILTER (lang = 'es') AS es, min(text) FILTER (lang = 'fr') AS fr FROM (SELECT source, lang, md5(text) AS text FROM documents) GROUP BY source")
def translation_pivot(spark, sf_dir):
    """Addresses of all languages side by side."""
    pages = read(spark, sf_dir, "documents").select(F.lit("d").alias("folder"), F.col("source").alias("rel_path"), "lang", F.md5(F.col("text").cast("binary")).alias("url"))
    return sync.translation_pivot(pages, ["de", "en", "es", "fr"])


@query("""
    WITH k AS (SELECT lang, CAST(n_chars AS VARCHAR) AS key, CAST(min(doc_id) AS VARCHAR) AS value FROM documents GROUP BY lang, n_chars), l AS (SELECT DISTINCT lang FROM k WHERE lang <> 'en')
    SELECT l.lang, e.key, e.value FROM k e CROSS JOIN l WHERE e.lang = 'en' AND NOT EXISTS (SELECT 1 FROM k WHERE k.lang = l.lang AND k.key = e.key)
    UNION ALL SELECT lang, key, value FROM k
""")
def synced_keys(spark, sf_dir):
    """Keys of all languages over the whole table, where lengths that a language lacks are filled from English."""
    rows = read(spark, sf_dir, "documents").groupBy("lang", F.col("n_chars").cast("string").alias("key")).agg(F.min("doc_id").cast("string").alias("value"))
    return sync.synced_keys(rows)


@query("""
    WITH r AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'user' THEN text END AS title FROM conversations)
    SELECT conv_id AS file, turn AS line, md5(coalesce(last_value(title IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'untitled')) AS nearest FROM r
""")
def nearest_titles(spark, sf_dir):
    """The title at or above each line."""
    lines = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), F.when(F.col("role") == "user", F.col("text")).alias("title"))
    return sync.nearest_titles(lines).select("file", "line", F.md5(F.col("nearest").cast("binary")).alias("nearest"))


@query("""
    SELECT lang AS lang, md5(text) AS address, CAST(arg_min(doc_id, doc_id) AS VARCHAR) AS owner FROM documents WHERE text <> '' GROUP BY lang, text
""")
def address_owners(spark, sf_dir):
    """The first page that claims an address."""
    rows = read(spark, sf_dir, "documents").where("text <> ''")
    pages = rows.select("lang", F.col("doc_id").cast("string").alias("rel_path"), F.col("doc_id").alias("pos"), F.md5(F.col("text").cast("binary")).alias("url"), F.array().cast("array<string>").alias("aliases"))
    return sync.owners(pages)


@query("""
    WITH d AS (SELECT source || '/' || n_chars AS path, lang, md5(text) AS body FROM documents), a AS (SELECT path, max(body) AS body FROM d GROUP BY path), h AS (SELECT path, min(body) AS body FROM d WHERE lang <> 'en' GROUP BY path)
    SELECT a.path, a.body FROM a LEFT JOIN h ON a.path = h.path WHERE h.body IS NULL OR h.body <> a.body
""")
def changed_bodies(spark, sf_dir):
    """Bodies of all documents that are new or differ from those in other languages than English."""
    rows = read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("n_chars").cast("string")).alias("path"), "lang", F.md5(F.col("text").cast("binary")).alias("body"))
    staged = rows.groupBy("path").agg(F.max("body").alias("body"))
    return sync.changed_bodies(staged, rows.where("lang <> 'en'").groupBy("path").agg(F.min("body").alias("body")))


@query("""
    SELECT source, lang, page, count(*) AS n FROM (SELECT source, lang, CAST(ceil(row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) / 60.0) AS BIGINT) AS page FROM documents) GROUP BY ALL
""")
def paginated(spark, sf_dir):
    """Pages of sixty entries, newest first."""
    rows = read(spark, sf_dir, "documents").select("source", "lang", (-F.col("doc_id")).alias("pos"))
    rows = crawl.ranked(rows, ["source", "lang"], "pos").withColumn("page", F.floor(F.col("rank") / 60) + 1)
    return rows.groupBy("source", "lang", "page").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n_pages, sum(n_chars) AS n_urls FROM documents GROUP BY source ORDER BY n_urls DESC, source LIMIT 5")
def largest_folders(spark, sf_dir):
    """The five largest folders, a top-k report."""
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_pages"), F.sum("n_chars").alias("n_urls")).orderBy(F.col("n_urls").desc(), "source").limit(5)


@query("""
    SELECT source, list_slice(list(title ORDER BY doc_id), 1, 5) AS examples FROM (SELECT source, doc_id, left(text, 40) AS title FROM documents) GROUP BY source
""")
def section_examples(spark, sf_dir):
    """The first five titles of each section (A19). Ranked before they are gathered, so no list is longer."""
    order = Window.partitionBy("source").orderBy("doc_id")
    rows = read(spark, sf_dir, "documents").select("source", "doc_id", F.left("text", F.lit(40)).alias("title")).withColumn("rank", F.row_number().over(order)).where("rank <= 5")
    return rows.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("examples"))


@query("""
    SELECT conv_id AS file, q.text || ' ' || a.text AS text FROM conversations q JOIN conversations a USING (conv_id) WHERE a.turn = q.turn + 1 AND q.role = 'user' AND trim(q.text) <> '' AND trim(a.text) <> ''
""")
def faq_export(spark, sf_dir):
    """Question and answer side by side."""
    rows = read(spark, sf_dir, "conversations")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = rows.where("role = 'user'").join(after, ["conv_id", "turn"])
    return sync.faq_rows(pairs.select(F.col("conv_id").alias("file"), F.array(F.struct(F.col("text").alias("question"), "answer")).alias("faq")))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Tumbling windows of events (an extension; the same plan runs on a stream)."""
    from corpusloom.streaming.events import windowed_counts

    return windowed_counts(read(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


# ---- clusters, rules and exports ----


@query()
def density_clusters(spark, sf_dir):
    """Density cluster and leaf of each vector in its section (V11, V12); the method has no SQL form."""
    from corpusloom.operators.cluster import density_clusters as clusters

    return clusters(page_vectors(spark, sf_dir), "section", Scratch(spark, "density"))


@query()
def cluster_tree(spark, sf_dir):
    """All nodes of the cluster tree of each section down to its pages, with their intervals in preorder."""
    from corpusloom.operators import tree
    from corpusloom.operators.cluster import density_clusters as clusters
    from corpusloom.operators.cluster import tree_nodes

    scratch = Scratch(spark, "tree")
    found = scratch.table(clusters(page_vectors(spark, sf_dir), "section", scratch), "clusters")
    return tree.intervals(tree_nodes(found, "section"), scratch)


@query("""
    WITH l AS (SELECT lang, source, doc_id FROM documents),
    n AS (
        SELECT 'site' AS name, 0 AS depth, '' AS lang, '' AS source, -1 AS id, count(*) AS size FROM l
        UNION ALL SELECT lang, 1, lang, '', -1, count(*) FROM l GROUP BY lang
        UNION ALL SELECT source, 2, lang, source, -1, count(*) FROM l GROUP BY lang, source
        UNION ALL SELECT CAST(doc_id AS VARCHAR), 3, lang, source, doc_id, 1 FROM l
    ), p AS (SELECT *, row_number() OVER (ORDER BY encode(lang), encode(source), id) - 1 AS place FROM n)
    SELECT name, depth, size, place, place + CASE depth WHEN 3 THEN 0 WHEN 2 THEN size WHEN 1 THEN size + (SELECT count(DISTINCT source) FROM l WHERE l.lang = p.lang)
           ELSE size + (SELECT count(DISTINCT lang) FROM l) + (SELECT count(*) FROM (SELECT DISTINCT lang, source FROM l)) END AS last
    FROM p
""")
def tree_file_index(spark, sf_dir):
    """The site's tree of languages, sources and documents written as nested JSON over many files, and the index read back (K2)."""
    from corpusloom.operators import tree
    from corpusloom.sources.sinks import write_tree

    scratch = Scratch(spark, "tree-files")
    page = F.concat(F.lit("p"), F.lpad(F.col("doc_id").cast("string"), 19, "0"))
    leaves = read(spark, sf_dir, "documents").select(F.array(F.lit("site"), "lang", "source", page).alias("path"), F.col("doc_id").cast("string").alias("name"))
    nodes = tree.with_ancestors(leaves).withColumn("name", F.coalesce("name", F.element_at("path", -1)))
    write_tree(tree.intervals(nodes, scratch), scratch.root + "/site")
    return spark.read.schema("name string, depth int, size long, place long, last long").json(f"{scratch.root}/site/index")


@query()
def kmeans_clusters(spark, sf_dir):
    """Cluster of each vector by k-means (V14); equal to a loop by hand in the tests."""
    from corpusloom.operators.kmeans import kmeans

    return kmeans(page_vectors(spark, sf_dir), 10, Scratch(spark, "kmeans"))


@query()
def batch_clusters(spark, sf_dir):
    """Cluster of each vector by batches in a fixed order, as many clusters as a collection gets."""
    from corpusloom.operators.kmeans import content_k, mini_batch

    rows = page_vectors(spark, sf_dir)
    return mini_batch(rows, content_k(rows.count()), Scratch(spark, "batches"))


@query("""
    WITH n AS (SELECT count(*) AS n, least(40, greatest(count(*) // 10, 5)) AS k FROM embeddings)
    SELECT vec_id AS id, CAST((row_number() OVER (ORDER BY vec_id) - 1) // (n // k + 1) AS INT) AS cluster FROM embeddings CROSS JOIN n
""")
def sequential_clusters(spark, sf_dir):
    """Runs of ids as clusters, where nothing can be learned."""
    from corpusloom.operators.kmeans import content_k, sequential

    rows = page_vectors(spark, sf_dir)
    return sequential(rows, content_k(rows.count()), Scratch(spark, "runs"))


@query()
def map_points(spark, sf_dir):
    """Two coordinates of each vector on a map that keeps neighbourhoods."""
    from corpusloom.operators.cluster import map_2d

    return map_2d(page_vectors(spark, sf_dir), Scratch(spark, "map"))


@query("SELECT section AS cluster, min(x) AS x, count(*) AS size FROM (SELECT label AS section, round(avg(CAST(embedding[1] AS DOUBLE)) OVER (PARTITION BY label), 6) AS x FROM embeddings) GROUP BY section")
def cluster_centres(spark, sf_dir):
    """Centre and size of every cluster."""
    from corpusloom.operators.cluster import cluster_centres as centres

    points = page_vectors(spark, sf_dir).select(F.col("section").alias("cluster"), V.doubles(F.col("vec"))[0].alias("x"), V.doubles(F.col("vec"))[1].alias("y"))
    return centres(points, 10).select("cluster", six("x").alias("x"), "size")


@query("SELECT count(*) AS n_clusters, min(n) AS min_size, max(n) AS max_size, avg(n) AS avg_size FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def cluster_sizes(spark, sf_dir):
    """Number and sizes of clusters (A5)."""
    from corpusloom.operators.cluster import cluster_sizes as sizes

    return sizes(page_vectors(spark, sf_dir).select("id", F.col("section").alias("cluster")))


@query()
def linked_pages(spark, sf_dir):
    """Pages with links by keyword rules (V22, J7): the rules are the benchmark's first two words."""
    from corpusloom.operators.linking import link_pages

    rules = read(spark, sf_dir, "benchmark").select(F.lower(F.substring_index("text", " ", 2)).alias("keyword"), F.format_string("/item/%d/", "item_id").alias("url"), F.lit("").alias("title"), (F.lit(1000) - F.col("item_id")).cast("int").alias("priority"))
    common = spark.createDataFrame([("the", "/the/", "", 1), ("and", "/and/", "", 2)], "keyword string, url string, title string, priority int")
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html")
    return link_pages(pages, rules.unionByName(common)).select("id", "keywords", "urls", "n_links")


@query()
def link_recommendations(spark, sf_dir):
    """Recommended links between all documents, from each of their lines as a paragraph."""
    from corpusloom.operators.linking import LinkLimits, recommend_links

    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    title = F.substring_index(F.col("text"), " ", 4)
    pages = docs.select("id", F.format_string("/p/%d/", "id").alias("url"), title.alias("title"), F.lit("").alias("description"), F.array(F.lower(title)).alias("keywords"), F.array().cast("array<string>").alias("existing"), hashed_vector(F.col("text")).cast("array<float>").alias("vec"))
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("para", "text")).where(F.trim("text") != "")
    paragraphs = lines.select("id", "para", "text", hashed_vector(F.col("text")).cast("array<float>").alias("vec"))
    limits = LinkLimits(similarity=0.2, lift=-2.0, anchor=0.0)
    return recommend_links(pages, paragraphs, limits)


@query()
def page_keywords(spark, sf_dir):
    """Keywords of each whole document, its lines taken for headings."""
    from corpusloom.operators.keywords import page_keywords as extract

    docs = read(spark, sf_dir, "documents")
    headed = F.concat(F.lit("# "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n# ")))
    return docs.select("doc_id", extract(F.lit(""), F.lit(""), headed).alias("keywords"))


@query()
def slugs(spark, sf_dir):
    """Slugs of whole texts, within the operator's own limit."""
    from corpusloom.functions.slugs import slug

    return read(spark, sf_dir, "documents").select("doc_id", slug(F.col("text"), F.col("lang")).alias("slug"))


@query("""
    WITH i AS (SELECT DISTINCT lang, source AS dir FROM documents WHERE lang <> 'en'), r AS (SELECT '/' || lang || '/' || dir AS f, '/' || lang || '/' || replace(dir, 'src', 'q') AS t FROM i)
    SELECT f || '/' AS source, t || '/' AS target, '301' AS status FROM r UNION ALL SELECT f || '/*', t || '/:splat', '301' FROM r
""")
def redirect_rules(spark, sf_dir):
    """Redirects of folders whose address is another."""
    folders = read(spark, sf_dir, "documents").select("lang", F.col("source").alias("dir")).distinct()
    return sync.redirects(folders.withColumn("url", F.concat_ws("/", F.lit(""), "lang", F.replace("dir", F.lit("src"), F.lit("q")), F.lit(""))))


@query("""
    WITH i AS (SELECT DISTINCT lang, source AS dir FROM documents)
    SELECT lang, dir, CASE WHEN lang = 'en' THEN '/' ELSE '/' || lang || '/' END || CASE WHEN length(dir) = 4 THEN 'x' || dir ELSE dir END || '/' AS url FROM i
""")
def directory_urls(spark, sf_dir):
    """Addresses of folders from stated slugs."""
    folders = read(spark, sf_dir, "documents").select("lang", F.col("source").alias("dir")).distinct()
    stated = folders.where(F.length("dir") == 4).withColumn("slug", F.concat(F.lit("x"), "dir"))
    return sync.directory_urls(stated, folders)


@query("""
    SELECT DISTINCT doc_id, 'new' AS state FROM labels UNION ALL SELECT doc_id, 'old' FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)
""")
def upserted(spark, sf_dir):
    """All labels in place of the documents with their ids."""
    from corpusloom.sources.sinks import upsert

    old, new = (read(spark, sf_dir, name).select("doc_id").withColumn("state", F.lit(state)) for name, state in (("documents", "old"), ("labels", "new")))
    return upsert(old, new, ["doc_id"])


@query("""
    WITH w AS (SELECT source AS keyword, lang AS url, length(source) AS n, CAST(doc_id % 5 AS INT) AS priority FROM documents)
    SELECT keyword, url, max(priority) AS priority FROM w GROUP BY keyword, url
""")
def keyword_rules(spark, sf_dir):
    """Rules with the best of each keyword and address (S9, W5, SE6)."""
    from corpusloom.sources.tables import keyword_rules as merged

    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("Keyword"), F.col("lang").alias("url"), (F.col("doc_id") % 5).alias("priority"))
    return merged(rows.where("priority < 3"), rows.where("priority >= 2")).select("keyword", "url", "priority")


@query("SELECT url AS link, min(page_id) AS page_id FROM pages GROUP BY url")
def distinct_addresses(spark, sf_dir):
    """Addresses once, at their first position (SE2)."""
    return crawl.ordered_distinct(read(spark, sf_dir, "pages").select(F.col("url").alias("link"), "page_id"), "link", "page_id")


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def run_report(spark, sf_dir):
    """Counts by state."""
    from corpusloom.sources.sinks import run_report as report

    return report(read(spark, sf_dir, "events").select(F.col("event_type").alias("status")))


@query("SELECT doc_id, CASE WHEN lang IN ('de', 'es', 'fr') THEN 'eu' ELSE 'row' END AS region FROM documents")
def consent_regions(spark, sf_dir):
    """Consent bucket by country code."""
    return read(spark, sf_dir, "documents").select("doc_id", X.consent_region(F.col("lang")).alias("region"))
