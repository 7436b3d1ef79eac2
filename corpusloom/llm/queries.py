"""The queries of this subpackage over the test tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; it is the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.toxicity import fit, score

    docs = _read(spark, sf_dir, "documents")
    return score(docs, fit(docs, _read(spark, sf_dir, "labels")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.embedding_dedup import link_vectors

    return link_vectors(_read(spark, sf_dir, "embeddings"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.exact_dedup import exact_dedup

    return exact_dedup(_read(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.ngram_join import Similarity, link_documents

    return link_documents(_read(spark, sf_dir, "documents"), Similarity(words=3, least=90, scale=100))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.substring_dedup import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents")).drop("kept_text")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.license_scan import scan_licenses

    return scan_licenses(_read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.plans.scratch import Scratch
    from corpusloom.llm.warc import read_archives, write_archives

    scratch = Scratch(spark, "warc")
    manifest = write_archives(_read(spark, sf_dir, "pages"), scratch.path("archives"), scratch)
    return read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.html_text import extract_pages

    return extract_pages(_read(spark, sf_dir, "pages"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.spm_bpe import encode_documents

    return encode_documents(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from corpusloom.llm.merkle import leaf_digest, manifest, siblings, verified

    docs = _read(spark, sf_dir, "documents")
    changed = leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.try_add("n_chars", F.lit(1)), F.col("text"))
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    rows = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], keep={"changed": F.when(hit, changed)})
    out = verified(rows, F.coalesce("changed", "leaf")).withColumn("proof_sha256", F.sha2(siblings(F.col("proof")).cast("binary"), 256))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.divergence import divergence

    return divergence(_read(spark, sf_dir, "documents"))


def op13_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.retrieval_packing import pack_by_retrieval

    return pack_by_retrieval(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_ngram_join": op4_ngram_join,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_html_text": op9_html_text,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_merkle": op11_merkle,
    "op12_divergence": op12_divergence,
    "op13_retrieval_packing": op13_retrieval_packing,
}

def _field(name: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


_LEAF = "sha256(" + " || ".join(_field(c) if c != "n_chars" else "{n}" for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"

ORACLES = {
    "op11_merkle": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, lang, n_chars, {_LEAF.format(n=_field("n_chars"))} AS leaf, {_LEAF.format(n=_field("(n_chars + 1)"))} AS changed,
                   list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT)),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) AS crc
            FROM documents
        ), c AS (
            SELECT doc_id, lang, leaf, CASE WHEN n_chars IS NOT NULL AND xor(crc, 4294967295) % 7 = 0 THEN changed ELSE leaf END AS claimed,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d
        ), t(lvl, lang, i, h, n) AS (
            SELECT 0, lang, i, leaf, n FROM c
            UNION ALL SELECT lvl + 1, lang, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lvl, lang, i // 2, n
        ), s AS (
            SELECT lvl AS height, lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS j, count(*) OVER () AS m FROM t WHERE n = 1
        ), u(lvl, i, h, n) AS (
            SELECT 0, j, subroot, m FROM s
            UNION ALL SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, i // 2, n
        ), r AS (
            SELECT h AS root, lvl AS top FROM u WHERE n = 1
        ), e AS (
            SELECT c.lang, c.i, c.i AS k, unnest(range(height)) AS l, 0 AS part FROM c JOIN s ON c.lang IS NOT DISTINCT FROM s.lang
            UNION ALL SELECT c.lang, c.i, s.j, unnest(range(top)), 1 FROM c JOIN s ON c.lang IS NOT DISTINCT FROM s.lang CROSS JOIN r
        ), f AS (
            SELECT e.lang, e.i, e.part, e.l, coalesce(CASE WHEN (e.k >> e.l) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(t.h, u.h), '-') AS s
            FROM e LEFT JOIN t ON e.part = 0 AND t.lang IS NOT DISTINCT FROM e.lang AND t.lvl = e.l AND t.i = xor(e.k >> e.l, 1)
            LEFT JOIN u ON e.part = 1 AND u.lvl = e.l AND u.i = xor(e.k >> e.l, 1)
        ), p AS (
            SELECT lang, i, list(s ORDER BY part, l) AS s, string_agg(CASE WHEN s = '-' THEN '' ELSE substr(s, 2) END, '' ORDER BY part, l) AS joined FROM f GROUP BY lang, i
        ), o AS (
            SELECT c.doc_id, c.leaf, s.subroot, r.root, sha256(coalesce(p.joined, '')) AS proof_sha256,
                   list_reduce(list_prepend(c.claimed, coalesce(p.s, CAST([] AS VARCHAR[]))), lambda h, x: CASE x[1] WHEN 'L' THEN sha256(substr(x, 2) || h) WHEN 'R' THEN sha256(h || substr(x, 2)) ELSE sha256(h) END) AS folded_root
            FROM c JOIN s ON c.lang IS NOT DISTINCT FROM s.lang CROSS JOIN r LEFT JOIN p ON p.lang IS NOT DISTINCT FROM c.lang AND p.i = c.i
        )
        SELECT *, folded_root = root AS verified FROM o
    """,
    "op12_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), t AS (SELECT id, lang, source, unnest(w) AS term FROM d
        ), k AS (SELECT lang, term, count(*) AS n_lang FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30
        ), g AS (SELECT DISTINCT lang, source FROM d
        ), c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL
        ), l AS (SELECT lang, count(*) AS v, sum(n_lang) AS nl FROM k GROUP BY lang
        ), s AS (SELECT lang, source, sum(n) AS ns FROM c GROUP BY ALL
        ), x AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.ns, 0) + 5 * l.v) AS BIGINT) AS p,
                   CAST(1 + (1000000000::HUGEINT * (k.n_lang + 5)) // (l.nl + 5 * l.v) AS BIGINT) AS q
            FROM g JOIN k ON g.lang = k.lang JOIN l ON l.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
            LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), f AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), o AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL SELECT lang, source, 'term', term, p - q FROM x WHERE n > 0 AND p > q
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM o)
        SELECT * FROM r WHERE part = 'pair' OR rank <= 50
    """,
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
               text_sha256
        FROM d
    """,
    "op7_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
}
