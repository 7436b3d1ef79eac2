"""Readers of tabular, configuration and site map files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.scratch import Scratch, partitions
from corpusloom.sources.stores import list_files, open_store


def sniff_delimiter(line: str) -> str:
    """The most frequent of comma, semicolon and tab in a header line; a semicolon where there is none."""
    counts = {d: line.count(d) for d in (",", ";", "\t")}
    best = max(counts, key=counts.__getitem__)
    return best if counts[best] else ";"


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(flow_input, filename) of a CSV with both columns, or of a text file with one topic a line. Blank rows go."""
    if path.endswith(".csv"):
        first = spark.read.text(path).where("trim(value) <> ''").first()
        rows = spark.read.option("header", "true").option("sep", sniff_delimiter(first.value if first else "")).csv(path)
        rows = rows.toDF(*[c.strip().lstrip("﻿") for c in rows.columns])
        missing = {"flow_input", "filename"} - set(rows.columns)
        if missing:
            raise ValueError(f"{path} lacks the columns {sorted(missing)}")
        rows = rows.select(F.trim("flow_input").alias("flow_input"), F.trim("filename").alias("filename"))
        return rows.where("flow_input <> '' AND filename <> ''")
    lines = spark.read.text(path).select(F.trim("value").alias("flow_input")).where("flow_input <> ''")
    safe = F.regexp_replace(F.regexp_replace(F.lower("flow_input"), r"[^a-z0-9]+", "-"), r"\A-+|-+\z", "")
    return lines.withColumn("filename", F.substring(safe, 1, 50))


def new_topics(topics: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Topics whose file is not there yet, or all."""
    return topics if overwrite else topics.join(existing.select("filename").distinct(), "filename", "left_anti")


def read_yaml_keys(spark: SparkSession, path: str) -> DataFrame:
    """(lang, key, value) of YAML files named after their language. A repeated key has its last value."""
    files = spark.read.option("pathGlobFilter", "*.y*ml").format("binaryFile").load(path)
    rows = files.select(F.regexp_extract("path", r"([^/]+)\.ya?ml\z", 1).alias("lang"), F.decode("content", "UTF-8").alias("raw"))

    @F.pandas_udf("map<string, string>")
    def parse(texts: pd.Series) -> pd.Series:
        import yaml

        out = []
        for text in texts:
            loaded = yaml.safe_load(text) or {}
            if isinstance(loaded, list):
                loaded = {x.get("id"): x.get("translation") for x in loaded if isinstance(x, dict)}
            out.append({str(k): None if v is None else v if isinstance(v, str) else str(v.get("other", v) if isinstance(v, dict) else v) for k, v in loaded.items()})
        return pd.Series(out)

    return rows.select("lang", F.explode(parse("raw")).alias("key", "value"))


def duplicate_keys(lines: DataFrame) -> DataFrame:
    """(file, key, line) of all lines that define a key which their file defines more than once. lines: file, line, text."""
    key = F.regexp_extract("text", r"\A([A-Za-z0-9_.\-]+)\s*:", 1)
    rows = lines.select("file", "line", key.alias("key")).where("key <> ''")
    several = rows.groupBy("file", "key").agg(F.count("*").alias("n")).where("n > 1").select("file", "key")
    return rows.join(several, ["file", "key"]).select("file", "key", "line")


RULE = "keyword string, Keyword string, url string, URL string, title string, Title string, priority int, Priority int, exact boolean"


def keyword_rules(common: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Keyword rules of all languages and of one: (keyword, url, title, priority), names of either case, blank ones out.

    Of the same keyword and address the one of highest priority, then of longer keyword, stays.
    """

    def read(rules: DataFrame) -> DataFrame:
        low = {}
        for c in rules.columns:
            low.setdefault(c.lower(), []).append(F.col(f"`{c}`"))
        pick = lambda n, other: F.coalesce(*low.get(n, []), other)
        return rules.select(
            F.trim(pick("keyword", F.lit(""))).alias("keyword"),
            F.trim(pick("url", F.lit(""))).alias("url"),
            pick("title", F.lit("")).alias("title"),
            pick("priority", F.lit(0)).cast("int").alias("priority"),
        ).where("keyword <> '' AND url <> ''")

    rules = read(common) if own is None else read(common).unionByName(read(own))
    best = F.max(F.struct("priority", F.length("keyword").alias("n"), "keyword", "title")).alias("b")
    return rules.groupBy(F.lower("keyword").alias("k"), "url").agg(best).select("b.keyword", "url", "b.title", "b.priority")


def read_keyword_json(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON file that is a list, or an object with the list under ``keywords``."""
    raw = spark.read.option("wholetext", "true").text(path)
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{_fields()}>>")).otherwise(F.from_json("value", f"struct<keywords: array<struct<{_fields()}>>>").getField("keywords"))
    return raw.select(F.explode(listed).alias("r")).select("r.*")


def _fields() -> str:
    return "keyword: string, url: string, title: string, priority: int"


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(pos, loc, lastmod) of a site map's entries, in file order."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return rows.select(F.monotonically_increasing_id().alias("pos"), F.trim("loc").alias("loc"), F.trim("lastmod").alias("lastmod"))


def sitemap_locs(xml: Column) -> Column:
    """Addresses in the text of a site map or of a site map index."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def expand_sitemaps(fetched: DataFrame, start: DataFrame) -> DataFrame:
    """Addresses of the pages of the start maps, with one level of index expansion, first occurrence kept.

    fetched: url, xml (the texts that a fetch gave). start: pos, url.
    """
    isindex = F.col("xml").contains("<sitemapindex")
    top = start.join(fetched, "url").select("pos", isindex.alias("isindex"), F.posexplode(sitemap_locs(F.col("xml"))).alias("i", "loc"))
    inner = top.where("isindex").join(fetched.withColumnRenamed("url", "loc"), "loc").select("pos", F.col("i").alias("j"), F.posexplode(sitemap_locs(F.col("xml"))).alias("i", "loc"))
    flat = top.where("NOT isindex").select("pos", F.lit(0).alias("j"), "i", "loc")
    order = F.struct("pos", "j", "i")
    return inner.select("pos", "j", "i", "loc").union(flat).groupBy("loc").agg(F.min(order).alias("at"))


def robots_sitemaps(robots: Column) -> Column:
    """Addresses of the Sitemap lines of a robots.txt."""
    lines = F.filter(F.split(robots, r"\r?\n"), lambda x: F.lower(F.trim(x)).startswith("sitemap:"))
    return F.transform(lines, lambda x: F.trim(F.regexp_extract(x, r"\A[^:]*:(.*)\z", 1)))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, digest) of image files; processed copies and hidden files are passed over, and a file that goes meanwhile.

    Files are listed by tasks and only images are opened, a piece at a time.
    """
    # Endings of image files.
    wanted = F.lower("inside").rlike(r"\.(jpg|jpeg|png|gif|webp|bmp)\z") & ~F.col("inside").rlike(r"(\A|/)(\.|_[^/=]*(/|\z))")
    listed = list_files(spark, path, Scratch(spark, "images"), but=frozenset(["processed"])).where(wanted).select("inside")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_store(path)
        for frame in frames:
            rows = []
            for inside in frame["inside"]:
                digest, length = hashlib.sha256(), 0
                try:
                    with store.open_input_stream(f"{base}/{inside}") as file:
                        while piece := file.read(1 << 20):
                            digest.update(piece)
                            length += len(piece)
                except FileNotFoundError:
                    continue
                rows.append((f"{path}/{inside}", length, digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "length", "digest"])

    return listed.repartition(partitions(spark)).mapInPandas(run, "path string, length long, digest string")


def cached_vectors(cache: DataFrame, model: str, keys: DataFrame) -> DataFrame:
    """The cache's vectors of one model for the wanted hashes (column text_hash); misses have a null vector."""
    own = cache.where(F.col("model") == model).groupBy("text_hash").agg(F.first("vec").alias("vec"))
    return keys.select("text_hash").distinct().join(own, "text_hash", "left")


def path_cache(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, hash, vec): a hit only where the stored hash of the path is equal; else vec is null."""
    stored = cache.select("path", F.col("hash").alias("stored"), F.col("vec").alias("held"))
    return rows.join(stored, "path", "left").select("path", "hash", F.when(F.col("stored") == F.col("hash"), F.col("held")).alias("vec"))
