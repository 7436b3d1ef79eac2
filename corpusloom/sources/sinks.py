"""Writers: the shapes in which results leave, each made by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.tree import json_pieces
from corpusloom.plans.scratch import partitions


def section_json(related: DataFrame, path: str) -> None:
    """One folder per language and section, a row per slug with its related pages in rank order.

    related: lang, section, slug, rank, and the columns of an item.
    """
    item = F.struct("rank", *[c for c in related.columns if c not in ("lang", "section", "slug", "rank")])
    rows = related.groupBy("lang", "section", "slug").agg(F.sort_array(F.collect_list(item)).alias("related"))
    rows.sortWithinPartitions("slug").write.partitionBy("lang", "section").mode("overwrite").json(path)


def csv_report(rows: DataFrame, path: str) -> None:
    rows.write.option("header", "true").mode("overwrite").csv(path)


def json_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def scatter_json(points: DataFrame) -> DataFrame:
    """One JSON object a row for a scatter plot: id, x, y, and the other columns as properties."""
    return points.select(F.to_json(F.struct(*points.columns)).alias("value"))


def write_tree(placed: DataFrame, path: str) -> None:
    """A nested JSON document in files that follow each other by name, and an index of its nodes.

    placed: tree.intervals with name and size. No task holds more than its range of nodes;
    the files below ``tree``, joined in the order of their names, are the document. index
    has a row a node: place, last, depth, name, size.
    """
    pieces = json_pieces(placed)
    pieces.repartitionByRange(partitions(placed.sparkSession), "place").sortWithinPartitions("place").select("piece").write.mode("overwrite").text(f"{path}/tree")
    placed.select("place", "last", (F.size("path") - 1).alias("depth"), "name", "size").write.mode("overwrite").json(f"{path}/index")


def sitemap_files(chunks: DataFrame, path: str) -> None:
    """Site map files: chunks has section, chunk, pos, loc, lastmod."""
    row = F.concat(F.lit("  <url><loc>"), _xml(F.col("loc")), F.lit("</loc>"), F.when(F.coalesce("lastmod", F.lit("")) != "", F.concat(F.lit("<lastmod>"), F.col("lastmod"), F.lit("</lastmod>"))).otherwise(F.lit("")), F.lit("</url>"))
    body = chunks.select("section", "chunk", "pos", row.alias("row")).groupBy("section", "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "row"))), lambda x: x["row"]), "\n").alias("rows"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
    body.select("section", "chunk", F.concat(F.lit(head), F.col("rows"), F.lit("\n</urlset>")).alias("value")).write.partitionBy("section", "chunk").mode("overwrite").text(path)


def sitemap_index(chunks: DataFrame, base: str) -> DataFrame:
    """(section, chunk, loc, lastmod, n_urls) of each file: lastmod is the greatest text of its entries, empty ones apart."""
    stamp = F.max(F.nullif(F.trim("lastmod"), F.lit("")))
    rows = chunks.groupBy("section", "chunk").agg(stamp.alias("lastmod"), F.count("*").alias("n_urls"))
    name = F.concat(F.lit(base.rstrip("/") + "/sitemap-"), "section", F.when(F.col("chunk") > 0, F.concat(F.lit("-"), (F.col("chunk") + 1).cast("string"))).otherwise(F.lit("")), F.lit(".xml"))
    return rows.withColumn("loc", name).orderBy(F.col("section") != "general", "section", "chunk")


def _xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def redirect_lines(redirects: DataFrame) -> DataFrame:
    """Lines of a redirects file, and the same rule as JSON with bracketed wildcards."""
    line = F.format_string("%s %s %s", "source", "target", "status")
    as_json = F.to_json(F.struct(F.replace("source", F.lit("/*"), F.lit("/<*>")).alias("source"), F.replace("target", F.lit("/:splat"), F.lit("/<*>")).alias("target"), "status"))
    return redirects.select(line.alias("line"), as_json.alias("json"))


def folder_json(urls: DataFrame, path: str) -> None:
    """A folder of JSON for each content folder, hyphens in its name as underscores. urls: folder, rel_path, urls (map)."""
    urls.withColumn("folder", F.when(F.col("folder") == "", "_root").otherwise(F.translate("folder", "-", "_"))).write.partitionBy("folder").mode("overwrite").json(path)


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table with new rows in place of those with their keys; of new rows with equal keys one stays."""
    fresh = new.dropDuplicates(keys)
    return table.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def search_index(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """JSON rows of regular pages and of taxonomy terms for a search index."""
    page = pages.select("title", "permalink", "description", "tags", F.lit("page").alias("kind"))
    term = terms.select("title", "permalink", F.lit("").alias("description"), F.array().cast("array<string>").alias("tags"), F.lit("term").alias("kind"))
    return page.unionByName(term).select(F.to_json(F.struct("title", "permalink", "description", "tags", "kind")).alias("value"))


def sitemap_pages(pages: DataFrame, lang: str) -> DataFrame:
    """Pages that a language's site map lists."""
    return pages.where((F.col("lang") == lang) & ~F.coalesce("sitemap_exclude", F.lit(False)) & ~F.coalesce("private", F.lit(False)))


def robots_text(languages: DataFrame, base: str) -> DataFrame:
    """Robots lines of each language."""
    return languages.select("lang", F.format_string("User-agent: *\nAllow: /\nSitemap: %s/%s/sitemap.xml", F.lit(base.rstrip("/")), "lang").alias("value"))


def breadcrumb_json(crumbs: Column) -> Column:
    """JSON-LD of a path of (name, url): positions count from one before items without a name go, so gaps stay."""
    placed = F.transform(crumbs, lambda c, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), c["name"].alias("name"), c["url"].alias("item")))
    named = F.filter(placed, lambda c: F.coalesce(c["name"], F.lit("")) != "")
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"), named.alias("itemListElement")))


def faq_json(faq: Column) -> Column:
    """JSON-LD of questions and answers."""
    items = F.transform(faq, lambda q: F.struct(F.lit("Question").alias("@type"), q["question"].alias("name"), F.struct(F.lit("Answer").alias("@type"), q["answer"].alias("text")).alias("acceptedAnswer")))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("FAQPage").alias("@type"), items.alias("mainEntity")))


def run_report(results: DataFrame) -> DataFrame:
    """Counts of results by status."""
    return results.groupBy("status").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "status")
