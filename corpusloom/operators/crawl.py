"""Link checking over static pages, and site map splitting."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import urls as U
from corpusloom.functions.html import links
from corpusloom.operators.order import numbered
from corpusloom.plans.scratch import Scratch, partitions


def page_links(pages: DataFrame, prefixes: tuple[str, ...] = (), internal: str | None = None, external: str | None = None) -> DataFrame:
    """(page, link) of all addresses that pages (url, html) refer to; only those to a host, or only others."""
    rows = pages.select(F.col("url").alias("page"), F.explode(links(F.col("html"), F.col("url"), prefixes)).alias("link"))
    if internal:
        rows = rows.where(U.same_host(F.col("link"), internal))
    if external:
        rows = rows.where(~U.same_host(F.col("link"), external))
    return rows


def inverted(rows: DataFrame) -> DataFrame:
    """(link, page), each once: the pages that refer to an address, a row each, as every page may refer to one."""
    return rows.select("link", "page").distinct()


def broken_links(rows: DataFrame, status: DataFrame) -> DataFrame:
    """(status, link, label, page) of addresses with a bad state and the pages that refer to them, in the order of the report.

    An address without a known state isn't reported.
    """
    bad = status.where(U.broken(F.col("status"))).select("url", "status").dropDuplicates(["url"])
    hit = rows.join(bad, rows["link"] == bad["url"])
    return hit.select("status", "link", U.status_label(F.col("status")).alias("label"), "page").distinct().orderBy("status", "link", "page")


def unknown_links(rows: DataFrame, status: DataFrame) -> DataFrame:
    """Addresses that a check still has to visit."""
    return rows.select("link").distinct().join(status.select(F.col("url").alias("link")), "link", "left_anti")


def ordered_distinct(rows: DataFrame, key: str, position: str) -> DataFrame:
    """One row a key, at its first position, in that order."""
    return rows.groupBy(key).agg(F.min(position).alias(position)).orderBy(position)


def ranked(rows: DataFrame, keys: list[str], position: str, width: int = 100_000) -> DataFrame:
    """The rows with rank, from 0, of their whole-number position within equal keys.

    A hot key is not sorted in one task: positions are first counted by slice, and a row's
    rank is its rank in the slice after the rows of earlier slices.
    """
    sliced = rows.withColumn("__slice", F.floor(F.col(position) / width))
    counts = sliced.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, "__slice").orderBy(position)
    return sliced.join(starts, [*keys, "__slice"]).withColumn("rank", F.col("__start") + F.row_number().over(inside) - 1).drop("__slice", "__start")


def split_sitemap(entries: DataFrame, most: int = 10_000) -> DataFrame:
    """(section, chunk, pos, loc, lastmod): entries of a section in file order, ``most`` a chunk."""
    rows = entries.select(U.sitemap_section(F.col("loc")).alias("section"), "pos", "loc", "lastmod")
    return ranked(rows, ["section"], "pos").select("section", F.floor(F.col("rank") / most).cast("int").alias("chunk"), "pos", "loc", "lastmod")


def site_base(entries: DataFrame) -> DataFrame:
    """One row with the base address: that of the first entry that has one at all."""
    filled = entries.where("coalesce(trim(loc), '') <> ''")
    return filled.agg(F.min_by("loc", "pos").alias("loc")).select(U.base_url(F.col("loc")).alias("base"))


def unused_images(images: DataFrame, bodies: DataFrame) -> DataFrame:
    """Images (name) whose name is in no markdown text (path, body), whatever characters it has."""
    return images.join(image_mentions(images, bodies).select("name").distinct(), "name", "left_anti")


def image_mentions(images: DataFrame, bodies: DataFrame, most_bytes: int = 4 << 20) -> DataFrame:
    """(name, path): the markdown texts (path, body) that have an image's name (name) in them, a row each.

    Names are patterns of an Aho-Corasick automaton. Names of at most ``most_bytes`` together
    go to all tasks, which pass their texts by it; more are dealt into automata of that
    size, and texts into slices, so that every slice passes by every automaton and no task
    holds all of either. A null name or text is in nothing; an empty name is in every text.
    """
    names = images.select(F.col("name").cast("string").alias("name")).where("name IS NOT NULL").distinct()
    texts = bodies.select(F.col("path").cast("string").alias("path"), F.col("body").cast("string").alias("body")).where("body IS NOT NULL")
    total = names.agg(F.sum(F.octet_length("name") + 16)).first()[0] or 0
    if total <= most_bytes:
        held = sorted(r.name for r in names.collect())  # of checked size

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _Names(held)
            for batch in batches:
                yield from automaton.mentions(batch.column("path"), batch.column("body"))

        return texts.mapInArrow(scan, "name string, path string").distinct()
    automata, slices = math.ceil(total / most_bytes), partitions(images.sparkSession)
    place = lambda x, n: F.pmod(F.xxhash64(x), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("string")
    patterns = names.select(place("name", automata).alias("automaton"), each(slices).alias("slice"), F.lit(0).alias("kind"), "name", none.alias("path"), none.alias("body"))
    passing = texts.select(each(automata).alias("automaton"), place(F.struct("path", "body"), slices).alias("slice"), F.lit(1).alias("kind"), none.alias("name"), "path", "body")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, automaton = None, [], None
        for batch in batches:
            at = list(zip(*(batch.column(c).to_pylist() for c in ("automaton", "slice", "kind")), strict=True))
            start = 0
            while start < len(at):
                end = start
                while end < len(at) and at[end] == at[start]:
                    end += 1
                if at[start][:2] != now:
                    now, held, automaton = at[start][:2], [], None
                if at[start][2] == 0:
                    held += batch.column("name").slice(start, end - start).to_pylist()
                elif held:
                    automaton = automaton or _Names(held)
                    yield from automaton.mentions(batch.column("path").slice(start, end - start), batch.column("body").slice(start, end - start))
                start = end

    dealt = patterns.unionByName(passing).repartition(slices, "automaton", "slice").sortWithinPartitions("automaton", "slice", "kind")
    return dealt.mapInArrow(stream, "name string, path string").distinct()


class _Names:
    """An automaton of names."""

    def __init__(self, names: list[str]):
        import ahocorasick

        self.everywhere = "" in names
        self.automaton = ahocorasick.Automaton()
        for name in names:
            if name:
                self.automaton.add_word(name, name)
        if len(self.automaton):
            self.automaton.make_automaton()

    def mentions(self, paths: pa.Array, bodies: pa.Array) -> Iterator[pa.RecordBatch]:
        """(name, path) of each text's names, some thousand rows at a time."""
        found: list[str] = []
        of: list[str | None] = []
        for path, body in zip(paths, bodies, strict=True):
            text = body.as_py()
            own = {name for _, name in self.automaton.iter(text)} if len(self.automaton) else set()
            if self.everywhere:
                own.add("")
            found += own
            of += [path.as_py()] * len(own)
            if len(found) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(of, pa.string())], names=["name", "path"])
                found, of = [], []
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(of, pa.string())], names=["name", "path"])


def duplicate_files(images: DataFrame, scratch: Scratch) -> DataFrame:
    """(digest, path, rank) of files of equal content, a row each, the largest picture first. images: path, digest, pixels."""
    several = images.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    rows = images.join(several, "digest").select("digest", "path", (-F.coalesce("pixels", F.lit(0))).alias("down"))
    return numbered(rows, ["digest"], ["down", "path"], "rank", scratch).select("digest", "path", (F.col("rank") + 1).alias("rank"))
