"""Site audit: how focused a collection of page vectors is, which pages drift, which repeat others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators.vector import centroids, usable
from corpusloom.plans.scratch import Scratch


#: Below so many rows of a group its values are aggregated together, above only those near the percentile are ranked, so far on either side.
SMALL_GROUP, NEAR = 10_000, 0.002


def focus_columns(sim: Column) -> list[Column]:
    """Aggregates over the similarities to a centre: focus is their mean, radius their spread as distances."""
    dist = 1 - sim
    return [F.avg(sim).alias("focus"), F.stddev_pop(dist).alias("radius"), F.avg(dist).alias("mean_dist"), F.max(dist).alias("max_dist"), F.count("*").alias("n_pages")]


def percentiles(rows: DataFrame, value: str, points: dict[str, float], group: str | None = None) -> DataFrame:
    """One row a group (or one row) with the exact, interpolated percentiles, each under its name.

    Groups of fewer than SMALL_GROUP rows have all theirs in one aggregation. In larger ones
    a sketch of bounded size brackets each percentile, and only rows inside the bracket are
    ranked, so no task holds a group's values; there ``rows`` is read twice a point.
    """
    g = F.col(group) if group else F.lit(0)
    held = rows.select(g.alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    named = [F.col("g").alias(group)] if group else []
    together = lambda part: part.groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(name) for name, p in points.items()]).select(*named, *points)
    large = held.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= SMALL_GROUP).select("g")
    if large.isEmpty():
        return together(held)
    return together(held.join(large, "g", "left_anti")).unionByName(_bracketed(held.join(large, "g", "left_semi"), points).select(*named, *points))


def _bracketed(held: DataFrame, points: dict[str, float]) -> DataFrame:
    """(g, the percentiles) of large groups (g, v)."""
    out = None
    for name, point in points.items():
        near = F.percentile_approx("v", F.array(F.lit(max(0.0, point - NEAR)), F.lit(min(1.0, point + NEAR))), 5_000)
        stats = held.groupBy("g").agg(F.count("*").alias("n"), near[0].alias("lo"), near[1].alias("hi"))
        marked = held.join(stats, "g")
        below = marked.groupBy("g", "n").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"))
        order = Window.partitionBy("g").orderBy("v")
        inside = marked.where(F.col("v").between(F.col("lo"), F.col("hi"))).withColumn("k", F.row_number().over(order))
        at = F.lit(point) * (F.col("n") - 1)
        first = inside.join(below.select("g", "below"), "g").withColumn("k", F.col("k") + F.col("below") - 1).where((F.col("k") >= F.floor(at)) & (F.col("k") <= F.floor(at) + 1))
        found = first.groupBy("g", "n").agg(F.min_by("v", "k").alias("a"), F.max_by("v", "k").alias("b"))
        found = found.select("g", (F.col("a") + (at - F.floor(at)) * (F.col("b") - F.col("a"))).alias(name))
        out = found if out is None else out.join(found, "g")
    return out


def with_drift(vectors: DataFrame, section: str = "section") -> DataFrame:
    """The rows with dist_site and dist_section: one minus the cosine to the centroid of all pages and of the section's.

    Rows whose vector is null, zero or not finite are left out.
    """
    rows = usable(vectors)
    site = centroids(rows).select(F.col("centroid").alias("site_centroid"))
    by_section = centroids(rows, section).select(section, F.col("centroid").alias("section_centroid"))
    # the site's centroid is one row
    joined = rows.join(by_section, section).crossJoin(F.broadcast(site))
    return joined.select(
        *rows.columns,
        (1 - V.cosine(F.col("vec"), F.col("site_centroid"))).alias("dist_site"),
        (1 - V.cosine(F.col("vec"), F.col("section_centroid"))).alias("dist_section"),
    )


def section_report(drift: DataFrame, section: str = "section", percentile: float = 0.95) -> DataFrame:
    """Focus of each section over the drift of its pages."""
    rows = Scratch(drift.sparkSession, "sections").table(drift.where(F.col(section).isNotNull()).select(section, "dist_section"), "drift")
    return rows.groupBy(section).agg(*focus_columns(1 - F.col("dist_section"))).join(percentiles(rows, "dist_section", {"p95_dist": percentile}, section), section)


def site_report(drift: DataFrame, section: str = "section", percentile: float = 0.95) -> DataFrame:
    """One row: focus of the whole site, and how many sections it has."""
    rows = Scratch(drift.sparkSession, "site").table(drift.select(section, "dist_site"), "drift")
    report = rows.agg(*focus_columns(1 - F.col("dist_site")), F.countDistinct(section).alias("n_sections"))
    return report.join(percentiles(rows, "dist_site", {"p95_dist": percentile}), F.lit(True), "left")


def recommendation(size: Column, dist_section: Column, p95: Column, dist_site: Column, word_count: Column) -> Column:
    """Reasons for attention in fixed order, joined by semicolons; null reasons are left out."""
    return F.concat_ws(
        "; ",
        F.when(size < 3, "section too small"),
        F.when(dist_section > p95, "off-topic for section"),
        F.when(dist_site > 0.65, "far from site topic"),
        F.when((word_count < 200) & (dist_section > 0.8 * p95), "thin content"),
    )


def outliers(drift: DataFrame, section: str = "section", percentile: float = 0.95) -> DataFrame:
    """The pages with their section's percentile and size, and the recommendation, where there is one."""
    # summed in another order a centre differs in its last digits, and the row at the percentile would pass it
    drift = Scratch(drift.sparkSession, "outliers").table(drift, "drift")
    stats = section_report(drift, section, percentile).select(section, F.col("p95_dist"), F.col("n_pages").alias("section_size"))
    rows = drift.join(stats, section)
    words = F.col("word_count") if "word_count" in drift.columns else F.lit(1_000_000)
    advice = recommendation(F.col("section_size"), F.col("dist_section"), F.col("p95_dist"), F.col("dist_site"), words)
    return rows.withColumn("recommendation", advice).where("recommendation <> ''")


def duplicate_action(sim: Column) -> Column:
    return F.when(sim >= 0.97, "merge").when(sim >= 0.94, "consolidate").otherwise("review")


def normalized_drift(drift: Column, most: Column) -> Column:
    """Drift as a share of the largest."""
    return drift / F.greatest(most, F.lit(1e-9))


def robust_rescale(rows: DataFrame, columns: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Columns moved to the middle of their percentile pair and divided by half its width (1 if that is 0)."""
    wide = rows
    for k, c in enumerate(columns):
        # one row
        wide = wide.crossJoin(F.broadcast(percentiles(rows, c, {f"__low{k}": low, f"__high{k}": high})))
    out = {}
    for k, c in enumerate(columns):
        a, b = F.col(f"__low{k}"), F.col(f"__high{k}")
        scale = F.when(a == b, F.lit(1.0)).otherwise((b - a) / 2)
        out[c] = (F.col(c) - (a + b) / 2) / scale
    return wide.withColumns(out).select(*rows.columns)


def medoids(rows: DataFrame, group: str) -> DataFrame:
    """(group, medoid, dist): of each group the row nearest to the centroid; ties by smaller id."""
    centre = centroids(rows, group).select(group, "centroid")
    far = rows.join(centre, group).withColumn("dist", V.distance(F.col("vec"), F.col("centroid")))
    best = far.groupBy(group).agg(F.min(F.struct(F.round("dist", 12).alias("d"), "id", "dist")).alias("m"))
    return best.select(group, F.col("m.id").alias("medoid"), F.col("m.dist").alias("dist"))
