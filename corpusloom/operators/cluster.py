"""Clusters of page vectors: density clusters per section, their subdivision into small ones and a map."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators.audit import robust_rescale
from corpusloom.operators.density import Sizes, density_labels
from corpusloom.operators.layout import fuzzy_graph, layout
from corpusloom.operators.order import numbered
from corpusloom.operators.tree import with_ancestors
from corpusloom.operators.vector import usable
from corpusloom.plans.scratch import Scratch

def density_clusters(rows: DataFrame, group: str, scratch: Scratch, least: int = 5, samples: int = 3, most: int = 5, sizes: Sizes | None = None) -> DataFrame:
    """(group, id, cluster, leaf): density cluster of each row of its group, and the small one that it ends in.

    rows: id, group, vec. A group of fewer than ``least`` rows is one cluster; noise is -1.
    Clusters of more than ``most`` rows are clustered again, all of a level in one job; one
    that falls into fewer than two is cut into runs of ``most`` ids. leaf names the way
    down: numbers from the cluster on, the noise of a step after its clusters.
    """
    kind = dict(rows.dtypes)[group]
    own = scratch.table(rows.where(F.col(group).isNotNull()).select(F.col(group).alias("grp"), F.col("id").cast("long").alias("id"), V.doubles(F.col("vec")).alias("vec")), "rows")
    named = own.withColumns({"g": F.col("grp").cast("string"), "least": F.lit(least), "samples": F.lit(samples)})
    found = density_labels(named, scratch, sizes).withColumnRenamed("g", "grp_name")
    counts = own.groupBy(F.col("grp").cast("string").alias("grp_name")).agg(F.count("*").alias("in_group"))
    label = F.when(F.col("in_group") < least, 0).otherwise(F.col("cluster"))
    first = found.join(counts, "grp_name").select("id", label.alias("cluster"))
    # a node's name: the way down, then its group
    state = scratch.table(own.join(first, "id").withColumn("path", F.col("cluster").cast("string")), "level")
    done: DataFrame | None = None
    while True:
        state = state.withColumn("g", F.concat("path", F.lit("|"), F.col("grp").cast("string")))
        state = scratch.table(state.join(state.groupBy("g").agg(F.count("*").alias("in_node")), "g"), "nodes")
        ended = state.where(F.col("in_node") <= most).select("grp", "id", "cluster", F.col("path").alias("leaf"))
        done = ended if done is None else done.unionByName(ended)
        active = state.where(F.col("in_node") > most)
        if active.isEmpty():
            return done.select(F.col("grp").cast(kind).alias(group), "id", "cluster", "leaf")
        state = _split(active, most, scratch, sizes)


def _split(active: DataFrame, most: int, scratch: Scratch, sizes: Sizes | None) -> DataFrame:
    """The rows of the next level (grp, id, vec, cluster, path)."""
    asked = active.select("g", "id", "vec", F.lit(2).alias("least"), F.when(F.col("in_node") < 20, 1).otherwise(2).alias("samples"))
    labels = scratch.table(density_labels(asked, scratch, sizes).withColumnRenamed("cluster", "label"), "labels")
    per_label = labels.groupBy("g", "label").agg(F.count("*").alias("n"))
    shapes = per_label.groupBy("g").agg(F.sum(F.when(F.col("label") >= 0, 1).otherwise(0)).alias("found"), F.max(F.when(F.col("label") >= 0, F.col("n"))).alias("widest"))
    told = active.join(labels.join(shapes, "g").drop("g"), "id")
    whole = F.coalesce((F.col("found") <= 1) | (F.col("widest") == F.col("in_node")), F.lit(True))
    columns = ["grp", "id", "vec", "cluster"]
    apart = told.where(~whole).select(*columns, F.concat_ws("/", "path", F.when(F.col("label") >= 0, F.col("label")).otherwise(F.col("found")).cast("string")).alias("path"))
    runs = numbered(told.where(whole).select("g", "path", *columns), ["g"], ["id"], "place", scratch)
    cut = runs.select(*columns, F.concat_ws("/", "path", F.floor(F.col("place") / most).cast("string")).alias("path"))
    return scratch.table(apart.unionByName(cut), "level")


def tree_paths(clusters: DataFrame, group: str) -> DataFrame:
    """(path, name, id) of the leaves of the cluster tree: the site, groups, clusters down to the small ones, pages.

    Noise is Miscellaneous, or hangs on its group where it is fewer than three. Numbers in a
    path have leading zeros, so its order is theirs.
    """
    g = F.coalesce(F.col(group).cast("string"), F.lit(""))
    noise = clusters.where("cluster < 0").groupBy(g.alias("g")).agg(F.count("*").alias("noise"))
    rows = clusters.withColumn("g", g).join(noise, "g", "left")
    steps = F.transform(F.split("leaf", "/"), lambda x: F.when(x == "-1", F.lit("~")).otherwise(F.lpad(x, 9, "0")))
    inner = F.when((F.col("cluster") < 0) & (F.col("noise") < 3), F.array().cast("array<string>")).otherwise(steps)
    page = F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 19, "0"))
    return rows.select(F.concat(F.array(F.lit("site"), "g"), inner, F.array(page)).alias("path"), F.col("id").cast("string").alias("name"), "id")


def tree_nodes(clusters: DataFrame, group: str) -> DataFrame:
    """(path, name, size, depth) of all nodes of the cluster tree; size counts pages."""
    leaves = tree_paths(clusters, group)
    nodes = with_ancestors(leaves.select("path", "name"))
    step = F.element_at("path", -1)
    number = F.concat(F.lit("Cluster "), (F.try_to_number(step, F.lit("999999999")) + 1).cast("long").cast("string"))
    name = F.when(F.col("name").isNotNull(), F.col("name")).when(F.size("path") <= 2, step).when(step == "~", "Miscellaneous").otherwise(number)
    return nodes.select("path", name.alias("name"), "size", (F.size("path") - 1).alias("depth"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """One row: number of clusters, least, largest and mean size."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_clusters"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("avg_size"))


def cluster_centres(points: DataFrame, k: int) -> DataFrame:
    """(cluster, x, y, size) of k clusters over (cluster, x, y); an empty one is at the origin."""
    every = points.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    found = points.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("size"))
    zero = F.lit(0.0)
    return every.join(found, "cluster", "left").select("cluster", F.coalesce("x", zero).alias("x"), F.coalesce("y", zero).alias("y"), F.coalesce("size", F.lit(0)).alias("size"))


def components_2d(rows: DataFrame) -> DataFrame:
    """(id, x, y): the first two principal components of unit vectors."""
    made = rows.select("id", array_to_vector(V.normalize(F.col("vec"))).alias("features"))
    axes = PCA(k=2, inputCol="features", outputCol="xy").fit(made).transform(made)
    xy = vector_to_array(F.col("xy"))
    return axes.select("id", xy[0].alias("x"), xy[1].alias("y"))


def map_2d(rows: DataFrame, scratch: Scratch, neighbours: int = 15) -> DataFrame:
    """(id, x, y): a map that keeps neighbourhoods, rescaled to its percentiles. Principal components are where it begins.

    Rows without a usable vector are left out; one row or two lie where the components are.
    """
    own = usable(rows).select(F.col("id").cast("long").alias("id"), "vec")
    if own.isEmpty():
        return own.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    start = scratch.table(components_2d(own), "components")
    wide = start.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("m")).first().m or 1.0
    spread = start.select("id", (F.col("x") * 10 / F.lit(wide)).alias("x"), (F.col("y") * 10 / F.lit(wide)).alias("y"))
    return robust_rescale(layout(spread, fuzzy_graph(own, neighbours, scratch), scratch), ["x", "y"])


def subclusters(clusters: DataFrame, pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(cluster, section, rank, title, id): pages (id, section, title) of each cluster by section, a row each in order of title."""
    rows = clusters.join(pages, "id").select("cluster", "section", "title", "id")
    return numbered(rows, ["cluster", "section"], ["title", "id"], "rank", scratch)
