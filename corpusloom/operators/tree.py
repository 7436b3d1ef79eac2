"""Trees as rows: a node is its path, the list of steps from the root, and an interval of places in preorder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.order import numbered
from corpusloom.plans.scratch import Scratch


def _prefixes(path: str):
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda k: F.slice(path, F.lit(1), k))


def with_ancestors(leaves: DataFrame) -> DataFrame:
    """(path, size, name) of the leaves (path, name) and all nodes above them; size is the number of leaves at or below, name null above.

    A path that several leaves share is one node with the least of their names.
    """
    rows = leaves.select("name", F.size("path").alias("deep"), F.explode(_prefixes("path")).alias("path"))
    return rows.groupBy("path").agg(F.count("*").alias("size"), F.min(F.when(F.size("path") == F.col("deep"), F.col("name"))).alias("name"))


def intervals(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes (path, each once, with all above it) with place, their number in preorder from 0, and last, that of the last node below.

    A path comes before those that it begins, so the order of paths is preorder. Node b is
    below a when a.place < b.place <= a.last.
    """
    placed = scratch.table(numbered(nodes.withColumn("__all", F.lit(0)), ["__all"], ["path"], "place", scratch).drop("__all"), "places")
    below = placed.select(F.explode(_prefixes("path")).alias("path")).groupBy("path").agg(F.count("*").alias("__n"))
    return placed.join(below, "path").withColumn("last", F.col("place") + F.col("__n") - 1).drop("__n")


def json_pieces(placed: DataFrame) -> DataFrame:
    """(place, piece): pieces of text that, in order of place, make one nested JSON document.

    placed: intervals with name and size. A node's piece ends its own list of children and
    those of all nodes whose last one it is, which follows from the depth of the next node.
    """
    depth = F.size("path")
    after = placed.select((F.col("place") - 1).alias("place"), depth.alias("next"))
    rows = placed.join(after, "place", "left")
    head = F.to_json(F.struct("name", "size"))
    opened = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"children":['))
    closed = F.repeat(F.lit("]}"), (depth - F.coalesce("next", F.lit(1)) + 1).cast("int"))
    return rows.select("place", F.concat(opened, closed, F.when(F.col("next") <= depth, ",").otherwise("")).alias("piece"))
