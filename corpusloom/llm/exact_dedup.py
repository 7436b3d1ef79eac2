"""Exact deduplication against a persistent digest index. DataFrame operations only.

The index is a table of one row per distinct text: its SHA-256 digest, the row that stays
and the number of rows seen. It is bucketed and sorted by digest, so new data meets it in
a sort-merge anti-join that moves only the new digests, and what is new is appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.plans.scratch import Scratch, partitions

#: Fixed by the definition of equal texts: each run of these becomes one space.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def digest(text) -> F.Column:
    """Lower-case hex SHA-256 of the text with each run of ASCII white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ").cast("binary"), 256)


class DigestIndex:
    """A digest index at a place of the shared storage; any session can open it again.

    The number of buckets is kept with the files: an index that exists is opened with its
    own, whatever the session's shuffle setting, and another one that is asked for is
    refused. Appends must not overlap; a batch's name can be used once.
    """

    SCHEMA = "digest STRING, keep_id BIGINT, batch STRING, group_size BIGINT"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        layout = f"{path}/_layout"
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(layout)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            self.buckets = spark.read.schema("buckets int").parquet(layout).first().buckets
            if buckets and buckets != self.buckets:
                raise ValueError(f"the index at {path} has {self.buckets} buckets, not {buckets}")
        else:
            self.buckets = buckets or partitions(spark)
            spark.range(1).select(F.lit(self.buckets).cast("int").alias("buckets")).write.parquet(layout)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({self.SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {self.buckets} BUCKETS LOCATION '{path}/rows'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Adds the groups (digest, keep_id, group_size) whose digest the index lacks."""
        if not self.rows().where(F.col("batch") == batch).isEmpty():
            raise ValueError(f"the index at {self.path} has a batch named {batch!r} already")
        fresh = groups.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")
        fresh = fresh.select("digest", "keep_id", F.lit(batch).alias("batch"), "group_size")
        fresh.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def close(self) -> None:
        """Forgets the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE {self.name}")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batch: str = "") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays; ids that are null come last, and of
    repeated rows with the same id exactly one stays. A null text counts as empty. A text
    that the index already holds keeps nothing: its keep_id is the index's. group_size
    counts the rows of this input. Other columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    index = index or DigestIndex(spark, scratch.path("index"))
    batch = batch or uuid.uuid4().hex
    rows = scratch.table(docs.select(F.col(id_col).cast("long").alias("id"), digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    first = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("row"))
    groups = scratch.table(
        rows.groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("group_size")).select("digest", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"),
        "groups",
    )
    index.append(groups, batch)
    # what stays is what the index says now: a digest that it had before is of another batch there
    known = index.rows().select("digest", F.col("keep_id").alias("known_id"), (F.col("batch") != batch).alias("known"))
    found = scratch.table(groups.hint("merge").join(known, "digest"), "found")
    out = rows.join(found, "digest").select(
        F.col("id").alias(id_col),
        F.col("known_id").alias("keep_id"),
        "group_size",
        (~F.col("known") & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    index.close()
    return out


def _hashable(docs: DataFrame, name: str) -> F.Column:
    """A column that can be hashed: one with maps by its text."""
    held = F.col(f"row.`{name}`")
    return held.cast("string") if "map<" in docs.schema[name].dataType.simpleString() else held


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without later copies of a text (see exact_dedup).

    Of rows that share id and text but not the other columns, the one with the least hash
    of all columns stays, maps taken by their text. Columns of any name and type pass
    unchanged.
    """
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("id"), F.col("text_sha256").alias("digest"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text_of, id_of = F.col(f"row.`{text_col}`"), F.col(f"row.`{id_col}`").cast("long")
    marked = held.select(id_of.alias("id"), digest(text_of).alias("digest"), "row")
    both = marked.join(kept, marked["id"].eqNullSafe(kept["id"]) & (marked["digest"] == kept["digest"]), "left_semi")
    # only whole rows that share id and text are compared; the join has dealt them together
    order = Window.partitionBy("id", "digest").orderBy(F.xxhash64(*[_hashable(docs, c) for c in docs.columns]))
    first = both.withColumn("n", F.row_number().over(order)).where("n = 1")
    return first.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
