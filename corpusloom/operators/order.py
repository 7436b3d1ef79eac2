"""Places of rows in an order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.scratch import Scratch, partitions


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """The rows with their place, from 0, among those of equal keys: a range sort, and the sum of what earlier ranges hold.

    Null keys are equal. Ties of the order are broken as the sort leaves them.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *keys, *order).sortWithinPartitions(*keys, *order)
    at = scratch.table(dealt.withColumn("__at", F.monotonically_increasing_id()), "ordered").withColumn("__part", F.shiftright("__at", 33))
    spans = at.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    # as many rows a key as ranges
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select(*keys, "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    starts = starts.withColumnsRenamed({k: f"__{n}" for n, k in enumerate([*keys, "__part"])})
    same = [at[k].eqNullSafe(starts[f"__{n}"]) for n, k in enumerate([*keys, "__part"])]
    return at.join(starts, same).select(*[at[c] for c in rows.columns], (F.col("__at") + F.col("__shift")).alias(name))
