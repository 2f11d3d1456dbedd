"""Running totals and ranks over whole tables, without a window that takes all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvane.operators.graphs import _cut


def running(rows: DataFrame, keys: list[str], value: str, weight) -> DataFrame:
    """(keys, value, weight, before, total) of each different value of a group: its summed weight, that of all lesser values, and the group's.

    Equal values are summed before the shuffle.  Values are dealt out by range,
    so that a group of any size is spread over tasks; each part's sums, as many
    rows as parts and groups, give the places where parts begin.
    """
    each = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("weight"))
    dealt = _cut(each.repartitionByRange(*keys, value).withColumn("w_part", F.spark_partition_id()))
    sums = dealt.groupBy("w_part", *keys).agg(F.sum("weight").alias("w_sum"))
    earlier = Window.partitionBy(*keys).orderBy("w_part").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("w_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy()
    begins = sums.select("w_part", *keys, F.coalesce(F.sum("w_sum").over(earlier), F.lit(0)).alias("w_begin"), F.sum("w_sum").over(whole).alias("total"))
    inside = Window.partitionBy("w_part", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    at = dealt.withColumn("w_inside", F.coalesce(F.sum("weight").over(inside), F.lit(0)))
    return at.join(begins, ["w_part", *keys]).select(*keys, value, "weight", (F.col("w_begin") + F.col("w_inside")).alias("before"), "total")


def average_ranks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with r_<column> for each column: the rank of its value from 1 on, ties share the mean of theirs."""
    pairs = F.array(*[F.struct(F.lit(c).alias("w_name"), F.col(c).cast("double").alias("w_value")) for c in columns])
    ranks = running(rows.select(F.inline(pairs)), ["w_name"], "w_value", F.lit(1))
    ranks = _cut(ranks.select("w_name", "w_value", (F.col("before") + (F.col("weight") + 1) / 2).alias("w_rank")))
    out = rows
    for c in columns:
        own = ranks.where(F.col("w_name") == c).select(F.col("w_value").alias(f"w_{c}"), F.col("w_rank").alias(f"r_{c}"))
        out = out.join(own, out[c].cast("double") == own[f"w_{c}"], "left").drop(f"w_{c}")
    return out
