"""Exact ranks over whole tables: a key of any size is spread over partitions, and no task holds all of its rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.session import bounded, cut

#: monotonically_increasing_id has the partition above these bits and the row's place in it below.
PLACE_BITS = 33


def ranked_rows(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with ``name``: each row's place, from 1, among the rows of its keys in the given order.

    Rows are dealt by ranges of keys and order and sorted there, so a key with a third of all rows is
    many partitions. Of each partition only the number of its rows by key is gathered; running sums
    of those, a row for each key and partition, are where a partition's own places begin. Nulls are
    values of keys and stand where ``order`` puts them; rows that tie in the whole order are dealt out
    too and get places of their own, in any order. The input is read twice (Spark samples it for the
    ranges), so a dear one should be cut first.
    """
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [*[F.col(f"`{k}`").asc() for k in keys], *order, F.col("_tie")]
    placed = cut(spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", PLACE_BITS)))
    sizes = placed.groupBy(*[F.col(f"`{k}`") for k in keys], "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_p"))
    joined = placed.join(bounded(starts), same)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))
