"""Two sides that meet whole within their keys, in groups of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.session import bounded


def dealt(left: DataFrame, right: DataFrame, keys: list[str], left_by: Column, right_by: Column, left_size: int, right_size: int, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """left and right with block and slice, and the columns to group both by.

    Every pair of rows of the same keys is in exactly one group. The left rows of a key are dealt to blocks
    of about left_size rows by left_by, its right rows to slices of about right_size by right_by; each
    block meets each slice, so a left row is there once for each slice and a right row once for each block. Keys
    that one side has not got are left out. Both sides are read twice: they are counted by key first, the left one
    only where its ``sizes`` (keys, n) are not given.
    """
    k = [F.col(c) for c in keys]
    again = [F.col(c).alias(c) for c in keys]  # attributes of their own, where both sides come from one table
    counts = left.groupBy(*k).agg(F.count("*").alias("n")) if sizes is None else sizes
    blocks = bounded(counts.select(*k, F.ceil(F.col("n") / left_size).cast("int").alias("_blocks")))
    slices = bounded(right.groupBy(*k).agg(F.ceil(F.count("*") / right_size).cast("int").alias("_slices")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, c: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    rest = lambda df: [c for c in df.columns if c not in keys]
    a = left.join(blocks, keys).join(slices, keys).select(*k, *rest(left), own("_blocks", left_by).alias("block"), every("_slices").alias("slice"))
    b = right.join(blocks, keys).join(slices, keys).select(*again, *rest(right), every("_blocks").alias("block"), own("_slices", right_by).alias("slice"))
    return a, b, [*keys, "block", "slice"]
