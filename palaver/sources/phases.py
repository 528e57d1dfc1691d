"""Phases of recordings that are made again only where what they are made from has changed.

A phase is a table by recording and a table of fingerprints: for each recording a hash of all the rows, of all
inputs, that its part was made from. A recording is stale if that hash is another now, or it has none. Only
stale recordings are made, and only their folders are written; the fingerprints follow after the rows, so a run
that dies leaves its recordings stale.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.session import bounded, cut, exists
from palaver.sources.artifacts import fingerprints

KEY = "video_id"


def inputs_print(inputs: dict[str, DataFrame]) -> DataFrame:
    """video_id and fingerprint over the rows of all inputs, each under its name, whatever the order of rows."""
    parts = [fingerprints(df, [KEY]).select(KEY, F.lit(name).alias("name"), "n", "fingerprint") for name, df in sorted(inputs.items())]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    listed = F.to_json(F.array_sort(F.collect_list(F.struct("name", "n", "fingerprint"))))  # an entry for each input
    return every.groupBy(KEY).agg(F.sha2(listed, 256).alias("fingerprint"))


def stale(spark: SparkSession, root: str, phase: str, inputs: dict[str, DataFrame]) -> DataFrame:
    """video_id and fingerprint of the recordings whose inputs are not those that the phase was made from."""
    now = inputs_print(inputs)
    at = f"{root}/{phase}.inputs"
    if not exists(spark, at):
        return now
    return now.join(spark.read.parquet(at).select(KEY, "fingerprint"), [KEY, "fingerprint"], "left_anti")


def refresh(spark: SparkSession, root: str, phase: str, inputs: dict[str, DataFrame], make: Callable[..., DataFrame]) -> DataFrame:
    """Makes a phase's stale recordings and writes them; returns their ids.

    ``make`` takes the inputs by name, each with the rows of stale recordings alone, and returns rows with
    video_id. Recordings that have no input any more stay as they are.
    """
    due = cut(stale(spark, root, phase, inputs))
    of = bounded(due.select(KEY))
    made = make(**{name: df.join(of, KEY, "left_semi") for name, df in inputs.items()})
    for name, rows in ((phase, made), (f"{phase}.inputs", due)):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(KEY).parquet(f"{root}/{name}")
    return due.select(KEY)
