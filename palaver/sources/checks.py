"""Checks that ride on the job that does the work: no rows are read a second time to be checked.

A row that breaks a rule of its own fails the task that meets it, by an expression of the plan. What only a whole
can break, a total or a recording's share, is a metric that Spark gathers while the rows pass; it is looked at when
the job is over, and what was written is taken away again if it is wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from palaver.session import remove_folder


def required(df: DataFrame, holds: Column, message: Column) -> DataFrame:
    """df, whose job fails with the message of the first row for which ``holds`` is not true."""
    # a filter, so that no query of the rows leaves it out, whatever columns it reads
    return df.where(F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def covering(segments: DataFrame, keys: list[str], speech: DataFrame, least: float = 0.5) -> DataFrame:
    """The segments (keys, t_start, t_end), in a job that fails and names a recording whose segments cover less than ``least`` of its speech.

    speech has keys, duration and ratio. A recording's total is a window over its own segments.
    """
    total = F.sum(F.col("t_end") - F.col("t_start")).over(Window.partitionBy(*keys))
    rows = segments.withColumn("_covered", total).join(speech.select(*keys, (F.col("duration") * F.col("ratio")).alias("_speech")), keys, "left")
    named = F.concat(F.lit("segments of "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), F.lit(" cover less than half of its speech: a part has failed"))
    checked = required(rows, F.col("_covered") >= least * F.coalesce("_speech", F.lit(0.0)), named)
    return checked.select(*segments.columns)


def partitions_of_time(spans: DataFrame, keys: list[str], slack: float = 1e-6) -> DataFrame:
    """Spans (keys, t_start, t_end, duration) that begin at 0, end at duration and leave no gap or overlap, or a job that fails and names the recording."""
    w = Window.partitionBy(*keys).orderBy("t_start", "t_end")
    before = F.coalesce(F.lag("t_end").over(w), F.lit(0.0))
    last = F.lead("t_end").over(w).isNull()
    holds = (F.abs(F.col("t_start") - before) <= slack) & (F.col("t_end") > F.col("t_start")) & (~last | (F.abs(F.col("t_end") - F.col("duration")) <= slack))
    named = F.concat(F.lit("spans of "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), F.lit(" are no partition of its time"))
    return required(spans.withColumn("_holds", holds), F.col("_holds"), named).drop("_holds")


def cuts_as_planned(cuts: DataFrame, most: float = 0.25) -> DataFrame:
    """Cut files (path, planned, probed), each as long as planned, or a job that fails and names one."""
    named = F.format_string("%s is %s s long, not %s s", F.col("path"), F.col("probed").cast("string"), F.col("planned").cast("string"))
    return required(cuts, F.abs(F.col("probed") - F.col("planned")) <= most, named)


def write_observed(df: DataFrame, path: str, metrics: dict[str, Column], verdict) -> dict:
    """Writes df as Parquet with aggregates gathered on the way, and returns them.

    ``verdict`` takes them and returns what is wrong, or None. What is wrong is raised and the rows are removed.
    """
    seen = Observation()
    df.observe(seen, *[c.alias(name) for name, c in metrics.items()]).write.parquet(path)
    got = seen.get
    if (wrong := verdict(got)) is not None:
        remove_folder(df.sparkSession, path)
        raise ValueError(wrong)
    return got


def failures(batches: DataFrame, path: str, error: str = "_error") -> dict:
    """Writes rows that have errors in their slots and raises one summary of all of them, k of n and the first three; the rows stay."""
    text = F.col(error)
    seen = Observation()
    some = F.slice(F.array_sort(F.collect_set(F.substring(text, 1, 200))), 1, 3)  # of messages, which are few and short
    batches.observe(seen, F.count("*").alias("n"), F.count(text).alias("failed"), some.alias("some")).write.parquet(path)
    got = seen.get
    if got["failed"]:
        more = "; ..." if got["failed"] > 3 else ""
        raise RuntimeError(f"{got['failed']} of {got['n']} failed: {'; '.join(got['some'])}{more}")
    return got
