"""Job state from log lines: a batch form over windows, and the same rules as a keyed stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.sources.providers import unit_cost

# Stages by the number of their marker, and the stage that a namespace's progress is of.
STAGES = ("preflight", "audio", "transcribe", "frames", "attribute", "faceverify", "index", "graph", "proxy")
STAGE_OF = {"transcribe": "transcribe", "vision": "frames", "faceverify": "faceverify", "kg-extract": "graph", "embed-batch": "index"}
#: Lines of a failed job's log that its error shows.
TAIL = 6


def parse(lines: DataFrame) -> DataFrame:
    """Log lines (job, seq, line) with the message, stage marker, skip mark, namespace and progress k of n."""
    message = F.regexp_replace("line", r"^\d\d:\d\d:\d\d\s+\w+\s+\S+\s+", "")
    marker = F.regexp_extract(message, r"^\[(\d)/8\]\s+\w+\s+", 1)
    names = F.array(*map(F.lit, STAGES))
    ns = F.regexp_extract(message, r"^([a-z][a-z-]*) (\d+)/(\d+) \(", 1)
    count = lambda g: F.nullif(F.regexp_extract(message, r"^([a-z][a-z-]*) (\d+)/(\d+) \(", g), F.lit("")).cast("long")
    return lines.select("job", "seq", "line", message.alias("message"), F.when(marker != "", F.get(names, F.nullif(marker, F.lit("")).cast("int"))).alias("stage"), ((marker != "") & F.contains(message, F.lit("SKIP"))).alias("skipped"), F.nullif(ns, F.lit("")).alias("ns"), count(2).alias("k"), count(3).alias("n"))


def progress_counts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Calls of each namespace from (keys, ns, k): a counter adds what it rises above its maximum so far, so the sum is the maximum."""
    return lines.groupBy(*keys, "ns").agg(F.greatest(F.max("k"), F.lit(0).cast("long")).alias("calls"))


def costs(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Calls and estimated dollars of each key over its namespaces."""
    return counts.groupBy(*keys).agg(F.sum("calls").alias("calls"), F.round(F.sum(F.col("calls") * unit_cost(F.col("ns"))), 4).alias("est_cost"))


def stage_states(parsed: DataFrame) -> DataFrame:
    """The state of each stage that a job has entered: job, stage, status, skipped, pct.

    A stage that another follows is done, and so is a skipped one; what is done once stays done when it
    is entered again. pct is 100 where it is done, else the share of its last progress line.
    """
    w = Window.partitionBy("job").orderBy("seq")
    entered = parsed.where("stage is not null").select("job", "stage", "seq", "skipped", F.lead("stage").over(w).alias("later"))
    done = F.col("skipped") | F.col("later").isNotNull()
    states = entered.groupBy("job", "stage").agg(F.when(F.bool_or(done), "done").otherwise("run").alias("status"), F.bool_or("skipped").alias("skipped"))
    shown = parsed.where("ns is not null and n > 0").withColumn("stage", stage_of(F.col("ns"))).where("stage is not null")
    last = shown.groupBy("job", "stage").agg(F.max_by(F.round(100 * F.col("k") / F.col("n"), 1), "seq").alias("_pct"))
    joined = states.join(last, ["job", "stage"], "left")
    return joined.select("job", "stage", "status", "skipped", F.when(F.col("status") == "done", 100.0).otherwise(F.coalesce("_pct", F.lit(0.0))).alias("pct"))


def stage_of(ns: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, stage in STAGE_OF.items():
        found = F.when(ns == name, stage).otherwise(found)
    return found


def terminal(states: DataFrame, exits: DataFrame, lines: DataFrame) -> DataFrame:
    """The end of each job (job, code of exits): state, error, and every stage's status.

    An exit of 0 makes all stages done. Any other fails the job and the stage that runs; its error is
    the last TAIL lines (job, seq, line) of its log, or the exit code where there is none. A job
    without an exit runs.
    """
    ranked = lines.withColumn("_back", F.row_number().over(Window.partitionBy("job").orderBy(F.col("seq").desc()))).where(F.col("_back") <= TAIL)
    tails = ranked.groupBy("job").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("tail"))
    known = states.groupBy("job").agg(F.map_from_entries(F.collect_list(F.struct("stage", "status"))).alias("known"))
    jobs = lines.select("job").distinct().join(exits, "job", "left").join(known, "job", "left").join(tails, "job", "left")
    ok, failed = F.coalesce(F.col("code") == 0, F.lit(False)), F.coalesce(F.col("code") != 0, F.lit(False))
    status = lambda s: F.coalesce(F.try_element_at("known", s), F.lit("wait"))
    final = lambda s: F.when(ok, "done").when(failed & (status(s) == "run"), "fail").otherwise(status(s))
    stages = F.transform(F.array(*map(F.lit, STAGES)), lambda s: F.struct(s.alias("stage"), final(s).alias("status")))
    error = F.when(failed, F.coalesce("tail", F.concat(F.lit("exit code "), F.col("code").cast("string"))))
    return jobs.select("job", F.when(ok, "done").when(failed, "failed").otherwise("running").alias("state"), error.alias("error"), stages.alias("stages"))


def snapshot(updates: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last row of each key of an update-mode table."""
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last")).select(*keys, "last.*")


def to_table(stream: DataFrame, path: str, checkpoint: str):
    """A query that appends every micro-batch of an update-mode stream to a Parquet table, and ends with what is there."""
    write = lambda df, _: df.write.mode("append").parquet(path)
    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_counts(parsed: DataFrame) -> DataFrame:
    """Running calls of each job and namespace over a stream of parsed lines, in update mode."""
    schema = "job string, ns string, calls long"

    def step(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        # what a counter rises above its maximum so far adds up to its new maximum, in any order of the lines
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        risen: dict[str, int] = {}
        for rows in batches:
            for ns, k in zip(rows["ns"].tolist(), rows["k"].tolist(), strict=True):
                risen[ns] = max(risen.get(ns, 0), k)
        known |= {ns: max(known.get(ns, 0), k) for ns, k in risen.items()}
        state.update((list(known), list(known.values())))
        yield pd.DataFrame({"job": [key[0]] * len(risen), "ns": list(risen), "calls": [known[ns] for ns in risen]})

    # a call of the function is dearer than a line, so a job's namespaces are one state
    keyed = parsed.where("ns is not null and k is not null").select("job", "ns", "k")
    return keyed.groupBy("job").applyInPandasWithState(step, schema, "ns array<string>, calls array<long>", "update", "NoTimeout")


def read_log_stream(spark, folder: str) -> DataFrame:
    """A folder of JSON lines (job, seq, line) as a stream."""
    return spark.readStream.schema("job string, seq long, line string").json(folder)


def read_exit_stream(spark, folder: str) -> DataFrame:
    """A folder of JSON lines (job, code) as a stream."""
    return spark.readStream.schema("job string, code long").json(folder)
