"""Model calls as table functions: rows into batches, and batches into answers under a declared schema.

``batches`` takes a table in partitions and in order and gives a row for each run of ``size`` rows, with the
rows' own columns as an array of structs whatever they are: its schema follows from its input. It
streams, so a task holds one batch. ``answers`` takes such rows with the recorded response to each, or none, and
gives the row again with ``answer``, whose schema is an argument, and ``_error``: a call that fails leaves its
error in its own slot and all other rows whole. Without a provider a request that no response is recorded for is
such an error.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from palaver.operators.ranks import ranked_rows
from palaver.sources import providers as pv

#: Batches of a partition: a recording of any size is dealt out in runs of so many.
RUN = 200


def struct_of(fields) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


class Batches:
    """eval gets a row of a partition at a time; terminate ends the partition."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument, keys: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(rows.dataType, T.StructType):
            raise ValueError("batches needs a table in partitions")
        if not size.isConstantExpression or not (size.value or 0) > 0:
            raise ValueError("the size of a batch is a constant above 0")
        names = json.loads(keys.value)
        own = [f for f in rows.dataType if f.name in names]
        rest = [f for f in rows.dataType if f.name not in (*names, "rank", "run")]
        return AnalyzeResult(T.StructType([*struct_of(own), T.StructField("batch", T.LongType()), T.StructField("items", T.ArrayType(struct_of(rest)))]))

    def __init__(self):
        self.own, self.batch, self.items, self.fields = (), 0, [], None

    def eval(self, row, size: int, keys: str):
        if self.fields is None:
            names = json.loads(keys)
            self.fields = [c for c in row.__fields__ if c not in (*names, "rank", "run")]
            self.own = tuple(row[c] for c in row.__fields__ if c in names)
        self.batch = (row["rank"] - 1) // size
        self.items.append(tuple(row[c] for c in self.fields))
        if row["rank"] % size == 0:
            yield (*self.own, self.batch, self.items)
            self.items = []

    def terminate(self):
        if self.items:
            yield (*self.own, self.batch, self.items)


def in_batches(rows: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """keys, batch (from 0) and items of rows: each run of ``size`` rows of the same keys, in order, as an array of their other columns.

    Places are ranks by ranges, and a table function gathers runs of whole batches, so a key of any size is many partitions.
    """
    ranked = ranked_rows(rows, keys, order).withColumn("run", F.expr(f"(rank - 1) div {size * RUN}"))
    table = ranked.asTable().partitionBy(*keys, "run").orderBy("rank")
    return F.udtf(Batches)(table, F.lit(size), F.lit(json.dumps(keys)))


def answering(make: Callable[[], pv.ModelProvider], policy: pv.Policy):
    """The table function of calls by the providers that ``make`` gives, one a partition."""

    class Answers:
        @staticmethod
        def analyze(rows: AnalyzeArgument, namespace: AnalyzeArgument, schema: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or not {"body", "response"} <= set(rows.dataType.names):
                raise ValueError("answers needs a table with body and response")
            # the answer is text here and gets its type outside, where Spark parses it
            kept = [f for f in rows.dataType if f.name not in ("slot", "response")]
            return AnalyzeResult(T.StructType([*struct_of(kept), T.StructField("said", T.StringType()), T.StructField("_error", T.StringType())]))

        def __init__(self):
            self.provider, self.limiter = make(), None

        def eval(self, row, namespace: str, schema: str):
            self.limiter = self.limiter or pv.RateLimiter(getattr(self.provider, "per_minute", policy.per_minute) / policy.partitions)
            said, error = row["response"], None
            if said is None:
                try:
                    said = policy.respond(self.provider, self.limiter, namespace, row["body"])
                except Exception as failed:  # noqa: BLE001  the error is the row's result
                    error = policy.shown(failed)
            yield (*[row[c] for c in row.__fields__ if c not in ("slot", "response")], said, error)

    return F.udtf(Answers)


def answers(requests: DataFrame, namespace: str, schema: str, recorded: DataFrame, make: Callable[[], pv.ModelProvider] = pv.NoProvider, policy: pv.Policy = pv.Policy()) -> DataFrame:
    """requests (body, and any columns) with answer, parsed under ``schema``, and _error, one of them null.

    recorded (namespace, request_sha256, body) holds bodies of responses, read as a model's JSON response where they are
    one (blocked, truncated and empty ones are errors), else as they are. Requests are dealt to the policy's
    number of slots, each with a provider of its own.
    """
    keyed = pv.with_keys(requests, namespace)
    given = recorded.where(F.col("namespace") == namespace).groupBy("request_sha256").agg(F.min("body").alias("response"))
    joined = keyed.join(given, "request_sha256", "left").drop("namespace").withColumn("slot", F.pmod(F.xxhash64("request_sha256"), F.lit(policy.partitions)))
    called = answering(make, policy)(joined.asTable().partitionBy("slot").orderBy("request_sha256"), F.lit(namespace), F.lit(schema))
    text, refused = pv.said(F.col("said"))
    parsed = called.withColumn("_text", text).withColumn("answer", pv.parsed(F.col("_text"), schema)).withColumn("_refused", refused)
    parsed = parsed.withColumn("_whole", F.try_parse_json(pv.strip_fence(F.col("_text"))).isNotNull())
    error = F.coalesce("_error", "_refused", F.when(~F.coalesce("_whole", F.lit(False)), F.lit("parse")))
    rest = [c for c in called.columns if c not in ("said", "_error", "request_sha256")]
    return parsed.select(*rest, F.when(error.isNull(), F.col("answer")).alias("answer"), error.alias("_error"))
