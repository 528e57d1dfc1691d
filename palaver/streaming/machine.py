"""One state machine for each job over the stream of its log lines and the stream of exits.

What a line does to a stage is a table of transitions. A job's state is kept in the state store under
four names: ``head`` (the stage it is in, its last line's number, its exit code), ``stages`` (status and
percentage by stage), ``counts`` (the highest count by namespace) and ``tail`` (a ring of the last lines, for the
error of a job that fails). An exit may come before, with or after the job's last lines: every update
emits the whole row, so the last row of a job is right whatever came first, and a restart from the checkpoint goes
on where the stream stopped. Lines of one micro-batch are taken by seq; a line that comes in a later batch than
one with a higher seq is taken when it comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palaver.sources.providers import CALL_COST, OTHER_COST
from palaver.streaming.jobs import STAGE_OF, STAGES, TAIL, parse

#: What becomes of a stage's status when the job leaves it, enters it or skips it, and when the job ends.
TRANSITIONS = {
    "left": {"wait": "wait", "run": "done", "done": "done"},
    "entered": {"wait": "run", "run": "run", "done": "done"},
    "skipped": {"wait": "done", "run": "done", "done": "done"},
    "succeeded": {"wait": "done", "run": "done", "done": "done"},
    "failed": {"wait": "wait", "run": "fail", "done": "done"},
}
OUTPUT = "job string, seq long, state string, error string, stages array<struct<stage: string, status: string, pct: double>>, calls long, est_cost double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def moved(stages: dict, stage: str | None, event: str) -> None:
    """Applies an event to a stage (status, pct); done is 100."""
    if stage is not None:
        status, pct = stages.get(stage, ("wait", 0.0))
        status = TRANSITIONS[event][status]
        stages[stage] = (status, 100.0 if status == "done" else pct)


class JobMachine(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "current string, seq long, code long")
        self.stages = handle.getMapState("stages", "stage string", "status string, pct double")
        self.counts = handle.getMapState("counts", "ns string", "calls long")
        self.tail = handle.getListState("tail", "seq long, line string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        # each question to the state store is a call to another process: none is asked twice, and only what changed is put
        head, stages, counts, tail = self.head.get(), {}, {}, []
        current, last, code = head or (None, -1, None)
        if head:
            stages = {k[0]: tuple(v) for k, v in self.stages.iterator()}
            counts = {k[0]: v[0] for k, v in self.counts.iterator()}
            tail = [tuple(x) for x in self.tail.get()]
        had_stages, had_counts, lines = dict(stages), dict(counts), []
        for r in rows:
            if r.code is not None:
                code = r.code
            else:
                lines.append(r)
        for r in sorted(lines, key=lambda r: r.seq):
            last = max(last, r.seq)
            if r.stage is not None:
                moved(stages, current, "left")
                moved(stages, r.stage, "skipped" if r.skipped else "entered")
                current = r.stage
            elif r.ns is not None:
                counts[r.ns] = max(r.k, counts.get(r.ns, 0))
                of = STAGE_OF.get(r.ns)
                if of and r.n > 0:
                    status = stages.get(of, ("wait", 0.0))[0]
                    stages[of] = (status, 100.0 if status == "done" else round(100.0 * r.k / r.n, 1))
        self.head.update((current, last, code))
        for stage, value in stages.items():
            if had_stages.get(stage) != value:
                self.stages.updateValue((stage,), value)
        for ns, n in counts.items():
            if had_counts.get(ns) != n:
                self.counts.updateValue((ns,), (n,))
        if lines:
            tail = sorted([*tail, *((r.seq, r.line) for r in lines)])[-TAIL:]
            self.tail.put(tail)
        yield self.row(key[0], last, code, stages, counts, tail)

    @staticmethod
    def row(job: str, last: int, code: int | None, stages: dict, counts: dict, tail: list) -> Row:
        final = dict(stages)
        if code is not None:
            for stage in STAGES:
                moved(final, stage, "failed" if code else "succeeded")
        state = "running" if code is None else "failed" if code else "done"
        error = ("\n".join(x for _, x in tail) or f"exit code {code}") if code else None
        listed = [Row(stage=s, status=final.get(s, ("wait", 0.0))[0], pct=final.get(s, ("wait", 0.0))[1]) for s in STAGES]
        cost = round(sum(n * CALL_COST.get(ns, OTHER_COST) for ns, n in counts.items()), 4)
        return Row(job=job, seq=last, state=state, error=error, stages=listed, calls=sum(counts.values()), est_cost=float(cost))

    def close(self) -> None:
        pass


@contextmanager
def state_provider(spark: SparkSession):
    """The state store that can hold several variables of a key, for the queries that start in this block."""
    name = "spark.sql.streaming.stateStore.providerClass"
    given = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, given) if given else spark.conf.unset(name)


def job_stream(lines: DataFrame, exits: DataFrame | None = None) -> DataFrame:
    """The row of each job, anew with each of its lines (job, seq, line) or its exit (job, code), in update mode: job, seq, state, error, stages, calls, est_cost."""
    rows = parse(lines).select("job", "seq", "line", "stage", "skipped", "ns", "k", "n", F.lit(None).cast("long").alias("code"))
    if exits is not None:
        none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
        rows = rows.unionByName(exits.select("job", *[none(c) for c in rows.columns[1:-1]], F.col("code").cast("long").alias("code")))
    return rows.groupBy("job").transformWithState(statefulProcessor=JobMachine(), outputStructType=OUTPUT, outputMode="Update", timeMode="None")


def stage_snapshot(spark: SparkSession, checkpoint: str) -> DataFrame:
    """job, stage, status and pct as the state store of a checkpoint has them, without running the stream."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "stages").load()
    return rows.select(F.col("key.job").alias("job"), F.col("user_map_key.stage").alias("stage"), F.col("user_map_value.status").alias("status"), F.col("user_map_value.pct").alias("pct"))
