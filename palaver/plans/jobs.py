"""Job-log and export queries: each user's events are the lines of a job's log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palaver.operators import graph as gr
from palaver.plans.base import EVENTS, events, millis, query
from palaver.plans.graphs import KEYS, RECORDINGS, TALK, assembled, placed, spoken, sql_ordinal, sql_video
from palaver.session import cut, remove_folder, shared_folder, table
from palaver.streaming import jobs as jb

LOG = f"""{EVENTS}, log AS (SELECT CAST(user_id AS VARCHAR) AS job, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS seq, CASE event_type WHEN 'view' THEN 'audio' WHEN 'click' THEN 'transcribe' WHEN 'signup' THEN 'graph' END AS stage,
event_type = 'click' AND event_id % 5 = 0 AS skipped, CASE WHEN event_type = 'error' THEN event_id % 9 END AS k FROM ev),
en AS (SELECT *, lead(stage) OVER (PARTITION BY job ORDER BY seq) AS later FROM log WHERE stage IS NOT NULL),
st AS (SELECT job, stage, CASE WHEN bool_or(skipped OR later IS NOT NULL) THEN 'done' ELSE 'run' END AS status, bool_or(skipped) AS skipped FROM en GROUP BY job, stage),
pr AS (SELECT job, arg_max(round(100.0 * k / 8, 1), seq) AS pct FROM log WHERE k IS NOT NULL GROUP BY job),
states AS (SELECT st.job, st.stage, status, skipped, CAST(CASE WHEN status = 'done' THEN 100.0 WHEN st.stage = 'graph' THEN coalesce(pct, 0) ELSE 0 END AS DOUBLE) AS pct FROM st LEFT JOIN pr ON st.job = pr.job)"""


def log(spark, folder):
    """Log lines (job, seq, line): stage markers, some of them skips, progress of extraction, and other lines."""
    e = events(spark, folder)
    marker = lambda n, name, rest: F.concat(F.lit(f"[{n}/8] {name}  "), rest)
    kind = F.col("event_type")
    skip = F.when(F.col("event_id") % 5 == 0, "SKIP (exists)").otherwise("start")
    message = F.when(kind == "view", marker(1, "audio", F.lit("start"))).when(kind == "click", marker(2, "transcribe", skip)).when(kind == "signup", marker(7, "graph", F.lit("start")))
    message = message.when(kind == "error", F.concat(F.lit("kg-extract "), (F.col("event_id") % 9).cast("string"), F.lit("/8 (x%)"))).otherwise("bought")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")).cast("long")
    return e.select(F.col("user_id").cast("string").alias("job"), seq.alias("seq"), F.concat(F.lit("10:00:00 INFO ingest "), message).alias("line"))


@query(f"WITH {LOG} SELECT job, stage, status, skipped, pct FROM states")
def job_stages(spark, folder):
    return jb.stage_states(jb.parse(log(spark, folder)))


NAMES = ", ".join(f"('{s}', {i})" for i, s in enumerate(jb.STAGES))


ENDED = f"""j AS (SELECT DISTINCT job, CASE CAST(job AS BIGINT) % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 END AS code FROM log), n AS (SELECT * FROM (VALUES {NAMES}) v(stage, ord)),
f AS (SELECT j.job, code, n.stage, n.ord, CASE WHEN code = 0 THEN 'done' WHEN code > 0 AND s.status = 'run' THEN 'fail' ELSE coalesce(s.status, 'wait') END AS status, CASE WHEN code = 0 THEN 100.0 ELSE coalesce(s.pct, CASE WHEN n.stage = 'graph' THEN p.pct END, 0) END AS pct FROM j CROSS JOIN n LEFT JOIN states s ON s.job = j.job AND s.stage = n.stage LEFT JOIN pr p ON p.job = j.job)"""
STATE = "CASE WHEN code = 0 THEN 'done' WHEN code > 0 THEN 'failed' ELSE 'running' END AS state"


def exits(lines):
    """Two in three jobs have ended, one of them well."""
    number = F.col("job").cast("long") % 3
    return lines.select("job").distinct().where(number != 2).select("job", F.when(number == 0, 0).otherwise(3).alias("code"))


@query(f"WITH {LOG}, {ENDED} SELECT job, {STATE}, string_agg(stage || ':' || status, ',' ORDER BY ord) AS stages FROM f GROUP BY job, code")
def job_ends(spark, folder):
    lines = log(spark, folder)
    ended = jb.terminal(jb.stage_states(jb.parse(lines)), exits(lines), lines)
    shown = F.array_join(F.transform("stages", lambda s: F.concat_ws(":", s["stage"], s["status"])), ",")
    return ended.select("job", "state", shown.alias("stages"))


@query(f"""WITH {LOG}, {ENDED}, c AS (SELECT job, max(k) AS calls FROM log WHERE k IS NOT NULL GROUP BY job)
SELECT f.job, {STATE}, string_agg(stage || ':' || status || ':' || CAST(CAST(round(10 * pct) AS BIGINT) AS VARCHAR), ',' ORDER BY ord) AS stages, coalesce(c.calls, 0) AS calls FROM f LEFT JOIN c ON c.job = f.job GROUP BY f.job, code, c.calls""")
def job_machine(spark, folder):
    """The same as a stream of lines and exits in two parts, restarted from its checkpoint between them; some exits come with the first lines."""
    import uuid

    from palaver.streaming import machine

    root = f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}"
    lines = cut(log(spark, folder))
    early = F.col("job").cast("long") % 2 == 0
    spark.createDataFrame([], machine.OUTPUT).write.parquet(f"{root}/rows")  # a stream without a row writes none
    for first in (True, False):
        lines.where((F.col("seq") <= 40) == first).write.mode("append").json(f"{root}/log")
        exits(lines).where(early == first).write.mode("append").json(f"{root}/exits")
        with machine.state_provider(spark):
            stream = machine.job_stream(jb.read_log_stream(spark, f"{root}/log"), jb.read_exit_stream(spark, f"{root}/exits"))
            jb.to_table(stream, f"{root}/rows", f"{root}/checkpoint").awaitTermination()
    # an exit before the first line has no seq of its own, and every row of a job has all that is known by then
    last = jb.snapshot(spark.read.parquet(f"{root}/rows").withColumn("at", F.struct("seq", (F.col("state") != "running").alias("over"))), ["job"], "at")
    shown = F.array_join(F.transform("stages", lambda s: F.concat_ws(":", s["stage"], s["status"], F.round(s["pct"] * 10).cast("long").cast("string"))), ",")
    found = cut(last.select("job", "state", shown.alias("stages"), "calls"))
    remove_folder(spark, root)
    return found


EXPORTED = f"""WITH {TALK}, t AS (SELECT {sql_video('o_orderkey')} AS video_id, {sql_ordinal('o_orderkey')} AS n, epoch_us(o_orderdate) / 1000000.0 AS t FROM orders)
SELECT 'node' AS side, me.video_id, me.key, NULL AS target, NULL AS rel_type, CAST(arg_min(coalesce(t, 0), me.n) AS BIGINT) AS first_seen_s FROM me LEFT JOIN t ON t.video_id = me.video_id AND t.n = me.n GROUP BY me.video_id, me.key
UNION ALL SELECT DISTINCT 'edge', video_id, source, target, 'DISCUSSED', NULL FROM di"""


@query(EXPORTED)
def graph_export(spark, folder):
    return exported(*graph(spark, folder))


def graph(spark, folder):
    """Nodes with first_seen_s and typed edges of each recording."""
    from palaver.plans.base import millis
    from palaver.sources.artifacts import export_graph

    nodes = cut(assembled(spark, folder).select(*KEYS, "key", "type", "member_id", "words"))  # read for nodes, for topics and for people
    segments = placed(table(spark, folder, "orders"), "o_orderkey").select("video_id", "ordinal", (millis("o_orderdate") / 1000).alias("t_start"))
    edges = gr.discussed_edges(nodes, spoken(spark, folder), KEYS)
    return export_graph(nodes, edges, segments)


def exported(out, typed):
    none = F.lit(None).cast("string")
    rows = out.select(F.lit("node").alias("side"), "video_id", "key", none.alias("target"), none.alias("rel_type"), F.col("first_seen_s").cast("long").alias("first_seen_s"))
    return rows.unionByName(typed.select(F.lit("edge").alias("side"), "video_id", F.col("source").alias("key"), "target", "rel_type", F.lit(None).cast("long").alias("first_seen_s")))


@query(EXPORTED)
def graph_store(spark, folder):
    """The same from a graph store: all recordings written with a false first second, half of them deleted, and all written again."""
    import uuid

    from palaver.sources import datasources as ds

    ds.register(spark)
    root, (nodes, edges) = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}", graph(spark, folder)
    rows = cut(exported(nodes, edges))
    put = lambda df: df.write.format(ds.STORE).mode("append").option("path", root).save()
    put(rows.withColumn("first_seen_s", F.lit(-1).cast("long")))
    ds.delete(root, [f"V{i}" for i in range(0, 40, 2)])
    put(rows)
    names = [f"V{i}" for i in range(RECORDINGS)]
    found = ds.read(spark, ds.STORE, root, names[:20]).unionByName(ds.read(spark, ds.STORE, root, names[20:]))  # each row is read once
    found = cut(found)
    remove_folder(spark, root)
    return found


LOGS = 60


@query(f"""WITH {EVENTS}, b AS (SELECT min(t) AS t0 FROM ev), l AS (SELECT 'V' || CAST(user_id % {LOGS} AS VARCHAR) AS video_id, row_number() OVER (PARTITION BY user_id % {LOGS} ORDER BY t, event_id) - 1 AS seq, CASE event_type WHEN 'error' THEN 'silence_start' WHEN 'click' THEN 'silence_end' WHEN 'view' THEN 'cut' END AS kind, t - t0 AS t FROM ev, b)
SELECT video_id, seq, kind, t FROM l WHERE kind IS NOT NULL""")
def tool_log_events(spark, folder):
    """Events as the lines of media tools, a file a recording, read back by the source of such logs, half of the recordings at a time."""
    import uuid

    from palaver.sources import datasources as ds

    ds.register(spark)
    e = events(spark, folder)
    begin = e.agg(F.min("t").alias("t0"))  # one row
    at = F.format_string("%.3f", (F.col("t") - F.col("t0")) / 1000)
    kind = F.col("event_type")
    line = F.when(kind == "error", F.concat(F.lit("[silencedetect] silence_start: "), at)).when(kind == "click", F.concat(F.lit("[silencedetect] silence_end: "), at, F.lit(" | silence_duration: 1")))
    line = line.when(kind == "view", F.concat(F.lit("frame: pts_time:"), at, F.lit(" score"))).otherwise("size=N/A")
    name = F.concat(F.lit("V"), (F.col("user_id") % LOGS).cast("string"))
    rows = e.crossJoin(F.broadcast(begin)).select(name.alias("video_id"), "t", "event_id", line.alias("value"))
    root = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    rows.repartition("video_id").sortWithinPartitions("video_id", "t", "event_id").select("video_id", "value").write.partitionBy("video_id").text(root)
    names = [f"V{i}" for i in range(LOGS)]
    found = cut(ds.read(spark, ds.TOOL_LOG, root, names[::2]).unionByName(ds.read(spark, ds.TOOL_LOG, root, names[1::2])))
    remove_folder(spark, root)
    return found


@query("SELECT 'V' || CAST(conv_id % 25 AS VARCHAR) AS video_id, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars, conv_id % 25 IN (0, 3, 7) AS remade FROM conversations GROUP BY conv_id % 25")
def phase_refresh(spark, folder):
    """A phase made from conversations of which two recordings were others and one was missing, then refreshed from those that are."""
    import uuid

    from palaver.sources import phases as ph

    number = F.col("conv_id") % 25
    conv = table(spark, folder, "conversations").select(F.concat(F.lit("V"), number.cast("string")).alias("video_id"), "conv_id", "turn", "text")
    before = conv.where(number != 7).withColumn("text", F.when(number.isin(0, 3), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    make = lambda turns: turns.groupBy("video_id").agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))
    root = f"{shared_folder(spark)}/phases-{uuid.uuid4().hex}"
    ph.refresh(spark, root, "turns", {"turns": before}, make)
    remade = ph.refresh(spark, root, "turns", {"turns": conv}, make).withColumn("remade", F.lit(True))
    found = spark.read.parquet(f"{root}/turns").select("video_id", "n_turns", "n_chars").join(remade, "video_id", "left")
    found = cut(found.withColumn("remade", F.coalesce("remade", F.lit(False))))
    remove_folder(spark, root)
    return found


@query("SELECT 'V' || CAST(conv_id AS VARCHAR) AS video_id, count(*) AS n, CAST(max(t_end) AS BIGINT) AS duration FROM (SELECT conv_id, sum(greatest(1000, length(text) * 60)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t_end FROM conversations) GROUP BY conv_id")
def checked_write(spark, folder):
    """Segments written by one job that checks that they are a partition of each recording's time and cover half of its speech, and counts them."""
    import uuid

    from pyspark.sql import Window as W

    from palaver.plans.base import segments
    from palaver.sources import checks as ck

    keys = ["video_id"]
    rows = segments(spark, folder).select(F.concat(F.lit("V"), F.col("conv_id").cast("string")).alias("video_id"), (F.col("t_start") / 1000).alias("t_start"), (F.col("t_end") / 1000).alias("t_end"))
    rows = rows.withColumn("duration", F.max("t_end").over(W.partitionBy("video_id")))
    speech = rows.groupBy("video_id").agg(F.max("duration").alias("duration")).withColumn("ratio", F.lit(1.0))
    path = f"{shared_folder(spark)}/checked-{uuid.uuid4().hex}"
    checked = ck.partitions_of_time(ck.covering(rows, keys, speech), keys)
    ck.write_observed(checked, path, {"n": F.count("*"), "negative": F.count_if(F.col("t_start") < 0)}, lambda m: f"{m['negative']} of {m['n']} segments begin before 0" if m["negative"] else None)
    found = cut(spark.read.parquet(path).groupBy("video_id").agg(F.count("*").alias("n"), F.round(F.max("t_end") * 1000).cast("long").alias("duration")))
    remove_folder(spark, path)
    return found
