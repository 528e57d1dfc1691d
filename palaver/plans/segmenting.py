"""Segment queries: events are raw spans, conversations are recordings of segments in turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.operators import segments as sg
from palaver.operators import timeline as tl
from palaver.plans.base import EVENTS, SEGMENTS, events, query, segments
from palaver.session import table

HOUR = 3_600_000
RAW = f"""{EVENTS}, raw AS (SELECT event_id, user_id, CAST(t % 86400000 AS DOUBLE) AS abs_start, CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 1.0 END AS scale, CAST(event_id % 40 AS DOUBLE) AS start_local,
CAST(event_id % 40 + event_id % 7 - 1 AS DOUBLE) AS end_local, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE event_type END AS text FROM ev),
placed AS (SELECT *, abs_start + start_local * scale AS t_start_raw, abs_start + end_local * scale AS t_end_raw FROM raw WHERE end_local > start_local AND trim(text) <> '')"""


def raw_spans(spark, folder):
    e = events(spark, folder)
    local = F.col("event_id") % 40
    return e.select(
        "event_id",
        "user_id",
        (F.col("t") % 86_400_000).cast("double").alias("abs_start"),
        F.when(F.col("event_id") % 3 == 0, 0.5).otherwise(1.0).alias("scale"),
        local.cast("double").alias("start_local"),
        (local + F.col("event_id") % 7 - 1).cast("double").alias("end_local"),
        F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.col("event_type")).alias("text"),
    )


@query(f"WITH {RAW} SELECT event_id, t_start_raw, t_end_raw FROM placed")
def segment_placing(spark, folder):
    return sg.place(raw_spans(spark, folder)).select("event_id", "t_start_raw", "t_end_raw")


@query(f"""WITH {RAW}, s AS (SELECT *, t_start_raw + event_id % 5 - 2 AS a, t_end_raw - event_id % 4 AS b FROM placed)
SELECT event_id, CAST(CASE WHEN b > a THEN a ELSE t_start_raw END AS DOUBLE) AS t_start, CAST(CASE WHEN b > a THEN b ELSE t_end_raw END AS DOUBLE) AS t_end FROM s""")
def snap_or_keep(spark, folder):
    placed = sg.place(raw_spans(spark, folder))
    snapped = placed.withColumn("t_start_snapped", F.col("t_start_raw") + F.col("event_id") % 5 - 2).withColumn("t_end_snapped", F.col("t_end_raw") - F.col("event_id") % 4)
    return sg.snap_or_keep(snapped).select("event_id", "t_start", "t_end")


@query(f"""WITH {RAW}, d AS (SELECT user_id, event_id // 50 AS part, max(end_local) AS e, max(30.0 + user_id % 80) AS dur, max(event_id % 4) AS depth FROM raw GROUP BY user_id, event_id // 50)
SELECT user_id, part, e > dur * 1.05 + 2.0 AS overshoots, e > dur * 1.05 + 2.0 AND dur >= 90 AND depth < 3 AS splittable FROM d""")
def clock_faults(spark, folder):
    spans = raw_spans(spark, folder).withColumn("part", F.floor(F.col("event_id") / 50)).withColumn("duration", F.lit(30.0) + F.col("user_id") % 80).withColumn("depth", F.col("event_id") % 4)
    return sg.clock_faults(spans, ["user_id", "part"])


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, event_id, t AS a, t + {24 * HOUR} AS b FROM ev WHERE event_type = 'signup'), m AS (SELECT user_id, t AS mid FROM ev WHERE event_type = 'error'),
c AS (SELECT s.user_id, s.event_id, m.mid, abs(m.mid - (a + b) // 2) AS away, m.mid > (a + b) // 2 AS late FROM s JOIN m ON s.user_id = m.user_id AND m.mid BETWEEN a + {6 * HOUR} AND b - {6 * HOUR})
SELECT user_id, event_id AS span_id, CAST(arg_min(mid, away * 2 + CASE WHEN late THEN 1 ELSE 0 END) AS DOUBLE) AS split_at FROM c GROUP BY user_id, event_id""")
def split_points(spark, folder):
    e = events(spark, folder)
    spans = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("span_id"), F.col("t").alias("t_start"), (F.col("t") + 24 * HOUR).alias("t_end"))
    return sg.split_points(spans, e.where("event_type = 'error'").select("user_id", F.col("t").alias("mid")), ["user_id"])


TURNS = f"""{SEGMENTS}, n AS (SELECT *, 'S' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS segment_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t_start, turn) AS k FROM seg) x),
c AS (SELECT *, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role THEN 1 ELSE 0 END AS new FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY t_start, turn)),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY t_start, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS turn_index FROM c)"""


def voiced(spark, folder):
    """Numbered segments and their turns with segment ids."""
    numbered = tl.number_segments(segments(spark, folder), ["conv_id"], ["t_start", "turn"])
    return numbered, tl.build_turns(numbered, ["conv_id"], ["t_start", "turn"], "role", ids="segment_id")


@query(f"WITH {TURNS} SELECT conv_id, turn_index, min(role) AS role, string_agg(segment_id, ',' ORDER BY k) AS ids FROM g GROUP BY conv_id, turn_index")
def turn_segments(spark, folder):
    return voiced(spark, folder)[1].select("conv_id", "turn_index", "role", F.array_join("segment_ids", ",").alias("ids"))


@query(f"WITH {TURNS} SELECT conv_id, segment_id, CASE WHEN role = 'system' THEN NULL ELSE turn_index END AS turn_index, CASE WHEN role = 'assistant' THEN 'M' || CAST(turn_index % 3 AS VARCHAR) END AS member_id FROM g")
def turn_write_back(spark, folder):
    numbered, turns = voiced(spark, folder)
    named = F.when(F.col("role") == "assistant", F.concat(F.lit("M"), (F.col("turn_index") % 3).cast("string")))
    known = turns.where("role <> 'system'").withColumn("member_id", named)
    return sg.write_back(numbered.select("conv_id", "segment_id"), known, ["conv_id"])


INTRODUCED = f"""{TURNS}, i AS (SELECT conv_id, segment_id, 'M' || CAST(turn % 4 AS VARCHAR) AS member_id FROM g WHERE turn % 2 = 0)"""


def introductions(numbered):
    """Two announcements of every other segment, of which the first counts."""
    one = numbered.where("turn % 2 = 0").select("conv_id", "segment_id", F.concat(F.lit("M"), (F.col("turn") % 4).cast("string")).alias("member_id"), F.lit(0).alias("ord"))
    return one.unionByName(one.withColumn("member_id", F.lit("M9")).withColumn("ord", F.lit(1)))


@query(f"WITH {INTRODUCED} SELECT t.conv_id, t.turn_index, i.segment_id, i.member_id FROM (SELECT DISTINCT conv_id, turn_index FROM g) t JOIN g p ON p.conv_id = t.conv_id AND p.turn_index = t.turn_index - 1 JOIN i ON i.conv_id = p.conv_id AND i.segment_id = p.segment_id")
def introduction_evidence(spark, folder):
    numbered, turns = voiced(spark, folder)
    return sg.introduction_evidence(turns, introductions(numbered), ["conv_id"]).select("conv_id", "turn_index", "segment_id", "member_id")


@query(f"WITH {INTRODUCED} SELECT DISTINCT g.conv_id, g.turn_index FROM g JOIN i ON g.conv_id = i.conv_id AND g.segment_id = i.segment_id")
def announced_turns(spark, folder):
    numbered, turns = voiced(spark, folder)
    return sg.announced(turns, introductions(numbered), ["conv_id"])


@query(f"WITH {SEGMENTS}, c AS (SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN dur_ms END) AS BIGINT) AS covered FROM seg GROUP BY conv_id), d AS (SELECT conv_id, max(t_end) AS duration FROM seg GROUP BY conv_id) SELECT d.conv_id, coalesce(covered, 0) AS covered, coalesce(covered, 0) >= 0.5 * (duration * 0.75) AS enough FROM d LEFT JOIN c ON d.conv_id = c.conv_id")
def transcript_coverage(spark, folder):
    seg = segments(spark, folder)
    speech = seg.groupBy("conv_id").agg(F.max("t_end").alias("duration"), F.lit(0.75).alias("ratio"))
    return sg.coverage(seg.where("role = 'user'"), ["conv_id"], speech).select("conv_id", F.col("covered").cast("long").alias("covered"), "enough")


@query(f"WITH {TURNS} SELECT conv_id, segment_id, '[' || segment_id || '] ' || CASE WHEN role = 'system' THEN 'Unknown speaker' ELSE role END || CASE WHEN turn % 2 = 0 THEN ' (Member)' ELSE '' END || ' at ' || CAST(t_start // 1000 AS VARCHAR) || 's: ' || text || ' | ' || CASE WHEN turn % 3 = 0 THEN '' ELSE 'en ' || text END AS line FROM g")
def context_lines(spark, folder):
    numbered, _ = voiced(spark, folder)
    speaker = F.when(F.col("role") != "system", F.col("role"))
    role = F.when(F.col("turn") % 2 == 0, "Member")
    seconds = F.floor(F.col("t_start") / 1000).cast("double")
    english = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("en "), "text"))
    return numbered.select("conv_id", "segment_id", sg.context_line(F.col("segment_id"), speaker, role, seconds, F.col("text"), english).alias("line"))


@query(f"""WITH {SEGMENTS}, t AS (SELECT *, CASE WHEN role <> 'system' THEN role END AS member, ['E' || CAST(turn AS VARCHAR)] AS evidence FROM seg),
x AS (SELECT *, CASE WHEN lag(member) OVER w = member AND t_start - lag(t_end) OVER w <= 30000 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY t_start, turn)),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY t_start, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM x)
SELECT conv_id, run, min(member) AS member, count(*) AS n_merged, string_agg('E' || CAST(turn AS VARCHAR), ',' ORDER BY turn) AS evidence FROM g GROUP BY conv_id, run""")
def merged_evidence(spark, folder):
    seg = segments(spark, folder).withColumn("member", F.when(F.col("role") != "system", F.col("role"))).withColumn("confidence", F.lit(0.85)).withColumn("evidence", F.array(F.concat(F.lit("E"), F.col("turn").cast("string"))))
    return tl.merge_runs(seg, ["conv_id"], ["t_start", "turn"], "member", 30_000, ("evidence",)).select("conv_id", "run", "member", "n_merged", F.array_join("evidence", ",").alias("evidence"))


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n_turns, count(DISTINCT role) AS n_voices FROM conversations GROUP BY conv_id")
def voice_counts(spark, folder):
    return sg.voice_counts(table(spark, folder, "conversations").withColumn("new_speaker", F.col("role") == "user"), ["conv_id"], "role", "n_turns")


@query("SELECT source, count(*) AS n_frames, count(*) FILTER (WHERE lang = 'en') AS n_chyron, count(*) FILTER (WHERE n_chars > 1000) AS n_standing FROM documents GROUP BY source")
def frame_counts(spark, folder):
    frames = table(spark, folder, "documents").select("source", F.when(F.col("lang") == "en", "name").otherwise("").alias("chyron_name"), (F.col("n_chars") > 1000).alias("person_standing"))
    return sg.frame_counts(frames, ["source"])
