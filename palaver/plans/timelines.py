"""Timeline queries over conversations and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palaver.operators import timeline as tl
from palaver.plans.base import EVENTS, SEGMENTS, events, query, segments
from palaver.session import table

HOUR = 3_600_000


@query(f"WITH {SEGMENTS} SELECT conv_id, turn, 'S' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY t_start, t_end) AS VARCHAR), 3, '0') AS segment_id, t_start, t_end FROM seg")
def segments_timeline(spark, folder):
    numbered = tl.number_segments(segments(spark, folder), ["conv_id"], ["t_start", "t_end"])
    return numbered.select("conv_id", "turn", "segment_id", "t_start", "t_end")


@query(f"""WITH {SEGMENTS}, f AS (SELECT *, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role THEN 1 ELSE 0 END AS n FROM seg WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS turn_index FROM f)
SELECT conv_id, turn_index, min(role) AS role, min(t_start) AS t_start, max(t_end) AS t_end, count(*) AS n_segments FROM g GROUP BY conv_id, turn_index""")
def turn_building(spark, folder):
    return tl.build_turns(segments(spark, folder), ["conv_id"], ["turn"], "role")


MERGE_GAP = 12 * HOUR


@query(f"""WITH {EVENTS}, e AS (SELECT user_id, event_id, event_type, t AS t_start, t + 60000 AS t_end, round(value / 100, 4) AS confidence FROM ev),
f AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type AND t_start - lag(t_end) OVER w <= {MERGE_GAP} THEN 0 ELSE 1 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t_start, event_id)),
g AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY t_start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM f)
SELECT user_id, run, min(event_type) AS event_type, min(t_start) AS t_start, max(t_end) AS t_end, max(confidence) AS confidence, count(*) AS n_merged FROM g GROUP BY user_id, run""")
def same_speaker_merge(spark, folder):
    e = events(spark, folder).select("user_id", "event_id", "event_type", F.col("t").alias("t_start"), (F.col("t") + 60_000).alias("t_end"), F.round(F.col("value") / 100, 4).alias("confidence"))
    return tl.merge_runs(e, ["user_id"], ["t_start", "event_id"], "event_type", MERGE_GAP)


GAP = 6 * HOUR


@query(f"""WITH {EVENTS}, b AS (SELECT min(t) AS t0, max(t) AS t1 FROM ev), e AS (SELECT user_id, event_id, t - t0 AS s, t - t0 + 60000 AS e, t1 - t0 + 120000 AS duration FROM ev, b),
i AS (SELECT user_id, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap_start, s AS gap_end FROM e),
a AS (SELECT * FROM i UNION ALL SELECT user_id, max(e), max(duration) FROM e GROUP BY user_id)
SELECT user_id, gap_start, gap_end FROM a WHERE gap_end - gap_start >= {GAP}""")
def transcript_gaps(spark, folder):
    ev = events(spark, folder)
    bounds = ev.agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    e = ev.crossJoin(F.broadcast(bounds)).select("user_id", "event_id", (F.col("t") - F.col("t0")).alias("t_start"), (F.col("t") - F.col("t0") + 60_000).alias("t_end"), (F.col("t1") - F.col("t0") + 120_000).alias("duration"))
    return tl.gaps(e, ["user_id"], ["t_start", "event_id"], GAP, e.groupBy("user_id").agg(F.max("duration").alias("duration")))


PAIRED = f"""WITH {EVENTS}, b AS (SELECT min(t) AS t0, max(t) AS t1 FROM ev), e AS (SELECT user_id, event_id, t - t0 AS t, CASE event_type WHEN 'error' THEN 'start' ELSE 'end' END AS kind, t1 - t0 + 60000 AS duration FROM ev, b WHERE event_type IN ('error', 'click')),
l AS (SELECT *, lead(kind) OVER w AS nk, lead(t) OVER w AS nt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
p AS (SELECT user_id, greatest(t, 0) AS s_start, least(coalesce(nt, duration), duration) AS s_end FROM l WHERE kind = 'start' AND (nk IS NULL OR nk = 'end'))"""


def silences(spark, folder):
    """Pauses of each user: from an error to the next click."""
    ev = events(spark, folder)
    bounds = ev.agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    e = ev.where(F.col("event_type").isin("error", "click")).crossJoin(F.broadcast(bounds))
    e = e.select("user_id", "event_id", (F.col("t") - F.col("t0")).alias("t"), F.when(F.col("event_type") == "error", "start").otherwise("end").alias("kind"), (F.col("t1") - F.col("t0") + 60_000).alias("duration"))
    return e, tl.pair_events(e, ["user_id"], ["t", "event_id"], "kind", F.col("duration"))


@query(PAIRED + " SELECT user_id, s_start, s_end FROM p WHERE s_end > s_start")
def silence_pairing(spark, folder):
    return silences(spark, folder)[1]


@query(PAIRED + ", d AS (SELECT max(duration) AS duration FROM e) SELECT user_id, count(*) AS n_silences, CAST(sum(s_end - s_start) AS BIGINT) AS total_ms, round(1 - CAST(sum(s_end - s_start) AS DOUBLE) / max(duration), 4) AS speech_ratio FROM p, d WHERE s_end > s_start GROUP BY user_id")
def silence_summary(spark, folder):
    e, pairs = silences(spark, folder)
    whole = e.agg(F.max("duration").alias("duration"))
    total = F.sum(F.col("s_end") - F.col("s_start"))
    return pairs.crossJoin(F.broadcast(whole)).groupBy("user_id").agg(F.count("*").alias("n_silences"), total.alias("total_ms"), F.round(1 - total / F.max("duration"), 4).alias("speech_ratio"))


TOLERANCE = 2 * HOUR
SNAP = f"""WITH {EVENTS}, p AS (SELECT user_id, event_id, t FROM ev WHERE event_type = 'view'), b AS (SELECT user_id, t AS b FROM ev WHERE event_type = 'error'),
n AS (SELECT p.user_id, p.event_id, p.t, arg_min(b.b, 2 * abs(b.b - p.t) + CASE WHEN b.b > p.t THEN 1 ELSE 0 END) AS near FROM p LEFT JOIN b ON p.user_id = b.user_id GROUP BY p.user_id, p.event_id, p.t),
s AS (SELECT user_id, event_id AS point_id, t, CASE WHEN abs(near - t) <= {TOLERANCE} THEN near ELSE t END AS snapped FROM n)"""


@query(SNAP + " SELECT user_id, point_id, t, snapped FROM s")
def snap_nearest(spark, folder):
    ev = events(spark, folder)
    points = ev.where("event_type = 'view'").select("user_id", F.col("event_id").alias("point_id"), "t")
    return tl.snap_nearest(points, ev.where("event_type = 'error'").select("user_id", "t"), ["user_id"], TOLERANCE)


@query(SNAP + ", m AS (SELECT user_id, abs(snapped - t) AS move FROM s WHERE abs(snapped - t) > 10), r AS (SELECT user_id, move, row_number() OVER (PARTITION BY user_id ORDER BY move) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM m) SELECT user_id, move AS median_move, n AS n_moved FROM r WHERE k = n // 2 + 1")
def snap_move_median(spark, folder):
    moves = snap_nearest(spark, folder).select("user_id", F.abs(F.col("snapped") - F.col("t")).alias("move")).where("move > 10")
    per = moves.groupBy("user_id").agg(F.array_sort(F.collect_list("move")).alias("moves"))
    n = F.size("moves").cast("long")
    return per.select("user_id", F.element_at("moves", F.floor(n / 2).cast("int") + 1).alias("median_move"), n.alias("n_moved"))


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, event_id, t AS t_start, t + 600000 AS t_end FROM ev WHERE event_type = 'signup'), f AS (SELECT user_id, event_id AS frame_id, t FROM ev WHERE event_type = 'view')
SELECT s.user_id, s.event_id, f.frame_id FROM s JOIN f ON s.user_id = f.user_id AND f.t BETWEEN s.t_start - {HOUR} AND s.t_end + {HOUR}""")
def chyron_band_join(spark, folder):
    ev = events(spark, folder)
    spans = ev.where("event_type = 'signup'").select("user_id", "event_id", F.col("t").alias("t_start"), (F.col("t") + 600_000).alias("t_end"))
    frames = ev.where("event_type = 'view'").select("user_id", F.col("event_id").alias("frame_id"), "t")
    return tl.band_join(spans, frames, ["user_id"], HOUR, 4 * HOUR).select("user_id", "event_id", "frame_id")


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, event_id, t AS t_start, t + {24 * HOUR} AS t_end FROM ev WHERE event_type = 'signup'), f AS (SELECT user_id, event_id AS frame_id, t FROM ev WHERE event_type = 'view'),
j AS (SELECT s.user_id, s.event_id, f.frame_id, row_number() OVER (PARTITION BY s.user_id, s.event_id ORDER BY f.t, f.frame_id) - 1 AS r, greatest(count(*) OVER (PARTITION BY s.user_id, s.event_id) // 2, 1) AS step FROM s JOIN f ON s.user_id = f.user_id AND f.t BETWEEN s.t_start AND s.t_end)
SELECT user_id, event_id, frame_id FROM j WHERE r % step = 0 AND r // step < 2""")
def frames_in_turn(spark, folder):
    ev = events(spark, folder)
    spans = ev.where("event_type = 'signup'").select("user_id", "event_id", F.col("t").alias("t_start"), (F.col("t") + 24 * HOUR).alias("t_end"))
    frames = ev.where("event_type = 'view'").select("user_id", F.col("event_id").alias("frame_id"), "t")
    inside = tl.band_join(spans, frames, ["user_id"], 0, 24 * HOUR)
    return tl.stride_sample(inside, ["user_id", "event_id"], ["t", "frame_id"], 2).select("user_id", "event_id", "frame_id")


@query(f"""WITH RECURSIVE {EVENTS}, c AS (SELECT user_id, t % {24 * HOUR} AS t FROM ev WHERE event_type = 'error'),
u AS (SELECT user_id, t + 500 AS t FROM c WHERE t + 500 < {24 * HOUR} UNION SELECT user_id, g.g FROM (SELECT DISTINCT user_id FROM c) x, (SELECT unnest(range(5400000, {24 * HOUR}, {3 * HOUR})) AS g) g),
k AS (SELECT user_id, min(t) AS t FROM u GROUP BY user_id UNION ALL SELECT k.user_id, (SELECT min(u.t) FROM u WHERE u.user_id = k.user_id AND u.t >= k.t + {HOUR}) FROM k WHERE (SELECT min(u.t) FROM u WHERE u.user_id = k.user_id AND u.t >= k.t + {HOUR}) IS NOT NULL)
SELECT user_id, t FROM k""")
def keyframe_plan(spark, folder):
    cuts = events(spark, folder).where("event_type = 'error'").select("user_id", (F.col("t") % (24 * HOUR)).alias("t"), F.lit(24 * HOUR).cast("long").alias("duration"))
    return tl.frame_plan(cuts, ["user_id"], 500, 5_400_000, 3 * HOUR, HOUR)


CHUNK = {"target": 24 * HOUR, "search": 8 * HOUR, "least": 9 * HOUR, "tail": 6 * HOUR}
CHUNKED = f"""WITH RECURSIVE {EVENTS}, b AS (SELECT min(t) AS t0, max(t) AS t1 FROM ev), m AS (SELECT user_id, t - t0 AS mid FROM ev, b WHERE event_type = 'error'), d AS (SELECT DISTINCT user_id, t1 - t0 + 60000 AS dur FROM m, b),
c AS (SELECT user_id, dur, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS c_start, CAST(0 AS BIGINT) AS nxt, true AS flag, false AS fin FROM d
UNION ALL SELECT user_id, dur, i + 1, nxt, CASE WHEN NOT go THEN dur WHEN cut IS NULL THEN least(ideal, dur - {CHUNK['tail']}) ELSE cut END, CASE WHEN go THEN cut IS NOT NULL ELSE flag END, NOT go
 FROM (SELECT *, CASE WHEN go THEN (SELECT arg_min(m.mid, 2 * abs(m.mid - x.ideal) + CASE WHEN m.mid > x.ideal THEN 1 ELSE 0 END) FROM m WHERE m.user_id = x.user_id AND m.mid BETWEEN greatest(x.nxt + {CHUNK['least']}, x.ideal - {CHUNK['search']}) AND least(x.dur - {CHUNK['tail']}, x.ideal + {CHUNK['search']})) END AS cut
  FROM (SELECT *, nxt + {CHUNK['target']} AS ideal, (dur - nxt > {CHUNK['tail']} AND nxt + {CHUNK['target']} < dur) AS go FROM c WHERE NOT fin) x) y)"""


def chunks(spark, folder):
    ev = events(spark, folder)
    bounds = ev.agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    mids = ev.where("event_type = 'error'").crossJoin(F.broadcast(bounds)).select("user_id", (F.col("t") - F.col("t0")).alias("mid"), (F.col("t1") - F.col("t0") + 60_000).alias("duration"))
    return mids, tl.plan_chunks(mids, "user_id", CHUNK["target"], CHUNK["search"], CHUNK["least"], CHUNK["tail"])


@query(CHUNKED + " SELECT user_id, i AS chunk_index, c_start, nxt AS c_end, flag AS at_silence FROM c WHERE i >= 0")
def chunk_plan(spark, folder):
    return chunks(spark, folder)[1]


@query(CHUNKED + " SELECT user_id, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (WHERE NOT flag AND i > 0), '') AS forced FROM c WHERE i >= 0 GROUP BY user_id")
def forced_cuts(spark, folder):
    from palaver.operators.segments import forced_cuts as forced

    return forced(chunks(spark, folder)[1], ["user_id"]).select("user_id", F.array_join("forced", ",").alias("forced"))


@query(CHUNKED + """, s AS (SELECT user_id, dur, c_start, nxt AS c_end, lead(c_start) OVER (PARTITION BY user_id ORDER BY c_start, nxt) AS after FROM c WHERE i >= 0)
SELECT user_id, count(*) FILTER (WHERE c_end <= c_start) AS n_empty, count(*) FILTER (WHERE after <> c_end) AS n_broken, min(c_start) = 0 AND max(c_end) = max(dur) AS spans_all FROM s GROUP BY user_id""")
def span_validity(spark, folder):
    mids, plan = chunks(spark, folder)
    return tl.span_faults(plan, ["user_id"], mids.groupBy("user_id").agg(F.max("duration").alias("duration")))


@query(f"WITH {SEGMENTS} SELECT conv_id, max(t_end) AS duration, CAST(sum(dur_ms) FILTER (WHERE role = 'assistant') AS BIGINT) AS named_ms, round(coalesce(CAST(sum(dur_ms) FILTER (WHERE role = 'assistant') AS DOUBLE), 0) / sum(dur_ms), 3) AS named_ratio FROM seg GROUP BY conv_id")
def coverage_ratio(spark, folder):
    named = F.sum(F.when(F.col("role") == "assistant", F.col("dur_ms")))
    return segments(spark, folder).groupBy("conv_id").agg(F.max("t_end").alias("duration"), named.alias("named_ms"), F.round(F.coalesce(named, F.lit(0)) / F.sum("dur_ms"), 3).alias("named_ratio"))


@query(f"""WITH {SEGMENTS}, t AS (SELECT *, CASE WHEN role = 'assistant' THEN 'A' || CAST(turn % 3 AS VARCHAR) END AS member, role = 'system' AS announced, CAST(turn // 2 AS VARCHAR) AS chunk, 0.85 AS c0 FROM seg),
e AS (SELECT *, CASE WHEN member IS NULL AND NOT announced AND lag(chunk) OVER w <> chunk AND t_start - lag(t_end) OVER w <= 10000 THEN 1 ELSE 0 END AS e FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(1 - e) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM e),
r AS (SELECT *, first_value(member) OVER w AS src, first_value(announced) OVER w AS proc, row_number() OVER w - 1 AS k FROM g WINDOW w AS (PARTITION BY conv_id, g ORDER BY turn))
SELECT conv_id, turn, CASE WHEN e = 1 AND src IS NOT NULL AND NOT proc THEN src ELSE member END AS member, CASE WHEN e = 1 AND src IS NOT NULL AND NOT proc THEN greatest(0.5, round(0.85 - k * 0.1, 2)) WHEN member IS NULL THEN NULL ELSE CAST(c0 AS DOUBLE) END AS confidence, e = 1 AND src IS NOT NULL AND NOT proc AS carried FROM r""")
def carry_forward(spark, folder):
    named = F.when(F.col("role") == "assistant", F.concat(F.lit("A"), (F.col("turn") % 3).cast("string")))
    turns = segments(spark, folder).select("conv_id", "turn", "t_start", "t_end", named.alias("member"), (F.col("role") == "system").alias("announced"), F.floor(F.col("turn") / 2).cast("string").alias("chunk"))
    turns = turns.withColumn("kinds_procedure", F.col("announced")).withColumn("confidence", F.when(F.col("member").isNotNull(), F.lit(0.85)))
    return tl.carry_forward(turns, ["conv_id"], ["turn"], 10_000).select("conv_id", "turn", "member", "confidence", "carried")


@query(f"WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS rn FROM ev) SELECT user_id, event_id, event_type FROM r WHERE rn <= 8")
def last_n_per_key(spark, folder):
    w = Window.partitionBy("user_id").orderBy(F.col("t").desc(), F.col("event_id").desc())
    return events(spark, folder).withColumn("rn", F.row_number().over(w)).where("rn <= 8").select("user_id", "event_id", "event_type")


@query(f"""WITH {EVENTS}, p AS (SELECT user_id, event_id, event_type AS ns, t, CAST(floor(value) AS BIGINT) AS k FROM ev),
r AS (SELECT *, coalesce(max(k) OVER (PARTITION BY user_id, ns ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last FROM p)
SELECT user_id, ns, CAST(sum(greatest(k - last, 0)) AS BIGINT) AS calls, round(CAST(sum(greatest(k - last, 0)) AS DOUBLE) * 0.004, 6) AS est_cost FROM r GROUP BY user_id, ns""")
def job_progress(spark, folder):
    from palaver.streaming.jobs import progress_counts

    lines = events(spark, folder).select("user_id", F.col("event_type").alias("ns"), F.floor("value").cast("long").alias("k"))
    return progress_counts(lines, ["user_id"]).select("user_id", "ns", "calls", F.round(F.col("calls") * 0.004, 6).alias("est_cost"))


@query("""SELECT k AS sighting, count(*) AS n, CAST(min(t) AS BIGINT) AS first_t, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM (SELECT event_id, epoch_us(ts) // 1000 AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY k""")
def chyron_sightings(spark, folder):
    from palaver.plans.base import millis

    seen = table(spark, folder, "events").select("event_id", millis().alias("t"), F.get_json_object("props", "$.k").cast("long").alias("sighting"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return seen.groupBy("sighting").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), ids.alias("ids"))


@query(f"""WITH {EVENTS}, p AS (SELECT user_id, event_id, event_type AS ns, t, CAST(floor(value) AS BIGINT) AS k FROM ev),
r AS (SELECT *, coalesce(max(k) OVER (PARTITION BY user_id, ns ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last FROM p)
SELECT CAST(user_id AS VARCHAR) AS job, ns, CAST(sum(greatest(k - last, 0)) AS BIGINT) AS calls FROM r GROUP BY user_id, ns""")
def job_state_stream(spark, folder):
    """The counters of job_progress, kept as the state of a stream over the table's files."""
    import uuid

    from palaver.plans.base import millis
    from palaver.session import cut, is_folder, remove_folder, shared_folder
    from palaver.streaming.jobs import stream_counts, to_table

    schema = table(spark, folder, "events").schema
    reader, path = spark.readStream.schema(schema), f"{folder}/events.parquet"
    # a stream reads folders only: a table of part files is one, of a single file its folder's other files are left out
    stream = reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", "events.parquet").parquet(folder)
    lines = stream.select(F.col("user_id").cast("string").alias("job"), F.col("event_type").alias("ns"), (millis() * 1_000_000 + F.col("event_id") % 1_000_000).alias("seq"), F.floor("value").cast("long").alias("k"))
    root = f"{shared_folder(spark)}/job-counts-{uuid.uuid4().hex}"
    kept = "job string, ns string, calls long"
    spark.createDataFrame([], kept).write.parquet(f"{root}/rows")  # a stream without a row writes none
    # update mode gives a row for each key of a micro-batch; the last one holds the key's total
    to_table(stream_counts(lines), f"{root}/rows", f"{root}/checkpoint").awaitTermination()
    found = cut(spark.read.schema(kept).parquet(f"{root}/rows").groupBy("job", "ns").agg(F.max("calls").alias("calls")))
    remove_folder(spark, root)
    return found
