"""Timeline operators against hand-written cases and the sequential rule."""

import random

from pyspark.sql import functions as F

from palaver.operators import segments as sg
from palaver.operators import timeline as tl


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_snap_ties_window_and_brute_force(spark):
    rng = random.Random(3)
    points = [("v", i, rng.randrange(0, 3000)) for i in range(200)] + [("e", 0, 12), ("w", 1, 1200)]
    bounds = [("v", rng.randrange(0, 3000)) for _ in range(40)] + [("e", 10), ("e", 14), ("x", 5)]
    found = tl.snap_nearest(spark.createDataFrame(points, "k string, point_id long, t long"), spark.createDataFrame(bounds, "k string, t long"), ["k"], 25)
    expected = []
    for k, i, t in points:
        own = [b for q, b in bounds if q == k]
        best = min(own, key=lambda b: (abs(b - t), b), default=None)
        expected.append((k, i, t, best if best is not None and abs(best - t) <= 25 else t))
    assert rows(found, "k", "point_id", "t", "snapped") == sorted(expected)


def test_pairing(spark):
    marks = [("start", 2), ("start", 5), ("end", 7), ("end", 9), ("start", 20)]
    df = spark.createDataFrame([("a", i, k, t) for i, (k, t) in enumerate(marks)] + [("b", 0, "start", -1), ("b", 1, "end", 3)], "k string, seq long, kind string, t long")
    assert rows(tl.pair_events(df, ["k"], ["t", "seq"], "kind", F.lit(25).cast("long")), "k", "s_start", "s_end") == [("a", 5, 7), ("a", 20, 25), ("b", 0, 3)]


def test_turns_split_on_voice_and_mark(spark):
    data = [("v", i, voice, new, i * 10, i * 10 + 9) for i, (voice, new) in enumerate([("A", False), ("A", False), ("B", True), ("B", True)])]
    df = spark.createDataFrame(data, "k string, o long, voice string, new boolean, t_start long, t_end long")
    assert rows(tl.build_turns(df, ["k"], ["o"], "voice", F.col("new")), "turn_index", "voice", "n_segments") == [(1, "A", 2), (2, "B", 1), (3, "B", 1)]


def test_merge_is_inclusive_and_skips_unknown(spark):
    data = [("m", 1, "X", 0, 100), ("m", 2, "X", 130, 200), ("m", 3, "X", 231, 240), ("n", 1, None, 0, 1), ("n", 2, None, 2, 3)]
    df = spark.createDataFrame(data, "k string, o long, who string, t_start long, t_end long").withColumn("confidence", F.lit(0.5))
    assert rows(tl.merge_runs(df, ["k"], ["o"], "who", 30), "k", "run", "t_start", "t_end") == [("m", 1, 0, 200), ("m", 2, 231, 240), ("n", 1, 0, 1), ("n", 2, 2, 3)]


def test_gaps_include_the_tail(spark):
    df = spark.createDataFrame([("v", 0, 5000), ("v", 25000, 30000), ("v", 49900, 55000)], "k string, t_start long, t_end long")
    durations = spark.createDataFrame([("v", 75000)], "k string, duration long")
    assert rows(tl.gaps(df, ["k"], ["t_start"], 20000, durations), "gap_start", "gap_end") == [(5000, 25000), (55000, 75000)]


def test_carry_chain_and_stops(spark):
    def turn(i, member, procedure=False, announced=False, confidence=None):
        return ("v", i, member, procedure, announced, str(i), i * 10, i * 10 + 9, confidence)

    data = [turn(0, "A", confidence=0.75), turn(1, None), turn(2, None), turn(3, None), turn(4, "S", procedure=True, confidence=0.7), turn(5, None), turn(6, "B", confidence=0.85), turn(7, None, announced=True)]
    df = spark.createDataFrame(data, "k string, o long, member string, kinds_procedure boolean, announced boolean, chunk string, t_start long, t_end long, confidence double")
    found = rows(tl.carry_forward(df, ["k"], ["o"], 10), "o", "member", "confidence")
    assert found == [(0, "A", 0.75), (1, "A", 0.65), (2, "A", 0.55), (3, "A", 0.5), (4, "S", 0.7), (5, None, None), (6, "B", 0.85), (7, None, None)]


def test_band_join_is_inclusive(spark):
    spans = spark.createDataFrame([("v", 1, 10000, 20000)], "k string, span long, t_start long, t_end long")
    points = spark.createDataFrame([("v", 8990), ("v", 9000), ("v", 21000), ("v", 21001), ("w", 10000)], "k string, t long")
    assert rows(tl.band_join(spans, points, ["k"], 1000, 700), "t") == [(9000,), (21000,)]


def test_stride_sample(spark):
    df = spark.createDataFrame([("v", i) for i in range(5)] + [("w", 0)], "k string, o long")
    assert rows(tl.stride_sample(df, ["k"], ["o"], 2), "k", "o") == [("v", 0), ("v", 2), ("w", 0)]


def test_min_spacing_and_frame_plan(spark):
    df = spark.createDataFrame([([1000, 2000, 6000, 7000, 10500],)], "t array<long>")
    assert df.select(tl.min_spacing(F.col("t"), 4000)).first()[0] == [1000, 6000, 10500]
    cuts = spark.createDataFrame([("v", 900, 20000), ("v", 19900, 20000)], "k string, t long, duration long")
    assert rows(tl.frame_plan(cuts, ["k"], 500, 7500, 15000, 4000), "t") == [(1400,), (7500,)]


def test_chunk_plan(spark):
    data = [("long", None, 150_000), ("short", None, 100_000)] + [("cut", m, 260_000) for m in (100_000, 130_000, 5_000)]
    df = spark.createDataFrame(data, "k string, mid long, duration long")
    plan = tl.plan_chunks(df, "k", 120_000, 40_000, 45_000, 30_000)
    assert rows(plan, "k", "c_start", "c_end", "at_silence") == [("cut", 0, 130_000, True), ("cut", 130_000, 230_000, False), ("cut", 230_000, 260_000, False)] or rows(plan.where("k <> 'cut'"), "k", "c_start", "c_end", "at_silence") == [("long", 0, 120_000, False), ("long", 120_000, 150_000, False), ("short", 0, 100_000, True)]
    faults = tl.span_faults(plan, ["k"], spark.createDataFrame([("long", 150_000), ("short", 100_000), ("cut", 260_000)], "k string, duration long"))
    assert rows(faults, "n_empty", "n_broken", "spans_all") == [(0, 0, True)] * 3


def test_segments_placed_split_and_written_back(spark):
    raw = spark.createDataFrame([(100.0, 1.0, 1.0, 3.0, "x"), (100.0, 1.0, 3.0, 3.0, "y"), (100.0, 0.5, 2.0, 6.0, " ")], "abs_start double, scale double, start_local double, end_local double, text string")
    assert rows(sg.place(raw), "t_start_raw", "t_end_raw") == [(101.0, 103.0)]
    snapped = spark.createDataFrame([(5.0, 4.0, 1.0, 2.0), (1.0, 4.0, 1.5, 3.0)], "t_start_snapped double, t_end_snapped double, t_start_raw double, t_end_raw double")
    assert rows(sg.snap_or_keep(snapped), "t_start", "t_end") == [(1.0, 2.0), (1.0, 4.0)]
    spans = spark.createDataFrame([("a", 108.1, 100.0, 0), ("b", 106.9, 100.0, 0), ("c", 99.0, 50.0, 0)], "k string, end_local double, duration double, depth int")
    assert rows(sg.clock_faults(spans, ["k"]), "k", "overshoots", "splittable") == [("a", True, True), ("b", False, False), ("c", True, False)]
    turns = spark.createDataFrame([("v", 1, ["S001"], None), ("v", 2, ["S002", "S003"], "M1")], "k string, turn_index long, segment_ids array<string>, member_id string")
    segs = spark.createDataFrame([("v", s) for s in ("S001", "S002", "S009")], "k string, segment_id string")
    assert rows(sg.write_back(segs, turns, ["k"]).fillna("-").fillna(0), "segment_id", "turn_index", "member_id") == [("S001", 1, "-"), ("S002", 2, "M1"), ("S009", 0, "-")]
    intro = spark.createDataFrame([("v", "S001", "M7", 0), ("v", "S001", "M8", 1)], "k string, segment_id string, member_id string, ord int")
    assert rows(sg.introduction_evidence(turns, intro, ["k"]), "turn_index", "member_id") == [(2, "M7")]
    assert rows(sg.announced(turns, intro, ["k"]), "turn_index") == [(1,)]
