"""Phases made again where inputs changed, and checks inside the job that writes."""

import os

import pytest
from pyspark.sql import functions as F

from palaver.sources import checks as ck
from palaver.sources import phases as ph


def test_only_what_changed_is_made_again(spark, tmp_path):
    root, made = str(tmp_path), []
    texts = spark.createDataFrame([(f"v{i % 5}", i, f"t{i}") for i in range(30)], "video_id string, turn long, text string")
    names = spark.createDataFrame([(f"v{i}", "n") for i in range(5)], "video_id string, name string")

    def make(texts, names):
        made.append(sorted(r.video_id for r in texts.select("video_id").distinct().collect()))
        return texts.join(names, "video_id").groupBy("video_id").agg(F.count("*").alias("n"), F.max("name").alias("name"))

    run = lambda **k: sorted(r.video_id for r in ph.refresh(spark, root, "turns", k, make).collect())
    assert run(texts=texts, names=names) == [f"v{i}" for i in range(5)]
    assert run(texts=texts.repartition(7).orderBy(F.desc("turn")), names=names) == []  # the order of rows is no change
    edited = texts.withColumn("text", F.when(F.col("turn") == 7, "new").otherwise(F.col("text")))
    assert run(texts=edited, names=names) == ["v2"]
    renamed = names.withColumn("name", F.when(F.col("video_id") == "v4", "m").otherwise(F.col("name")))
    assert run(texts=edited, names=renamed) == ["v4"]
    more = edited.unionByName(spark.createDataFrame([("v9", 1, "x")], texts.schema))
    assert run(texts=more, names=renamed.unionByName(spark.createDataFrame([("v9", "n")], names.schema))) == ["v9"]
    assert made == [[f"v{i}" for i in range(5)], [], ["v2"], ["v4"], ["v9"]]
    found = {r.video_id: (r.n, r.name) for r in spark.read.parquet(f"{root}/turns").collect()}
    assert found == {**{f"v{i}": (6, "n") for i in range(4)}, "v4": (6, "m"), "v9": (1, "n")}


def test_a_run_that_dies_leaves_its_recordings_stale(spark, tmp_path):
    texts = spark.createDataFrame([("v1", "t")], "video_id string, text string")
    with pytest.raises(Exception, match="boom"):
        ph.refresh(spark, str(tmp_path), "p", {"texts": texts}, lambda texts: texts.withColumn("text", F.raise_error(F.lit("boom"))))
    assert ph.stale(spark, str(tmp_path), "p", {"texts": texts}).count() == 1


def test_checks_fail_the_job_and_name_the_recording(spark, tmp_path):
    segs = spark.createDataFrame([("a", 0.0, 10.0), ("a", 10.0, 20.0), ("b", 0.0, 10.0)], "k string, t_start double, t_end double")
    speech = spark.createDataFrame([("a", 40.0, 0.9), ("b", 40.0, 0.5)], "k string, duration double, ratio double")
    assert ck.covering(segs, ["k"], speech).count() == 3
    ck.covering(segs, ["k"], speech).write.parquet(f"{tmp_path}/good")
    with pytest.raises(Exception, match="segments of b cover less"):
        ck.covering(segs, ["k"], speech.withColumn("ratio", F.lit(0.9))).write.parquet(f"{tmp_path}/bad")
    assert not os.path.exists(f"{tmp_path}/bad/_SUCCESS")
    spans = spark.createDataFrame([("a", 0.0, 5.0, 10.0), ("a", 5.0, 10.0, 10.0), ("b", 0.0, 4.0, 10.0), ("b", 5.0, 10.0, 10.0)], "k string, t_start double, t_end double, duration double")
    assert len(ck.partitions_of_time(spans.where("k = 'a'"), ["k"]).collect()) == 2
    with pytest.raises(Exception, match="spans of b are no partition"):
        ck.partitions_of_time(spans, ["k"]).collect()
    cuts = spark.createDataFrame([("p", 10.0, 10.2), ("q", 10.0, 10.3)], "path string, planned double, probed double")
    assert len(ck.cuts_as_planned(cuts.where("path = 'p'")).collect()) == 1
    with pytest.raises(Exception, match="q is 10.3 s long, not 10.0 s"):
        ck.cuts_as_planned(cuts).collect()


def test_metrics_are_gathered_by_the_job_that_writes(spark, tmp_path):
    jobs = spark.sparkContext.statusTracker()
    df = spark.range(100).withColumn("seat", F.col("id") % 10)
    spark.sparkContext.setJobGroup("observed", "one write")
    got = ck.write_observed(df, f"{tmp_path}/w", {"n": F.count("*"), "seats": F.max("seat")}, lambda m: None)
    assert got == {"n": 100, "seats": 9} and len(jobs.getJobIdsForGroup("observed")) == 1
    with pytest.raises(ValueError, match="100 seats, not 234"):
        ck.write_observed(df, f"{tmp_path}/x", {"n": F.count("*")}, lambda m: f"{m['n']} seats, not 234")
    assert not os.path.exists(f"{tmp_path}/x")
    slots = spark.range(6).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("e"), F.col("id").cast("string"))).alias("_error"))
    with pytest.raises(RuntimeError, match="3 of 6 failed: e0; e2; e4"):
        ck.failures(slots, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 6
