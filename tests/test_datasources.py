"""The graph store's commits and the tool logs' partitions."""

import pytest
from pyspark.sql import functions as F

from palaver.sources import datasources as ds


@pytest.fixture(scope="module")
def session(spark):
    ds.register(spark)
    return spark


def store(spark, path):
    return spark.read.format(ds.STORE).option("path", str(path)).load()


def put(df, path):
    df.write.format(ds.STORE).mode("append").option("path", str(path)).save()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_store_replaces_recordings_once_and_whole(session, tmp_path):
    df = session.createDataFrame([(f"v{i % 4}", f"k{i}", [f"S{i:03d}"]) for i in range(40)], "video_id string, key string, segment_ids array<string>").repartition(3)
    put(df, tmp_path)
    put(df, tmp_path)  # the same again is there once
    assert rows(store(session, tmp_path)) == rows(df)
    new = session.createDataFrame([("v1", "only", ["S001"])], df.schema)
    put(new, tmp_path)
    expected = new.unionByName(df.where("video_id <> 'v1'"))
    assert rows(store(session, tmp_path)) == rows(expected)
    ds.delete(str(tmp_path), ["v2"])
    assert rows(store(session, tmp_path)) == rows(expected.where("video_id <> 'v2'"))


def test_what_a_dead_attempt_left_is_never_read(session, tmp_path):
    schema = "video_id string, key string"
    put(session.createDataFrame([("v1", "a")], schema), tmp_path)
    writer = ds.StoreWriter(str(tmp_path))
    batch = session.createDataFrame([("v1", "b")], schema).toArrow().to_batches()
    lost, kept = writer.write(iter(batch)), writer.write(iter(batch))  # two attempts of one task: the first one's executor is lost
    assert rows(store(session, tmp_path)) == [("v1", "a")]
    writer.commit([kept, None])
    assert rows(store(session, tmp_path)) == [("v1", "b")]
    writer.abort([lost])
    with pytest.raises(Exception, match="boom"):
        put(session.createDataFrame([("v1", "c")], schema).withColumn("key", F.raise_error(F.lit("boom"))), tmp_path)
    assert rows(store(session, tmp_path)) == [("v1", "b")]


def test_filters_leave_files_out(session, tmp_path):
    for i in range(6):
        put(session.createDataFrame([(f"v{i}", "k")], "video_id string, key string"), tmp_path / "g")
    found, some = store(session, tmp_path / "g"), ds.read(session, ds.STORE, str(tmp_path / "g"), ["v3"])
    assert rows(some) == [("v3", "k")] == rows(found.where("video_id = 'v3'")) and found.count() == 6
    assert (some.rdd.getNumPartitions(), found.rdd.getNumPartitions()) == (1, 6)
    (tmp_path / "logs").mkdir()
    for v in ("a", "b"):
        (tmp_path / "logs" / f"{v}.log").write_text("duration=12.5\nx silence_start: 1.25\n[x] silence_end: 2.5 | y\nframe pts_time:3.001 pts_time: 4\nnothing\n")
    logs, one = ds.read(session, ds.TOOL_LOG, str(tmp_path / "logs")), ds.read(session, ds.TOOL_LOG, str(tmp_path / "logs"), ["b"])
    own = [("b", 0, "duration", 12500), ("b", 1, "silence_start", 1250), ("b", 2, "silence_end", 2500), ("b", 3, "cut", 3001), ("b", 3, "cut", 4000)]
    assert sorted(rows(one), key=lambda r: (r[1], r[3])) == own
    assert logs.count() == 10 and (logs.rdd.getNumPartitions(), one.rdd.getNumPartitions()) == (2, 1)
    with pytest.raises(Exception, match="nothing is committed"):
        store(session, tmp_path / "none").count()
