"""Sources, the provider seam and job state."""

import json

import pytest
from pyspark.sql import functions as F

from palaver.sources import artifacts as ar
from palaver.sources import providers as pv
from palaver.streaming import jobs


class Shout:
    def respond(self, namespace, body):
        if body == "bad":
            raise ValueError("refused")
        return json.dumps({"text": body.upper()})


def test_recorded_corrupt_and_failed_responses(spark):
    requests = spark.createDataFrame([("a",), ("b",), ("bad",)], "body string")
    keys = {r.body: r.request_sha256 for r in pv.with_keys(requests, "ns").collect()}
    recorded = spark.createDataFrame([("ns", keys["a"], '{"text":"old"}'), ("ns", keys["b"], "{broken")], ar.SCHEMAS["model_responses"])
    with pytest.raises(RuntimeError, match="1 requests of ns failed: refused"):
        pv.call(requests, "ns", recorded, Shout)
    found = pv.call(requests, "ns", recorded, Shout, strict=False).select("body", pv.parsed(F.col("response"), "text string")["text"].alias("t"), "_error")
    assert sorted(tuple(x or "" for x in r) for r in found.collect()) == [("a", "old", ""), ("b", "B", ""), ("bad", "", "refused")]
    with pytest.raises(RuntimeError, match="no model provider"):
        pv.call(requests, "ns", recorded)
    assert pv.call(requests.where("body = 'a'"), "ns", recorded).count() == 1  # all recorded: no provider is needed


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "embedding array<float>")
    assert pv.unit_vectors(df).first()[0] == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="not finite"):
        pv.unit_vectors(spark.createDataFrame([([0.0, 0.0],)], "embedding array<float>")).collect()


def test_artifacts_round_trip_and_overwrite(spark, tmp_path):
    root = str(tmp_path)
    make = lambda v, text: spark.createDataFrame([(v, "S001", text)], "video_id string, id string, text_ta string").select("video_id", "id", "text_ta")
    ar.write_table(make("a", "வணக்கம்").union(make("b", "x")), root, "segments")
    ar.write_table(make("b", "y"), root, "segments")
    assert sorted((r.video_id, r.text_ta) for r in ar.read_table(spark, root, "segments").collect()) == [("a", "வணக்கம்"), ("b", "y")]
    (tmp_path / "s.json").write_text(json.dumps([{"video_id": "a", "start": 1.5, "end": 2.0}]))
    assert ar.read_json(spark, f"{root}/s.json", "silences").first().start == 1.5
    one, two = (ar.fingerprints(make("a", t), ["video_id"]).first().fingerprint for t in ("x", "y"))
    assert one != two == ar.fingerprints(make("a", "y"), ["video_id"]).first().fingerprint


def test_tool_output(spark):
    lines = spark.createDataFrame([("v", 1, "x silence_start: -0.25"), ("v", 2, "silence_end: 3.5 | silence_duration"), ("v", 3, "noise")], "video_id string, seq long, line string")
    assert [(r.kind, r.t) for r in ar.silence_events(lines).orderBy("seq").collect()] == [("start", -250), ("end", 3500)]
    cuts = spark.createDataFrame([("v", "pts_time:1.25 a pts_time:2"), ("v", "pts_time:2")], "video_id string, line string")
    assert sorted(r.t for r in ar.scene_cuts(cuts).collect()) == [1250, 2000]
    probed = ar.probe(spark.createDataFrame([("v", "codec_name=av1\nwidth=1280\nheight=720\nduration=N/A")], "video_id string, report string")).first()
    assert (probed.duration, probed.codec, probed.width) == (None, "av1", 1280)


def test_candidates_and_roster(spark):
    videos = spark.createDataFrame([("a",), ("b",), ("c",)], "video_id string")
    have = spark.createDataFrame([("b", k) for k in ar.READY] + [("c", k) for k in (*ar.PHASES, "proxy")], "video_id string, kind string")
    assert sorted((r.video_id, r.state, r.ready) for r in ar.candidates(videos, have).collect()) == [("a", "new", False), ("b", "partial", True), ("c", "complete", True)]
    seats = spark.createDataFrame([("1", "A", "sitting"), ("2", "VACANT", None)], "member_id string, name string, membership_state string")
    members, vacant = ar.load_roster(seats, 2)
    assert (members.count(), vacant.count()) == (1, 1)
    with pytest.raises(ValueError, match="not 234"):
        ar.load_roster(seats, 234)


LINES = ["10:00:00 INFO ingest [1/8] audio  start", "10:00:01 INFO ingest [2/8] transcribe  SKIP", "10:00:02 INFO p kg-extract 2/14 (14%)", "10:00:03 INFO p kg-extract 2/14 (14%)", "10:00:04 INFO p kg-extract 5/14 (35%)"]


def test_job_state_batch_and_stream_agree(spark, tmp_path):
    log = [{"job": "j", "seq": i, "line": x} for i, x in enumerate(LINES)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.json").write_text("\n".join(map(json.dumps, log)))
    parsed = jobs.parse(spark.read.schema(ar.SCHEMAS["job_log"]).json(str(tmp_path / "in")))
    batch = sorted(tuple(r) for r in jobs.progress_counts(parsed.where("ns is not null"), ["job"]).collect())
    assert batch == [("j", "kg-extract", 5)]
    assert sorted((r.stage, r.status, r.skipped) for r in jobs.stage_states(parsed).collect()) == [("audio", "done", False), ("transcribe", "done", True)]
    stream = jobs.stream_counts(jobs.parse(jobs.read_log_stream(spark, str(tmp_path / "in"))))
    query = stream.writeStream.format("memory").queryName("counts").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("counts").collect()) == batch


def test_response_text(spark):
    say = lambda reason, *parts: json.dumps({"candidates": [{"finishReason": reason, "content": {"parts": [{"text": t, "thought": h} for t, h in parts]}}]})
    bodies = [say("STOP", ("hm", True), ("a", False), ("b", False)), say("MAX_TOKENS", ("a", False)), say("SAFETY"), say("STOP"), "{}", "{x", '{"promptFeedback":{"blockReason":"OTHER"}}']
    text, error = pv.response_text(F.col("body"))
    found = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string").select("i", text, error).orderBy("i").collect()
    assert [tuple(r)[1:] for r in found] == [("ab", None), (None, "truncated"), (None, "blocked"), (None, "empty"), (None, "empty"), (None, "parse"), (None, "blocked")]


def test_rate_and_backoff():
    limiter = pv.RateLimiter(600)
    import time

    begin = time.monotonic()
    for _ in range(3):
        limiter.acquire()
    assert time.monotonic() - begin >= 0.19
    assert [pv.backoff(n, 1.0) for n in (1, 2, 9)] == [1.5, 3.0, 20.0]


def test_a_job_is_one_state_of_the_counters(spark, tmp_path):
    """Three jobs of two namespaces, in two runs from one checkpoint: a later lower count adds nothing."""
    line = lambda job, seq, ns, k: {"job": job, "seq": seq, "line": f"10:00:00 INFO x {ns} {k}/9 (1%)"}
    first = [line(j, s, ns, k) for j in "abc" for s, ns, k in ((1, "vision", 3), (2, "kg-extract", 2), (3, "vision", 1))]
    (tmp_path / "in").mkdir()
    for n, rows in enumerate([first, [line("a", 4, "vision", 2), line("a", 5, "vision", 5), line("b", 4, "faceverify", 1)]]):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = jobs.stream_counts(jobs.parse(jobs.read_log_stream(spark, str(tmp_path / "in"))))
        jobs.to_table(stream, str(tmp_path / "rows"), str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "rows")).groupBy("job", "ns").agg(F.max("calls")).collect()
    assert {tuple(r) for r in got} == {(j, "kg-extract", 2) for j in "abc"} | {("a", "vision", 5), ("b", "vision", 3), ("c", "vision", 3), ("b", "faceverify", 1)}
    assert spark.read.format("statestore").load(str(tmp_path / "checkpoint")).count() == 3


def test_the_machine_puts_only_what_changed():
    """A job of two batches over a state that counts what is asked of it."""
    from types import SimpleNamespace as Line

    from palaver.streaming.machine import JobMachine

    asked, kept = [], {"stages": {}, "counts": {}, "head": None, "tail": []}

    class Held:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            def do(*a):
                asked.append((self.name, call))
                if call == "updateValue":
                    kept[self.name][a[0]] = a[1]
                elif call in ("update", "put"):
                    kept[self.name] = a[0]
                return {"exists": bool(kept[self.name]), "get": kept[self.name], "iterator": list(kept[self.name].items()) if isinstance(kept[self.name], dict) else None}.get(call)

            return do

    m = JobMachine()
    m.head, m.stages, m.counts, m.tail = map(Held, ("head", "stages", "counts", "tail"))
    line = lambda seq, **k: Line(**{"seq": seq, "line": f"l{seq}", "stage": None, "skipped": False, "ns": None, "k": None, "n": None, "code": None, **k})
    (first,) = m.handleInputRows(("j",), iter([line(2, ns="vision", k=4, n=8), line(1, stage="frames")]), None)
    assert asked == [("head", "get"), ("head", "update"), ("stages", "updateValue"), ("counts", "updateValue"), ("tail", "put")]
    assert (first.state, first.seq, first.calls) == ("running", 2, 4) and ("frames", "run", 50.0) in [tuple(x) for x in first.stages]
    asked.clear()
    (second,) = m.handleInputRows(("j",), iter([line(None, code=3), line(3, ns="vision", k=1, n=0)]), None)
    assert asked == [("head", "get"), ("stages", "iterator"), ("counts", "iterator"), ("tail", "get"), ("head", "update"), ("tail", "put")]
    assert (second.state, second.error, second.calls) == ("failed", "l1\nl2\nl3", 4)


def test_calls_without_a_provider_are_not_paced(spark):
    import time

    from palaver.operators import calls

    requests = spark.range(120).select("id", F.col("id").cast("string").alias("body"))
    recorded = spark.createDataFrame([], "namespace string, request_sha256 string, body string")
    begin = time.monotonic()
    rows = calls.answers(requests, "ns", "n int", recorded).collect()
    assert len(rows) == 120 and all("no model provider" in r._error for r in rows)
    assert time.monotonic() - begin < 20  # paced, 120 calls of 240 a minute take 30 seconds


def test_job_state_stream_reads_a_file_and_a_folder(spark, tmp_path):
    """A table of one file, beside another table, and the same table as a folder of part files."""
    import datetime as dt

    import pyarrow as pa
    import pyarrow.parquet as pq

    from palaver.plans.timelines import job_state_stream

    rows = [{"event_id": i, "ts": dt.datetime(2024, 1, 1, 0, 0, i), "user_id": i % 2, "event_type": "view", "value": float(i)} for i in range(10)]
    made = pa.Table.from_pylist(rows)
    for name in ("file", "folder"):
        (tmp_path / name).mkdir()
    pq.write_table(made, tmp_path / "file/events.parquet")
    pq.write_table(made, tmp_path / "file/other.parquet")
    (tmp_path / "folder/events.parquet").mkdir()
    for k in range(2):
        pq.write_table(made.slice(5 * k, 5), tmp_path / f"folder/events.parquet/part-{k}.parquet")
    for name in ("file", "folder"):
        found = job_state_stream(spark, str(tmp_path / name)).collect()
        assert sorted((r.job, r.ns, r.calls) for r in found) == [("0", "view", 8), ("1", "view", 9)]


def test_stages_stay_done_and_jobs_end(spark, tmp_path):
    lines = [("a", 0, "[1/8] audio  start"), ("a", 1, "[2/8] transcribe  SKIP"), ("a", 2, "[3/8] frames  start"), ("a", 3, "vision 2/8 (25%)"), ("a", 4, "[2/8] transcribe  start"), ("b", 0, "[1/8] audio  start"), ("b", 1, "[7/8] graph  start"), ("b", 2, "kg-extract 3/4 (75%)"), ("b", 3, "boom"), ("c", 0, "[1/8] audio  start")]
    log = spark.createDataFrame([(j, n, f"10:00:0{n} INFO p {x}") for j, n, x in lines], "job string, seq long, line string")
    parsed = jobs.parse(log)
    states = {(r.job, r.stage): (r.status, r.skipped, r.pct) for r in jobs.stage_states(parsed).collect()}
    assert states[("a", "transcribe")] == ("done", True, 100.0) and states[("a", "frames")] == ("done", False, 100.0)
    assert states[("b", "graph")] == ("run", False, 75.0) and states[("b", "audio")][0] == "done"
    ends = {r.job: r for r in jobs.terminal(jobs.stage_states(parsed), spark.createDataFrame([("a", 0), ("b", 2)], "job string, code int"), log).collect()}
    of = lambda j: {s.stage: s.status for s in ends[j].stages}
    assert (ends["a"].state, set(of("a").values()), ends["a"].error) == ("done", {"done"}, None)
    assert (ends["b"].state, of("b")["graph"], of("b")["audio"], of("b")["proxy"]) == ("failed", "fail", "done", "wait") and ends["b"].error.endswith("boom")
    assert (ends["c"].state, of("c")["audio"]) == ("running", "run")
    counts = jobs.costs(jobs.progress_counts(parsed.where("ns is not null"), ["job"]), ["job"])
    assert {r.job: (r.calls, r.est_cost) for r in counts.collect()} == {"a": (2, 0.018), "b": (3, 0.021)}
    # the stream in two parts, restarted from its checkpoint between them; exits come before the last lines
    from palaver.streaming import machine

    for name in ("log", "exits"):
        (tmp_path / name).mkdir()
    put = lambda name, rows: (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows))
    rows = [r.asDict() for r in log.collect()]
    seen = {}
    for part, keep in enumerate((lambda r: r["seq"] < 2, lambda r: r["seq"] >= 2)):
        put(f"log/{part}.json", filter(keep, rows))
        put(f"exits/{part}.json", [{"job": "b", "code": 2}] if part == 0 else [{"job": "a", "code": 0}])
        with machine.state_provider(spark):
            stream = machine.job_stream(jobs.read_log_stream(spark, str(tmp_path / "log")), jobs.read_exit_stream(spark, str(tmp_path / "exits")))
            jobs.to_table(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
        shown = {(r.job, r.stage): (r.status, r.pct) for r in machine.stage_snapshot(spark, str(tmp_path / "ck")).collect()}
    last = {r.job: r for r in jobs.snapshot(spark.read.parquet(str(tmp_path / "out")), ["job"]).collect()}
    for job, end in ends.items():
        assert (last[job].state, last[job].error) == (end.state, end.error)
        assert [(x.stage, x.status) for x in last[job].stages] == [(x.stage, x.status) for x in end.stages]
    assert shown == {k: (status, pct) for k, (status, _, pct) in states.items()}
    assert (last["a"].calls, last["a"].est_cost) == (2, 0.018)


class Flaky:
    """Fails twice with a state that is worth another attempt, then answers; fatal bodies never."""

    per_minute = float("inf")

    def __init__(self):
        self.tries = {}

    def respond(self, namespace, body):
        n = self.tries[body] = self.tries.get(body, 0) + 1
        if "fatal" in body:
            raise pv.ModelError(f"401 key=SECRET after {n}", 401)
        if n < 3:
            raise pv.ModelError("busy", 503)
        return json.dumps({"text": f"{body} after {n}"})


def test_calls_are_tried_again_and_errors_hide_the_secret(spark):
    requests = spark.createDataFrame([("ok",), ("fatal",)], "body string")
    recorded = spark.createDataFrame([], "namespace string, request_sha256 string, body string")
    found = pv.call(requests, "ns", recorded, Flaky, strict=False, policy=pv.Policy(base=0.0, secret="SECRET"))
    got = {r.body: (r.response, r._error) for r in found.collect()}
    assert got == {"ok": ('{"text": "ok after 3"}', None), "fatal": (None, "401 key=*** after 1")}
    assert [pv.ModelError("", s).again for s in (None, 429, 500, 503, 400, 404, 413)] == [True, True, True, True, False, False, False]


def test_sources_that_fail_say_why(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="build it"):
        ar.read_roster(spark, str(tmp_path / "none.json"), 2)
    (tmp_path / "members.json").write_text(json.dumps({"members": [{"member_id": "1", "name": "A", "current_roles": ["MLA"]}, {"member_id": "2", "name": "Vacant"}]}))
    members, vacant = ar.read_roster(spark, str(tmp_path / "members.json"), 2)
    assert ([r.name for r in members.collect()], vacant.count()) == (["A"], 1)
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "one.two.mp4").write_bytes(b"123")
    (tmp_path / "v" / "note.txt").write_bytes(b"")
    files = ar.video_files(spark, str(tmp_path / "v"))
    assert [(r.video_id, r.length) for r in files.collect()] == [("one.two", 3)] and ar.sole_video(files) == "one.two"
    with pytest.raises(ValueError, match="no such"):
        ar.sole_video(files, "x")
    assert ar.settings('\ufeffA="x y"\n# B=1\nC = 2') == {"A": "x y", "C": "2"}
    probes = spark.createDataFrame([("a", 10.0, 10.9), ("b", 10.0, 11.1)], "video_id string, video_s double, audio_s double")
    assert sorted(r.duration for r in ar.heard_duration(probes).collect()) == [10.0, 11.1]
    cuts = spark.createDataFrame([("p", 10.0, 10.2), ("q", 10.0, 10.3)], "path string, planned double, probed double")
    assert ar.check_cuts(cuts.where("path = 'p'")).count() == 1
    with pytest.raises(ValueError, match="q is 10.3"):
        ar.check_cuts(cuts)
    segs = spark.createDataFrame([("v", "S001"), ("v", "S002")], "video_id string, id string")
    vecs = spark.createDataFrame([("v", "S001", [1.0]), ("v", "S002", [0.0])], "video_id string, segment_id string, embedding array<float>")
    assert ar.with_vectors(segs, vecs).count() == 2
    with pytest.raises(ValueError, match="vectors of v"):
        ar.with_vectors(segs, vecs.limit(1))
