"""The model steps against scripted providers: batches, checks, splits and fallbacks."""

import functools
import json

import pytest
from pyspark.sql import functions as F

from palaver.functions import text as tx
from palaver.operators import graph as gr
from palaver.operators import models as md
from palaver.operators import segments as sg


class Scripted:
    """A provider whose responses are a function of the request; nothing paces it."""

    per_minute = float("inf")

    def __init__(self, rule):
        self.rule = rule

    def respond(self, namespace, body):
        return json.dumps(self.rule(json.loads(body)))


def scripted(rule):
    return functools.partial(Scripted, rule)


def nothing_recorded(spark):
    return spark.createDataFrame([], "namespace string, request_sha256 string, body string")


def see(body):
    return {"frames": [{"frame_index": i, "setting": " hall ", "onscreen_text": None, "chyron_name": p if i % 2 == 0 else "", "chyron_role": "", "person_standing": i % 3 == 0, "standing_description": ""} for i, p in reversed(list(enumerate(body["images"])))]}


def announce(body):
    ids = [line[1 : line.index("]")] for line in body["lines"]]
    found = [{"segment_id": s, "announced_name": f"N{s}", "announced_role": "", "quote": "q"} for s in ids[::3]]
    return {"introductions": [*found, {"segment_id": ids[0], "announced_name": "again", "announced_role": "", "quote": ""}, {"segment_id": "S0", "announced_name": "x", "announced_role": "", "quote": ""}]}


def drop_one(body):
    return {"frames": see(body)["frames"][1:]}


def test_every_frame_must_be_answered(spark):
    frames = spark.createDataFrame([("v", float(i), f"f{i}") for i in range(7)], "video_id string, t double, path string")
    found = md.describe_frames(frames, nothing_recorded(spark), scripted(see)).orderBy("t").collect()
    assert [r.chyron_name for r in found] == ["f0", "", "f2", "", "f4", "", "f6"] and found[0].setting == "hall"
    with pytest.raises(Exception, match=r"frames sent, \d entries got"):
        md.describe_frames(frames, nothing_recorded(spark), scripted(drop_one)).collect()


def test_introductions_are_of_known_segments(spark):
    segs = spark.createDataFrame([("v", f"S{i:03d}", "t") for i in range(1, 8)], "video_id string, id string, text_ta string")
    found = md.find_introductions(segs, nothing_recorded(spark), scripted(announce)).orderBy("segment_id").collect()
    assert [(r.segment_id, r.announced_name) for r in found] == [("S001", "NS001"), ("S004", "NS004"), ("S007", "NS007")]


def lengths(body):
    return {"embeddings": [[float(len(t)), 0.0] for t in body["texts"]]}


def test_embeddings_are_unit_vectors_of_texts_that_say_something(spark):
    rows = [("k", i, "x" * (i + 1)) for i in range(20)]
    texts = spark.createDataFrame(rows, "key string, id long, text string")
    found = md.embed(texts, nothing_recorded(spark), scripted(lengths)).collect()
    assert len(found) == 20 and {tuple(r.embedding) for r in found} == {(1.0, 0.0)}
    with pytest.raises(Exception, match="nothing to embed in 99"):
        md.embed(texts.union(spark.createDataFrame([("k", 99, "  ")], texts.schema)), nothing_recorded(spark), scripted(lengths)).collect()


class Down:
    per_minute = float("inf")

    def respond(self, namespace, body):
        raise RuntimeError("down")


def test_rerank_falls_back_to_the_fused_order(spark):
    hits = spark.createDataFrame([("q", f"D{i}", i, "line") for i in range(1, 9)], "query_id string, doc_id string, rank long, line string")
    asked = spark.createDataFrame([("q", "what")], "query_id string, text string")
    found = md.rerank(hits, asked, 6, nothing_recorded(spark), Down).orderBy("final_rank").collect()
    assert [(r.doc_id, r.degraded) for r in found] == [(f"D{i}", True) for i in range(1, 7)]


def one_vote(pick, body):
    return {"match": pick, "confidence": "low", "reason": ""}


def test_votes_name_members_by_place(spark):
    stands = spark.createDataFrame([("v", 1, "M1", "f", 1.0, ["M3", "M1", "M2"])], "video_id string, turn_index long, member_id string, frame string, t double, lineup array<string>")
    for pick, letter, member in (("b ", "B", "M1"), ("D", "D", None), ("none", "NONE", None)):
        r = md.vote_faces(stands, nothing_recorded(spark), functools.partial(Scripted, functools.partial(one_vote, pick))).first()
        assert (r.picked, r.picked_member) == (letter, member)


def half_named(body):
    return {"members": [{"member_id": r.split(" | ")[0], "tamil_name": "latin", "tamil_aliases": [], "en_aliases": []} for r in body["rows"]]}


def test_names_must_be_tamil(spark):
    members = spark.createDataFrame([(1, "m", "N", "P", "C", None, ["x"])], "ord long, member_id string, name string, party_code string, constituency_name string, tamil_name string, en_aliases array<string>")
    with pytest.raises(Exception, match="no Tamil name for m N"):
        md.write_aliases(members, nothing_recorded(spark), scripted(half_named)).collect()


def clock(body):
    """The clock runs 1.5 times too fast on spans of 100 s and more."""
    n, speed = int(body["duration"] // 10), 1.5 if body["duration"] >= 100 or body["path"] == "short" else 1.0
    return {"segments": [{"start": 10.0 * i * speed, "end": 10.0 * (i + 1) * speed, "voice": "A", "new_speaker": i == 0, "text_ta": f"t{i}", "text_en": None} for i in range(n)]}


def test_spans_with_a_wrong_clock_are_split_or_scaled(spark):
    spans = spark.createDataFrame([("v", "C0", "long", 0.0, 160.0), ("v", "C1", "short", 160.0, 60.0)], "video_id string, label string, path string, abs_start double, duration double")
    pauses = spark.createDataFrame([("v", 70.0), ("v", 95.0), ("v", 30.0)], "video_id string, mid double")
    found = md.transcribe(spans, pauses, "", nothing_recorded(spark), scripted(clock)).orderBy("t_start_raw").collect()
    first = [r for r in found if r.chunk == "C0a"]
    assert {r.chunk for r in found} == {"C0a", "C0b", "C1"} and len(first) == 7 and not first[0].rescaled
    assert [r.t_start_raw for r in found if r.chunk == "C0b"] == [70.0 + 10 * i for i in range(9)]
    assert [(r.t_start_raw, r.rescaled) for r in found if r.chunk == "C1"] == [(pytest.approx(160 + 10.0 * i), True) for i in range(6)]


def test_coverage_that_fails(spark):
    segs = spark.createDataFrame([("v", 0.0, 10.0)], "k string, t_start double, t_end double")
    enough = spark.createDataFrame([("v", 40.0, 0.5)], "k string, duration double, ratio double")
    assert sg.require_coverage(segs, ["k"], enough).count() == 1
    with pytest.raises(ValueError, match="v cover less"):
        sg.require_coverage(segs, ["k"], enough.withColumn("ratio", F.lit(1.0)))


def test_graph_endpoints_and_both_scripts(spark):
    keys = ["video_id"]
    words = lambda *n: [(0, sum(1 << x for x in n))]
    data = [("PERSON:a b", "A B", "அ", 0, words(1)), ("TOPIC:tax", "Tax", "வரி", 1, words(2, 3, 4)), ("PLACE:tax", "Tax", "", 2, words(5))]
    nodes = spark.createDataFrame([("v", *x) for x in data], "video_id string, key string, label string, tamil string, first long, words array<struct<word:bigint,bits:bigint>>")
    members = spark.createDataFrame([("Mr B", "A B"), ("gone", "No Node")], "alias string, name string")
    rel = spark.createDataFrame([("v", 1, "Mr B", "on", " TAX", ["S001"]), ("v", 2, "gone", "on", "Tax", ["S001"]), ("v", 3, "Tax", "is", "tax", ["S001"]), ("v", 4, "Mr B", "x", "unknown", ["S001"])], "video_id string, relation_id long, subject string, predicate string, object string, segment_ids array<string>")
    assert [(r.relation_id, r.source, r.target) for r in gr.resolve_endpoints(rel, nodes, members, keys).collect()] == [(1, "PERSON:a b", "PLACE:tax")]
    edges = spark.createDataFrame([("v", "PERSON:a b", "TOPIC:tax", 0)], "video_id string, source string, target string, ord long")
    asked = spark.createDataFrame([("v", 1, "என்ன வரி?")], "video_id string, query_id long, text string")
    assert [r.id for r in gr.expand(asked, nodes, edges, keys).orderBy("rank").collect()] == ["S002", "S003", "S004", "S001"]
    inside = spark.createDataFrame([("v", 1, "syntax")], "video_id string, query_id long, text string")
    assert gr.expand(inside, nodes, edges, keys).count() > 0 and gr.expand(inside, nodes, edges, keys, word_start=True).count() == 0

def test_small_functions(spark):
    df = spark.createDataFrame([("C1:A", "x/y z", "key=abc", 3.25, {"a": 1, "b": 1}, {"b": 2})], "v string, n string, s string, t double, m map<string,int>, o map<string,int>")
    c = F.col
    row = df.select(tx.chunk_prefix(c("v")), tx.namespace(c("n")), tx.redact(c("s"), "abc"), tx.redact(c("s"), ""), tx.frame_name(c("t")), tx.midpoint(c("t"), F.lit(4.25)), tx.eta(F.lit(2), F.lit(6), F.lit(3.0)), tx.merged_map(c("m"), c("o")), tx.has_tamil(F.lit("a அ")), tx.has_tamil(c("n")), tx.eta(F.lit(0), F.lit(6), F.lit(3.0))).first()
    assert tuple(row) == ("C1", "x_y_z", "key=***", "key=abc", "frame_000032.jpg", 3.75, 6.0, {"a": 1, "b": 2}, True, False, None)
    members = spark.createDataFrame([(1, "A", "அ", "P", ["MLA"]), (2, "B", None, "P", ["Minister"]), (3, "C", None, "P", [])], "ord long, name string, tamil_name string, party_code string, current_roles array<string>")
    assert [r.line for r in sg.names_hint(members, 2).collect()] == ["-  (B, P, Minister)", "- அ (A, P, MLA)"]


def test_table_functions_batch_and_answer(spark):
    """Batches keep order and columns of any type; two failing calls leave the other rows; a provider answers what is not recorded."""
    from palaver.operators import calls

    rows = spark.createDataFrame([(f"v{i % 2}", i, [f"t{i}"]) for i in range(95)], "video_id string, id long, texts array<string>").repartition(4)
    sent = calls.in_batches(rows, ["video_id"], [F.col("id").asc()], 15)
    assert sent.schema.simpleString() == "struct<video_id:string,batch:bigint,items:array<struct<id:bigint,texts:array<string>>>>"
    got = {(r.video_id, r.batch): [x.id for x in r["items"]] for r in sent.collect()}
    for v in (0, 1):
        ids = [i for i in range(95) if i % 2 == v]
        assert [got[f"v{v}", b] for b in range(4)] == [ids[b * 15 : b * 15 + 15] for b in range(4)]
    requests = sent.select("video_id", "batch", F.concat_ws("-", "video_id", F.col("batch").cast("string")).alias("body"))
    from palaver.functions.text import request_key

    say = lambda t, reason="STOP": json.dumps({"candidates": [{"finishReason": reason, "content": {"parts": [{"text": t}]}}]})
    bodies = {"v0-0": '{"n": 1}', "v0-1": "{broken", "v0-2": say('```json\n{"n": 3}\n```'), "v0-3": say("", "SAFETY")}
    known = spark.createDataFrame(list(bodies.items()), "asked string, body string")
    recorded = known.select(F.lit("ns").alias("namespace"), request_key(body=F.col("asked"), namespace=F.lit("ns")).alias("request_sha256"), "body")
    done = {r.body: (r.answer and r.answer.n, r._error) for r in calls.answers(requests, "ns", "n int", recorded).collect()}
    none = "no model provider is configured for ns; give one, or a table of recorded responses"
    assert done == {"v0-0": (1, None), "v0-1": (None, "parse"), "v0-2": (3, None), "v0-3": (None, "blocked"), **{f"v1-{b}": (None, none) for b in range(4)}}
    live = calls.answers(requests, "ns", "n int", recorded, Seven)
    assert {r.answer and r.answer.n for r in live.where("video_id = 'v1'").collect()} == {7}


class Seven:
    per_minute = float("inf")

    def respond(self, namespace, body):
        return '{"n": 7}'
