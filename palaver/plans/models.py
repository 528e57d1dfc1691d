"""Model-step queries over recorded responses, found by the key of each request; no provider is called.

The responses that are on record follow from the requests by a stated rule, so that SQL can state the result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.operators import models as md
from palaver.operators import timeline as tl
from palaver.plans.base import EVENTS, SEGMENTS, events, query, segments
from palaver.session import cut, table


def replies(namespace: str, body: str, rule):
    """Recorded responses, as a look-up by request gives them: a table of namespace, request_sha256 and body.

    rule makes a response of a request's fields (their schema is ``body``), in columns; no provider is called.
    """

    def look_up(requests):
        asked = requests.select("namespace", "request_sha256", F.from_json("body", body).alias("b")).distinct()
        return asked.select("namespace", "request_sha256", F.to_json(rule(F.col("b")), {"ignoreNullFields": "false"}).alias("body"))

    return look_up


def id_of(line):
    """The id between the brackets that a line begins with."""
    return F.regexp_extract(line, r"^\[([^\]]*)\]", 1)


def see(b):
    """Every other frame carries its own path as a name; entries come in reverse."""
    entry = lambda p, i: F.struct(i.alias("frame_index"), F.lit(" hall ").alias("setting"), F.lit(None).cast("string").alias("onscreen_text"), F.when(i % 2 == 0, p).otherwise("").alias("chyron_name"), F.lit("").alias("chyron_role"), (i % 3 == 0).alias("person_standing"), F.lit("").alias("standing_description"))
    return F.struct(F.reverse(F.transform(b["images"], entry)).alias("frames"))


@query(f"""WITH {EVENTS}, f AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY t + event_id / 1000000.0) - 1) % 6 AS i FROM ev WHERE event_type = 'view')
SELECT CAST(user_id AS VARCHAR) AS video_id, 'f' || CAST(event_id AS VARCHAR) AS path, 'hall' AS setting, CASE WHEN i % 2 = 0 THEN 'f' || CAST(event_id AS VARCHAR) ELSE '' END AS chyron_name, i % 3 = 0 AS person_standing FROM f""")
def model_frames(spark, folder):
    e = events(spark, folder).where("event_type = 'view'")
    frames = e.select(F.col("user_id").cast("string").alias("video_id"), (F.col("t") + F.col("event_id") / 1_000_000).alias("t"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"))
    return md.describe_frames(frames, replies("vision", "images array<string>", see)).select("video_id", "path", "setting", "chyron_name", "person_standing")


def announce(b):
    """Every third line announces; one segment is announced twice and one is of no recording."""
    call = lambda s, name, quote: F.struct(s.alias("segment_id"), name.alias("announced_name"), F.lit("").alias("announced_role"), F.lit(quote).alias("quote"))
    ids = F.transform(F.filter(b["lines"], lambda x, i: i % 3 == 0), id_of)
    found = F.transform(ids, lambda s: call(s, F.concat(F.lit("N"), s), "q"))
    return F.struct(F.concat(found, F.array(call(F.get(ids, F.lit(0)), F.lit("again"), ""), call(F.lit("S0"), F.lit("x"), ""))).alias("introductions"))


NUMBERED = f"{SEGMENTS}, n AS (SELECT *, 'S' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t_start, turn) AS k FROM seg) x)"


def numbered(spark, folder):
    rows = tl.number_segments(segments(spark, folder), ["conv_id"], ["t_start", "turn"])
    return rows.withColumn("video_id", F.col("conv_id").cast("string")).withColumn("id", F.col("segment_id"))


@query(f"WITH {NUMBERED} SELECT CAST(conv_id AS VARCHAR) AS video_id, id AS segment_id, 'N' || id AS announced_name FROM n WHERE ((k - 1) % 150) % 3 = 0")
def model_introductions(spark, folder):
    rows = numbered(spark, folder).select("video_id", "id", F.col("text").alias("text_ta"))
    return md.find_introductions(rows, replies("introductions", "lines array<string>", announce)).select("video_id", "segment_id", "announced_name")


def rank(b):
    """The shown ids from the last, one twice and one unknown; a question that begins with a vowel fails."""
    ids = F.transform(b["segments"], id_of)
    ranked = F.slice(F.concat(F.reverse(ids), F.array(F.get(ids, F.lit(0)), F.lit("-1"))), F.lit(1), b["wanted"])
    return F.struct(F.when(~F.substring(b["question"], 1, 1).isin(*"aeiou"), ranked).alias("ranked_ids"))


@query("""WITH q AS (SELECT DISTINCT source AS query_id FROM documents), h AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, count(*) OVER (PARTITION BY source) AS n FROM documents),
t AS (SELECT *, least(n, 20) AS m FROM h WHERE rank <= 20), f AS (SELECT *, CASE WHEN m > 6 AND query_id NOT IN ('src1', 'src2') AND m - rank < 8 THEN m - rank ELSE 1000 + rank END AS place FROM t)
SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY place) AS final_rank, m > 6 AND query_id IN ('src1', 'src2') AS degraded FROM f QUALIFY final_rank <= 6""")
def model_rerank(spark, folder):
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")
    docs = table(spark, folder, "documents").select(F.col("source").alias("query_id"), "doc_id", F.row_number().over(order).cast("long").alias("rank"), "lang")
    hits = docs.where(F.col("rank") <= md.CANDIDATES).withColumnRenamed("lang", "line")
    names = table(spark, folder, "documents").select(F.col("source").alias("query_id")).distinct()
    asked = names.withColumn("text", F.when(F.col("query_id").isin("src1", "src2"), "about it").otherwise("what of it"))
    return md.rerank(hits, asked, 6, replies("rerank", "question string, segments array<string>, wanted int", rank))


def state_facts(b):
    """An entity for each line, of which every fourth cites a segment that was not sent, and one relation without a citation."""
    entity = lambda line, i: F.struct(F.concat(F.lit("E"), id_of(line)).alias("name"), F.lit("").alias("name_ta"), F.lit("TOPIC").alias("type"), F.when(i % 4 == 3, F.array(id_of(line), F.lit("S0"))).otherwise(F.array(id_of(line))).alias("segment_ids"))
    relation = F.struct(F.lit("a").alias("subject"), F.lit("of").alias("predicate"), F.lit("b").alias("object"), F.array().cast("array<string>").alias("segment_ids"))
    return F.struct(F.transform(b["lines"], entity).alias("entities"), F.array(relation).alias("relations"))


@query(f"WITH {NUMBERED}, b AS (SELECT conv_id, (k - 1) // 15 AS batch, (k - 1) % 15 AS i, id FROM n) SELECT CAST(conv_id AS VARCHAR) AS video_id, batch, string_agg('E' || id, ',' ORDER BY i) FILTER (WHERE i % 4 <> 3) AS names, count(*) FILTER (WHERE i % 4 = 3) + 1 AS dropped FROM b GROUP BY conv_id, batch")
def model_facts(spark, folder):
    rows = numbered(spark, folder).select("video_id", "id", F.col("role").alias("speaker"), F.col("text").alias("text_ta"), F.col("text").alias("text_en"))
    entities, _, dropped = md.extract_facts(rows, replies("kg-extract", "lines array<string>", state_facts))
    names = entities.groupBy("video_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), ",").alias("names"))
    return dropped.join(names, ["video_id", "batch"], "left").select("video_id", "batch", "names", F.col("dropped").cast("long").alias("dropped"))


def letter(b):
    picked = F.substring(F.lit("abcdefg"), F.length(b["frame"]) % 7 + 1, F.lit(1))
    return F.struct(F.concat(F.lit(" "), picked).alias("match"), F.lit("high").alias("confidence"), F.repeat(F.lit("r"), 300).alias("reason"))


@query("SELECT o_orderkey AS turn_index, chr(CAST(65 + length(CAST(o_orderkey AS VARCHAR)) % 7 AS INTEGER)) AS picked, CASE WHEN length(CAST(o_orderkey AS VARCHAR)) % 7 < 5 THEN 'M' || CAST(o_orderkey + length(CAST(o_orderkey AS VARCHAR)) % 7 AS VARCHAR) END AS picked_member FROM orders")
def model_votes(spark, folder):
    key = F.col("o_orderkey")
    lineup = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("M"), (key + i).cast("string")))
    stands = table(spark, folder, "orders").select(F.lit("v").alias("video_id"), key.alias("turn_index"), F.lit("M").alias("member_id"), key.cast("string").alias("frame"), F.lit(0.0).alias("t"), lineup.alias("lineup"))
    return md.vote_faces(stands, replies("faceverify", "frame string", letter)).select("turn_index", "picked", "picked_member")


def write_names(b):
    part = lambda row, n: F.get(F.split(row, r" \| "), F.lit(n))
    member = lambda row: F.struct(part(row, 0).alias("member_id"), F.lit(" த ").alias("tamil_name"), F.array(F.lit("அ"), F.lit(" ")).alias("tamil_aliases"), F.array(F.concat(F.lit("Z "), part(row, 1)), F.lit("A")).alias("en_aliases"))
    return F.struct(F.transform(b["rows"], member).alias("members"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS member_id, CASE WHEN s_suppkey % 3 = 0 THEN 'பெ' ELSE 'த' END AS tamil_name, CASE WHEN s_suppkey % 3 = 0 THEN 'B' ELSE 'A,B,Z ' || s_name END AS en_aliases FROM supplier")
def model_aliases(spark, folder):
    key = F.col("s_suppkey")
    members = table(spark, folder, "supplier").select(key.alias("ord"), key.cast("string").alias("member_id"), F.col("s_name").alias("name"), F.lit("P").alias("party_code"), F.lit("C").alias("constituency_name"), F.when(key % 3 == 0, "பெ").alias("tamil_name"), F.array(F.lit("B")).alias("en_aliases"), F.array().cast("array<string>").alias("tamil_aliases"))
    return md.write_aliases(members, replies("roster-tamil", "rows array<string>", write_names)).select("member_id", "tamil_name", F.array_join("en_aliases", ",").alias("en_aliases"))


@query("SELECT source, count(*) AS n, CAST(sum(CASE WHEN n_chars % 3 > 0 THEN n_chars % 50 ELSE 0 END) AS BIGINT) AS tokens, count(*) FILTER (WHERE n_chars % 3 = 0) AS hits, round(count(*) FILTER (WHERE n_chars % 3 > 0) * CAST(CASE WHEN source = 'src1' THEN 0.012 WHEN source = 'src2' THEN 0.009 ELSE 0.004 END AS DOUBLE), 4) AS cost FROM documents GROUP BY source")
def model_usage(spark, folder):
    from palaver.sources.providers import usage

    ns = F.when(F.col("source") == "src1", "transcribe").when(F.col("source") == "src2", "vision").otherwise(F.col("source"))
    calls = table(spark, folder, "documents").select(ns.alias("namespace"), (F.col("n_chars") % 3 == 0).alias("hit"), (F.col("n_chars") % 50).alias("tokens"))
    back = F.when(F.col("namespace") == "transcribe", "src1").when(F.col("namespace") == "vision", "src2").otherwise(F.col("namespace"))
    return usage(calls).select(back.alias("source"), (F.col("hits") + F.col("misses")).alias("n"), "tokens", "hits", "cost")


def cite(b):
    first, last = id_of(F.get(b["segments"], F.lit(0))), id_of(F.element_at(b["segments"], -1))
    return F.struct(F.concat(F.lit("So ["), last, F.lit(", S000] and ["), first, F.lit("]")).alias("text"))


@query(f"""WITH {NUMBERED}, c AS (SELECT conv_id, max(k) AS last FROM n GROUP BY conv_id), w AS (SELECT c.conv_id, 0 AS pos, c.last AS k FROM c UNION ALL SELECT conv_id, 1, 1 FROM c WHERE last > 1)
SELECT CAST(n.conv_id AS VARCHAR) AS video_id, w.pos, n.id, CASE WHEN n.role <> 'system' THEN n.role END AS speaker, n.text AS text_ta, 'So [' || l.id || ',  and [S001]' AS answer FROM w JOIN n ON n.conv_id = w.conv_id AND n.k = w.k JOIN c ON c.conv_id = n.conv_id JOIN n l ON l.conv_id = c.conv_id AND l.k = c.last""")
def answer_flow(spark, folder):
    """Every recording is asked once: context lines, the answer's text, citation checks and whole evidence cards."""
    from palaver.operators import answer as an
    from palaver.operators import segments as sg

    rows = numbered(spark, folder)
    none = F.lit(None)
    who = F.when(F.col("role") != "system", F.col("role"))
    speaker = F.struct(who.alias("name"), none.cast("string").alias("tamil_name"), none.cast("string").alias("party_code"), none.cast("array<string>").alias("roles"), F.lit(0.85).alias("confidence"), none.cast("array<string>").alias("evidence_kinds"))
    segs = rows.select("video_id", "id", (F.col("t_start") / 1000).alias("t_start"), (F.col("t_end") / 1000).alias("t_end"), speaker.alias("speaker"), F.col("text").alias("text_ta"), F.lit("").alias("text_en"), none.cast("array<string>").alias("numeric_flags"), "seq")
    line = sg.context_line(F.col("id"), F.col("speaker.name"), none.cast("string"), F.col("t_start"), F.col("text_ta"), F.col("text_en"))
    context = segs.select(F.col("video_id").alias("answer_id"), F.col("seq").alias("place"), "id", line.alias("line"))
    asked = segs.select(F.col("video_id").alias("answer_id"), F.lit("what was said").alias("text")).distinct()
    answers = md.answer_texts(asked, context, replies("answer", "segments array<string>", cite)).withColumn("video_id", F.col("answer_id"))
    whole = an.answer_records(answers, segs, ["video_id"])
    return whole.select("video_id", "answer", F.posexplode("citations").alias("pos", "c")).select("video_id", "pos", F.col("c.id").alias("id"), F.col("c.speaker").alias("speaker"), F.col("c.text_ta").alias("text_ta"), "answer")


LENGTHS = "lengths array<struct<id: bigint, words: int>>"


@query("""WITH d AS (SELECT 'V' || CAST(doc_id % 25 AS VARCHAR) AS video_id, doc_id, coalesce(length(text) - length(replace(text, ' ', '')), 0) AS blanks FROM documents),
b AS (SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY doc_id) - 1) // 15 AS batch FROM d)
SELECT video_id, doc_id, CASE WHEN batch % 4 IN (1, 2) THEN NULL ELSE blanks END AS words, CASE batch % 4 WHEN 1 THEN 'parse' WHEN 2 THEN 'no model provider is configured for lengths; give one, or a table of recorded responses' END AS error FROM b""")
def model_calls(spark, folder):
    """Documents of 25 recordings in batches of 15: of every four responses one is broken and one is missing, and the others stand."""
    from palaver.functions.text import request_key
    from palaver.operators import calls

    blanks = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))), F.lit(0))
    docs = table(spark, folder, "documents").select(F.concat(F.lit("V"), (F.col("doc_id") % 25).cast("string")).alias("video_id"), "doc_id", blanks.alias("blanks"))
    sent = cut(calls.in_batches(docs, ["video_id"], [F.col("doc_id").asc()], 15))
    requests = sent.withColumn("body", F.to_json(F.struct("video_id", F.col("items.doc_id").alias("ids"))))
    # what is on record, made from the documents by their batch
    reply = F.to_json(F.struct(F.transform("items", lambda x: F.struct(x["doc_id"].alias("id"), x["blanks"].alias("words"))).alias("lengths")))
    recorded = requests.where("batch % 4 <> 2").select(F.lit("lengths").alias("namespace"), request_key(body=F.col("body"), namespace=F.lit("lengths")).alias("request_sha256"), F.when(F.col("batch") % 4 == 1, "{oops").otherwise(reply).alias("body"))
    done = calls.answers(requests, "lengths", LENGTHS, recorded)
    rows = done.select("video_id", F.explode("items").alias("i"), "answer", "_error").select("video_id", F.col("i.doc_id").alias("doc_id"), F.get(F.filter("answer.lengths", lambda x: x["id"] == F.col("i.doc_id")), F.lit(0))["words"].alias("words"), F.col("_error").alias("error"))
    return rows
