"""The steps that a model answers: requests as rows, declared response schemas, and checks after them.

Each step makes a request body for every batch of its input, hands it to the provider seam (recorded
responses first) and turns the responses into rows. What a model got wrong is dropped, corrected or
raised as the step says; nothing is made up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.text import has_tamil
from palaver.operators import segments as sg
from palaver.sources import providers as pv

Make = Callable[[], pv.ModelProvider]

# Rows of one request.
FRAMES, INTRODUCTIONS, VECTORS, FACTS, NAMES = 6, 150, 16, 15, 30
# Candidates of a rerank, and how many more than wanted are asked for.
CANDIDATES, MORE = 20, 2

SCHEMAS = {
    "transcribe": "segments array<struct<start: double, end: double, voice: string, new_speaker: boolean, text_ta: string, text_en: string>>",
    "vision": "frames array<struct<frame_index: int, setting: string, onscreen_text: string, chyron_name: string, chyron_role: string, person_standing: boolean, standing_description: string>>",
    "introductions": "introductions array<struct<segment_id: string, announced_name: string, announced_role: string, quote: string>>",
    "faceverify": "match string, confidence string, reason string",
    "embed-batch": "embeddings array<array<float>>",
    "rerank": "ranked_ids array<string>",
    "kg-extract": "entities array<struct<name: string, name_ta: string, type: string, segment_ids: array<string>>>, relations array<struct<subject: string, predicate: string, object: string, segment_ids: array<string>>>",
    "answer": "text string",
    "roster-tamil": "members array<struct<member_id: string, tamil_name: string, tamil_aliases: array<string>, en_aliases: array<string>>>",
}


def batched(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """df with batch, the number of its run of ``size`` rows, and place, its number in it."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(n / size)).withColumn("place", (n % size).cast("int"))


def gathered(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """A row for each batch: its rows in order as the array ``items``."""
    items = F.array_sort(F.collect_list(F.struct("place", *fields))).alias("items")
    return rows.groupBy(*keys, "batch").agg(items)


def asked(batches: DataFrame, namespace: str, ask: str, recorded: DataFrame, make: Make, strict: bool = True, **fields: Column) -> DataFrame:
    """Batches with ``answer``, the parsed response to a request of the ask and the given fields."""
    body = F.to_json(F.struct(F.lit(ask).alias("ask"), *[v.alias(k) for k, v in sorted(fields.items())]))
    done = pv.call(batches.withColumn("body", body), namespace, recorded, make, strict)
    return done.withColumn("answer", pv.parsed(F.col("response"), SCHEMAS[namespace])).drop("body", "response", "request_sha256", "namespace")


def checked(value: Column, holds: Column, message: Column) -> Column:
    """value, or an error that ends the job."""
    return F.when(holds, value).otherwise(F.raise_error(message))


def describe_frames(frames: DataFrame, recorded: DataFrame, make: Make = pv.NoProvider) -> DataFrame:
    """What each frame (video_id, t, path) shows; a response must have an entry for every frame sent, in frame_index order."""
    sent = gathered(batched(frames, ["video_id"], ["t"], FRAMES), ["video_id"], ["t", "path"])
    seen = asked(sent, "vision", "describe each frame; read names only from printed text", recorded, make, images=F.col("items.path"))
    entries = F.array_sort(seen["answer.frames"])  # frame_index comes first
    whole = F.coalesce(F.size("answer.frames"), F.lit(-1)) == F.size("items")
    pairs = checked(F.arrays_zip(F.col("items").alias("sent"), entries.alias("seen")), whole, F.format_string("vision: %d frames sent, %d entries got", F.size("items"), F.size("answer.frames")))
    rows = seen.select("video_id", F.explode(pairs).alias("p")).select("video_id", F.col("p.sent.t").alias("t"), F.col("p.sent.path").alias("path"), F.col("p.seen").alias("seen"))
    text = lambda c: F.trim(F.coalesce(F.col(f"seen.{c}"), F.lit(""))).alias(c)
    return rows.select("video_id", "t", "path", *[text(c) for c in ("setting", "onscreen_text", "chyron_name", "chyron_role")], F.coalesce("seen.person_standing", F.lit(False)).alias("person_standing"), text("standing_description"))


def find_introductions(segments: DataFrame, recorded: DataFrame, make: Make = pv.NoProvider) -> DataFrame:
    """Announcements in the segments (video_id, id, text_ta): of known segments only, the first of each."""
    sent = gathered(batched(segments, ["video_id"], ["id"], INTRODUCTIONS), ["video_id"], ["id", "text_ta"])
    lines = F.transform("items", lambda x: F.concat(F.lit("["), x["id"], F.lit("] "), x["text_ta"]))
    seen = asked(sent, "introductions", "list the calls that name the next speaker", recorded, make, lines=lines)
    rows = seen.select("video_id", "batch", F.posexplode("answer.introductions").alias("pos", "i")).select("video_id", "batch", "pos", "i.*")
    first = rows.groupBy("video_id", "segment_id").agg(F.min_by(F.struct("announced_name", "announced_role", "quote"), F.struct("batch", "pos")).alias("i"), F.min(F.struct("batch", "pos")).alias("ord"))
    known = segments.select("video_id", F.col("id").alias("segment_id"))
    return first.join(known, ["video_id", "segment_id"], "left_semi").select("video_id", "segment_id", "i.*", "ord")


def vote_faces(stands: DataFrame, recorded: DataFrame, make: Make = pv.NoProvider) -> DataFrame:
    """Votes of each standing frame (video_id, turn_index, member_id, frame, t, lineup: portraits of member ids in order).

    picked is the letter, upper case; picked_member the lineup's member of that letter, by id; a letter
    of no place is none.
    """
    seen = asked(stands, "faceverify", "which portrait shows the person who stands, if any", recorded, make, frame=F.col("frame"), lineup=F.col("lineup"))
    picked = F.substring(F.upper(F.trim("answer.match")), 1, 4)
    place = F.when(F.length(picked) == 1, F.ascii(picked) - 64)
    member = F.when((place >= 1) & (place <= F.size("lineup")), F.try_element_at("lineup", place))
    return seen.select("video_id", "turn_index", "member_id", "frame", "t", "lineup", picked.alias("picked"), member.alias("picked_member"), F.col("answer.confidence").alias("model_confidence"), F.substring("answer.reason", 1, 200).alias("reason"))


def embed(texts: DataFrame, recorded: DataFrame, make: Make = pv.NoProvider, task: str = "document") -> DataFrame:
    """Unit vectors of texts (key, id, text); a blank text, a missing vector or one without length raises."""
    whole = texts.withColumn("text", checked(F.col("text"), F.coalesce(F.trim("text") != "", F.lit(False)), F.concat(F.lit("nothing to embed in "), F.col("id").cast("string"))))
    sent = gathered(batched(whole, ["key"], ["id"], VECTORS), ["key"], ["id", "text"])
    seen = asked(sent, "embed-batch", task, recorded, make, texts=F.col("items.text"))
    same = F.coalesce(F.size("answer.embeddings"), F.lit(-1)) == F.size("items")
    pairs = checked(F.arrays_zip(F.col("items.id").alias("id"), F.col("answer.embeddings").alias("embedding")), same, F.lit("the response has another number of vectors than there are texts"))
    return pv.unit_vectors(seen.select("key", F.explode(pairs).alias("p")).select("key", F.col("p.id").alias("id"), F.col("p.embedding").alias("embedding")))


def rerank(hits: DataFrame, questions: DataFrame, k: int, recorded: DataFrame, make: Make = pv.NoProvider) -> DataFrame:
    """Hits (query_id, doc_id, rank, line) with final_rank: a model's known ids first, once each, the others in their order.

    At most CANDIDATES hits of a question are shown, and none where there are no more than k. A failed
    call leaves the order and sets degraded.
    """
    shown = hits.where(F.col("rank") <= CANDIDATES)
    sent = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("id"), F.substring("line", 1, 300).alias("line")))).alias("items")).where(F.size("items") > k)
    wanted = F.least(F.lit(k + MORE), F.size("items"))
    seen = asked(sent.join(questions, "query_id"), "rerank", "rank the segments by how directly they help", recorded, make, strict=False, question=F.col("text"), segments=F.transform("items", lambda x: F.concat(F.lit("["), x["id"], F.lit("] "), x["line"])), wanted=wanted)
    given = seen.select("query_id", F.posexplode("answer.ranked_ids").alias("model_rank", "id")).groupBy("query_id", "id").agg(F.min("model_rank").alias("model_rank"))
    degraded = seen.select("query_id", (F.col("answer.ranked_ids").isNull()).alias("degraded"))
    rows = shown.withColumn("id", F.col("doc_id").cast("string")).join(given, ["query_id", "id"], "left").join(degraded, "query_id", "left")
    order = Window.partitionBy("query_id").orderBy(F.col("model_rank").asc_nulls_last(), "rank")
    return rows.select("query_id", "doc_id", "rank", F.row_number().over(order).cast("long").alias("final_rank"), F.coalesce("degraded", F.lit(False)).alias("degraded")).where(F.col("final_rank") <= k)


def extract_facts(segments: DataFrame, recorded: DataFrame, make: Make = pv.NoProvider) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relations and what was dropped of each batch of segments (video_id, id, speaker, text_ta, text_en).

    Only what cites segments, and those of its own batch alone, is kept.
    """
    sent = gathered(batched(segments, ["video_id"], ["id"], FACTS), ["video_id"], ["id", "speaker", "text_ta", "text_en"])
    lines = F.transform("items", lambda x: F.concat(F.lit("["), x["id"], F.lit("] ("), F.coalesce(x["speaker"], F.lit("unknown")), F.lit(") "), x["text_ta"], F.lit(" | "), F.coalesce(x["text_en"], F.lit(""))))
    seen = asked(sent, "kg-extract", "list entities and relations with the ids of the segments that state them", recorded, make, lines=lines)
    cites = lambda x: (F.size(x["segment_ids"]) > 0) & (F.size(F.array_except(x["segment_ids"], F.col("items.id"))) == 0)
    kept = seen.select("video_id", "batch", *[F.filter(f"answer.{c}", cites).alias(c) for c in ("entities", "relations")], *[F.size(f"answer.{c}").alias(f"n_{c}") for c in ("entities", "relations")])
    rows = [kept.select("video_id", "batch", F.posexplode(c).alias("pos", "x")).select("video_id", "batch", "pos", "x.*") for c in ("entities", "relations")]
    dropped = kept.select("video_id", "batch", (F.col("n_entities") - F.size("entities") + F.col("n_relations") - F.size("relations")).alias("dropped"))
    return rows[0], rows[1], dropped


def answer_texts(questions: DataFrame, context: DataFrame, recorded: DataFrame, make: Make = pv.NoProvider) -> DataFrame:
    """answer_id, question, text and context ids for questions (answer_id, text) and their context (answer_id, place, id, line)."""
    lines = context.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "line"))).alias("items"))
    sent = questions.withColumnRenamed("text", "question").join(lines, "answer_id")
    seen = asked(sent, "answer", "answer from these segments alone and cite their ids in brackets", recorded, make, question=F.col("question"), segments=F.col("items.line"))
    return seen.select("answer_id", "question", F.coalesce("answer.text", F.lit("")).alias("text"), F.col("items.id").alias("context"))


def write_aliases(members: DataFrame, recorded: DataFrame, make: Make = pv.NoProvider) -> DataFrame:
    """Members (ord, member_id, name, party_code, constituency_name, tamil_name, en_aliases) with Tamil names and aliases.

    Only members without a Tamil name are asked for; every one must be answered, in Tamil script.
    English aliases are united with those there, sorted.
    """
    todo = members.where("tamil_name is null or tamil_name = ''").withColumn("key", F.lit(0))
    sent = gathered(batched(todo, ["key"], ["ord"], NAMES), ["key"], ["member_id", "name", "party_code", "constituency_name"])
    rows = F.transform("items", lambda x: F.concat_ws(" | ", x["member_id"], x["name"], x["party_code"], x["constituency_name"]))
    seen = asked(sent, "roster-tamil", "write each member's name in Tamil script, with usual short forms", recorded, make, rows=rows)
    got = seen.select(F.explode("items").alias("i"), "answer.members").select(F.col("i.member_id").alias("member_id"), F.col("i.name").alias("_name"), F.get(F.filter("members", lambda m: m["member_id"] == F.col("i.member_id")), 0).alias("m"))
    named = F.coalesce(has_tamil(F.col("m.tamil_name")), F.lit(False))
    got = got.select("member_id", checked(F.trim("m.tamil_name"), named, F.concat(F.lit("no Tamil name for "), F.col("member_id"), F.lit(" "), F.col("_name"))).alias("_tamil"), "m.tamil_aliases", F.col("m.en_aliases").alias("_en"))
    tidy = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    joined = members.drop("tamil_aliases").join(got, "member_id", "left")
    return joined.withColumn("tamil_name", F.coalesce("_tamil", "tamil_name")).withColumn("en_aliases", F.array_sort(F.array_union(tidy(F.col("en_aliases")), tidy(F.col("_en"))))).withColumn("tamil_aliases", tidy(F.col("tamil_aliases"))).drop("_tamil", "_en")


def transcribe(spans: DataFrame, pauses: DataFrame, names: str, recorded: DataFrame, make: Make = pv.NoProvider, rounds: int = 3) -> DataFrame:
    """Placed segments of spans (video_id, label, path, abs_start, duration); pauses has video_id and mid.

    A span whose clock overshoots is split at the pause nearest its middle and both halves are asked
    again, at most ``rounds`` times; one that can't be split is scaled to its length. A span without
    a segment raises. The loop runs over rounds, not rows.
    """
    asked_spans, done = spans.withColumn("depth", F.lit(0)), None
    for depth in range(rounds + 1):
        seen = asked(asked_spans, "transcribe", "transcribe and translate", recorded, make, names=F.lit(names), path=F.col("path"), start=F.col("abs_start"), duration=F.col("duration"))
        none = F.coalesce(F.size("answer.segments"), F.lit(0)) == 0
        heard = seen.withColumn("segments", checked(F.col("answer.segments"), ~none, F.concat(F.lit("no segments in span "), F.col("label"))))
        heard = heard.withColumn("last", F.array_max("segments.end")).withColumn("over", F.col("last") > F.col("duration") * 1.05 + 2.0)
        ends = heard.where("over").withColumn("t_start", F.col("abs_start")).withColumn("t_end", F.col("abs_start") + F.col("duration")).withColumn("span_id", F.col("label"))
        cuts = sg.split_points(ends.where("duration >= 90").select("video_id", "span_id", "t_start", "t_end"), pauses, ["video_id"]).withColumnRenamed("span_id", "label")
        marked = heard.join(cuts, ["video_id", "label"], "left") if depth < rounds else heard.withColumn("split_at", F.lit(None).cast("double"))
        scale = F.when(F.col("over"), F.col("duration") / F.col("last")).otherwise(1.0)
        whole = marked.where("split_at is null").select("video_id", "label", "abs_start", scale.alias("scale"), F.explode("segments").alias("s"))
        done = whole if done is None else done.unionByName(whole)
        halves = marked.where("split_at is not null")
        if depth == rounds or halves.isEmpty():
            break
        end = F.col("abs_start") + F.col("duration")
        two = F.array(F.struct(F.lit("a").alias("x"), F.col("abs_start").alias("at"), (F.col("split_at") - F.col("abs_start")).alias("long")), F.struct(F.lit("b").alias("x"), F.col("split_at").alias("at"), (end - F.col("split_at")).alias("long")))
        asked_spans = halves.select("video_id", "label", "path", F.explode(two).alias("h"), "depth").select("video_id", F.concat("label", "h.x").alias("label"), "path", F.col("h.at").alias("abs_start"), F.col("h.long").alias("duration"), (F.col("depth") + 1).alias("depth"))
    raw = done.select("video_id", F.col("label").alias("chunk"), "abs_start", "scale", F.col("s.start").alias("start_local"), F.col("s.end").alias("end_local"), F.trim(F.coalesce("s.text_ta", F.lit(""))).alias("text"), F.trim(F.coalesce("s.text_en", F.lit(""))).alias("text_en"), F.concat("label", F.lit(":"), "s.voice").alias("voice_local"), F.coalesce("s.new_speaker", F.lit(False)).alias("new_speaker"), (F.col("scale") != 1.0).alias("rescaled"))
    return sg.place(raw).withColumnRenamed("text", "text_ta").drop("start_local", "end_local", "abs_start", "scale")
