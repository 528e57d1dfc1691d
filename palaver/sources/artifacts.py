"""Artifact tables: explicit schemas, JSON and Parquet scans, tool-output parsers, job candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVIDENCE = "kind STRING, member_id STRING, raw STRING, t DOUBLE, frame STRING, segment_id STRING"
SPEAKER = f"member_id STRING, name STRING, tamil_name STRING, party_code STRING, roles ARRAY<STRING>, evidence ARRAY<STRUCT<{EVIDENCE.replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE')}>>, evidence_kinds ARRAY<STRING>, conflict BOOLEAN, confidence DOUBLE, face_verdict STRING"
SCHEMAS = {
    "silences": "video_id STRING, start DOUBLE, end DOUBLE",
    "chunks": "video_id STRING, index INT, path STRING, start DOUBLE, end DOUBLE, duration DOUBLE, cut_at_silence BOOLEAN",
    "segments": "video_id STRING, id STRING, t_start DOUBLE, t_end DOUBLE, t_start_raw DOUBLE, t_end_raw DOUBLE, text_ta STRING, text_en STRING, chunk STRING, voice_local STRING, new_speaker BOOLEAN, rescaled BOOLEAN, numeric_flags ARRAY<STRING>, turn_index INT",
    "frames": "video_id STRING, t DOUBLE, path STRING, setting STRING, onscreen_text STRING, chyron_name STRING, chyron_role STRING, person_standing BOOLEAN, standing_description STRING",
    "introductions": "video_id STRING, segment_id STRING, announced_name STRING, announced_role STRING, quote STRING",
    "turns": "video_id STRING, turn_index INT, voice_local STRING, t_start DOUBLE, t_end DOUBLE, segment_ids ARRAY<STRING>",
    "members": "member_id STRING, name STRING, constituency_number INT, constituency_name STRING, party STRING, party_code STRING, membership_state STRING, current_roles ARRAY<STRING>, former_roles ARRAY<STRING>, portrait STRING, tamil_name STRING, tamil_aliases ARRAY<STRING>, en_aliases ARRAY<STRING>",
    "vectors": "video_id STRING, segment_id STRING, embedding ARRAY<FLOAT>",
    "graph_nodes": "video_id STRING, key STRING, label STRING, type STRING, tamil STRING, party STRING, roles ARRAY<STRING>, portrait STRING, member_id STRING, segment_ids ARRAY<STRING>",
    "graph_edges": "video_id STRING, source STRING, target STRING, predicate STRING, segment_ids ARRAY<STRING>, origin STRING",
    "face_votes": "video_id STRING, turn_index INT, member_id STRING, expected_label STRING, lineup ARRAY<STRING>, frame STRING, t DOUBLE, picked STRING, model_confidence STRING, reason STRING",
    "model_responses": "namespace STRING, request_sha256 STRING, body STRING",
    "job_log": "job STRING, seq BIGINT, line STRING",
}
#: What a finished recording has; four of them make it ready to be asked about.
PHASES = ("audio", "segments", "frames", "turns", "faceverify", "vectors", "graph")
READY = ("segments", "turns", "vectors", "graph")


def read_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A JSON artifact under its declared schema; a row that breaks it fails the scan."""
    return spark.read.schema(SCHEMAS[kind]).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_table(df: DataFrame, root: str, kind: str) -> None:
    """A Parquet table by recording: only the recordings that are in df are replaced, each wholly."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(f"{root}/{kind}")


def read_table(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """A table of write_table(); a filter on video_id prunes folders. Reading never makes a folder."""
    return spark.read.schema(SCHEMAS[kind]).parquet(f"{root}/{kind}")


def fingerprints(df: DataFrame, keys: list[str]) -> DataFrame:
    """A hash of each key's rows, whatever their order: a phase is stale when its input's changes."""
    body = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in sorted(df.columns)])
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.bit_xor(body).alias("fingerprint"))


def load_roster(df: DataFrame, seats: int) -> tuple[DataFrame, DataFrame]:
    """Members and vacant seats of a roster that must have so many seats."""
    n = df.count()
    if n != seats:
        raise ValueError(f"the roster has {n} seats, not {seats}; rebuild it from its source")
    vacant = F.coalesce((F.upper("membership_state") == "VACANT") | (F.upper("name") == "VACANT"), F.lit(False))
    return df.where(~vacant), df.where(vacant)


def read_roster(spark: SparkSession, path: str, seats: int) -> tuple[DataFrame, DataFrame]:
    """Members and vacant seats from a source file {"members": [...]}; a file that isn't there says how to make it."""
    from palaver.session import exists

    if not exists(spark, path):
        raise FileNotFoundError(f"no roster at {path}; build it from its source first")
    whole = spark.read.schema(f"members array<struct<{SCHEMAS['members'].replace(' STRING', ': STRING').replace(' INT', ': INT').replace(' ARRAY', ': ARRAY')}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return load_roster(whole.select(F.explode("members").alias("m")).select("m.*"), seats)


def roster_coverage(members: DataFrame, keys: list[str]) -> DataFrame:
    """Members of each key, and those with a Tamil name and with a portrait."""
    has = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return members.groupBy(*keys).agg(F.count("*").alias("n_members"), has("tamil_name").alias("n_tamil"), has("portrait").alias("n_portrait"))


def video_files(spark: SparkSession, folder: str, pattern: str = "*.mp4") -> DataFrame:
    """path, video_id (the file's stem) and length of the videos of a folder of any store; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("video_id"), "length")


def sole_video(files: DataFrame, video_id: str | None = None) -> str:
    """The video_id asked for, or the only one there is."""
    rows = files.select("video_id").orderBy("video_id").limit(10).collect() if video_id is None else files.where(F.col("video_id") == video_id).select("video_id").limit(1).collect()
    if len(rows) != 1:
        raise ValueError(f"name one of: {', '.join(r.video_id for r in rows)}" if rows else "no such video")
    return rows[0].video_id


def settings(text: str) -> dict[str, str]:
    """KEY=value lines: a byte-order mark, comments and quotes around a value do not count."""
    found = {}
    for line in text.lstrip("\ufeff").splitlines():
        key, mark, value = line.partition("=")
        if mark and not key.lstrip().startswith("#"):
            found[key.strip()] = value.strip().strip("\"'")
    return found


def heard_duration(probes: DataFrame) -> DataFrame:
    """Recordings (video_id, video_s, audio_s) with duration: the audio's where the two are more than a second apart."""
    return probes.withColumn("duration", F.when(F.abs(F.col("audio_s") - F.col("video_s")) > 1.0, F.col("audio_s")).otherwise(F.col("video_s")))


def check_cuts(cuts: DataFrame, most: float = 0.25) -> DataFrame:
    """Cut files (path, planned, probed), if each is as long as planned; otherwise the job fails and names the worst."""
    worst = cuts.where(F.abs(F.col("probed") - F.col("planned")) > most).orderBy(F.abs(F.col("probed") - F.col("planned")).desc(), "path").select("path", "planned", "probed").first()
    if worst is not None:
        raise ValueError(f"{worst.path} is {worst.probed} s long, not {worst.planned} s")
    return cuts


def with_vectors(segments: DataFrame, vectors: DataFrame) -> DataFrame:
    """Segments (video_id, id, ...) with their embedding by key; a recording whose vectors are not its segments' fails the job."""
    ids = segments.select("video_id", "id").join(vectors.select("video_id", F.col("segment_id").alias("id"), F.lit(True).alias("_has")), ["video_id", "id"], "full")
    known = ids.join(segments.select("video_id", "id", F.lit(True).alias("_is")), ["video_id", "id"], "left")
    bad = known.where("_has is null or _is is null").agg(F.min("video_id")).first()[0]
    if bad is not None:
        raise ValueError(f"the vectors of {bad} are not those of its segments; build its index again")
    return segments.join(vectors.select("video_id", F.col("segment_id").alias("id"), "embedding"), ["video_id", "id"])


def silence_events(lines: DataFrame) -> DataFrame:
    """Start and end marks from a silence detector's output (video_id, seq, line), in milliseconds."""
    found = lines.select("video_id", "seq", F.regexp_extract("line", r"silence_(start|end):\s*(-?[\d.]+)", 1).alias("kind"), F.regexp_extract("line", r"silence_(start|end):\s*(-?[\d.]+)", 2).alias("s"))
    return found.where("kind <> ''").select("video_id", "seq", "kind", F.round(F.col("s").cast("double") * 1000).cast("long").alias("t"))


def scene_cuts(lines: DataFrame) -> DataFrame:
    """Distinct cut times from a scene detector's output (video_id, line), in milliseconds."""
    times = F.regexp_extract_all("line", F.lit(r"pts_time:\s*([\d.]+)"), F.lit(1))
    return lines.select("video_id", F.explode(times).alias("s")).select("video_id", F.round(F.col("s").cast("double") * 1000).cast("long").alias("t")).distinct()


def probe(reports: DataFrame) -> DataFrame:
    """duration, codec, width and height from a probe's key=value lines (video_id, report)."""
    m = F.str_to_map("report", F.lit("\n"), F.lit("="))
    return reports.select("video_id", m["duration"].try_cast("double").alias("duration"), m["codec_name"].alias("codec"), m["width"].try_cast("int").alias("width"), m["height"].try_cast("int").alias("height"))


def candidates(videos: DataFrame, artifacts: DataFrame) -> DataFrame:
    """State of each recording (video_id) from its artifacts (video_id, kind): new, partial, complete."""
    wanted = artifacts.where(F.col("kind").isin(*PHASES, "proxy"))
    have = wanted.groupBy("video_id").agg(F.count_distinct("kind").alias("done"), (F.count_distinct(F.when(F.col("kind").isin(*READY), F.col("kind"))) == len(READY)).alias("ready"))
    state = F.when(F.col("done").isNull(), "new").when(F.col("done") == len(PHASES) + 1, "complete").otherwise("partial")
    return videos.join(have, "video_id", "left").select("video_id", F.coalesce("done", F.lit(0)).alias("stages_done"), F.coalesce("ready", F.lit(False)).alias("ready"), state.alias("state"))


def export_graph(nodes: DataFrame, edges: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows for a graph store, by recording: first_seen_s of each node (0 for unknown segments) and typed relations; lists of segment ids.

    segments (video_id, ordinal, t_start) are numbered in order of time, so a node was first seen in its
    smallest ordinal.
    """
    from palaver.functions.text import relation_type
    from palaver.operators import provenance as pv

    ids = pv.segment_names(F.col("words")).alias("segment_ids")
    first = nodes.withColumn("ordinal", pv.first_of(F.col("words"))).join(segments.select("video_id", "ordinal", "t_start"), ["video_id", "ordinal"], "left")
    out = first.select(*[c for c in nodes.columns if c != "words"], ids, F.coalesce("t_start", F.lit(0.0)).alias("first_seen_s"))
    return out, edges.select(*[c for c in edges.columns if c != "words"], ids, relation_type(F.col("predicate")).alias("rel_type"))
