"""From raw transcribed spans to placed segments, and speakers written back to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.operators.timeline import nearest


def place(raw: DataFrame) -> DataFrame:
    """Spans (abs_start, scale, start_local, end_local, text) with times on the recording's clock.

    Reversed and blank spans are dropped.
    """
    kept = raw.where((F.col("end_local") > F.col("start_local")) & (F.trim("text") != ""))
    at = lambda c: F.col("abs_start") + F.col(c) * F.col("scale")
    return kept.withColumn("t_start_raw", at("start_local")).withColumn("t_end_raw", at("end_local"))


def snap_or_keep(df: DataFrame) -> DataFrame:
    """Snapped times, or both unsnapped ones where snapping would turn the segment round."""
    good = F.col("t_end_snapped") > F.col("t_start_snapped")
    return df.withColumn("t_start", F.when(good, F.col("t_start_snapped")).otherwise(F.col("t_start_raw"))).withColumn("t_end", F.when(good, F.col("t_end_snapped")).otherwise(F.col("t_end_raw")))


def clock_faults(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans whose model clock overshoots (end_local, duration, depth), and whether they may be split."""
    per = spans.groupBy(*keys).agg(F.max("end_local").alias("end_local"), F.max("duration").alias("duration"), F.max("depth").alias("depth"))
    over = F.col("end_local") > F.col("duration") * 1.05 + 2.0
    return per.select(*keys, over.alias("overshoots"), (over & (F.col("duration") >= 90) & (F.col("depth") < 3)).alias("splittable"))


def split_points(spans: DataFrame, mids: DataFrame, keys: list[str]) -> DataFrame:
    """The pause nearest each span's centre, within its middle half; ties go to the earlier one.

    spans has keys, span_id, t_start and t_end, mids has keys and mid. The nearest pause to the centre
    is in the middle half if any is, so no span meets more than one pause.
    """
    centre = spans.select(*keys, F.col("span_id").alias("point_id"), ((F.col("t_start") + F.col("t_end")) / 2).alias("t"), ((F.col("t_end") - F.col("t_start")) / 4).alias("window"))
    found = nearest(centre, mids.select(*keys, F.col("mid").cast("double").alias("t")), keys)
    inside = found.where(F.abs(F.col("nearest") - F.col("t")) <= F.col("window"))
    return inside.select(*keys, F.col("point_id").alias("span_id"), F.col("nearest").alias("split_at"))


def coverage(segments: DataFrame, keys: list[str], speech: DataFrame) -> DataFrame:
    """Covered time of each key against its speech (keys, duration, ratio); under half of it fails."""
    covered = segments.groupBy(*keys).agg(F.sum(F.col("t_end") - F.col("t_start")).alias("covered"))
    both = speech.join(covered, keys, "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))
    wanted = F.col("duration") * F.col("ratio")
    return both.select(*keys, "covered", wanted.alias("speech"), (F.col("covered") >= 0.5 * wanted).alias("enough"))


def require_coverage(segments: DataFrame, keys: list[str], speech: DataFrame) -> DataFrame:
    """The segments, if each key's cover half of its speech; otherwise the job fails and names a key."""
    short = coverage(segments, keys, speech).where(~F.col("enough"))
    worst = short.agg(F.min(F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))).first()[0]
    if worst is not None:
        raise ValueError(f"segments of {worst} cover less than half of its speech: a part has failed")
    return segments


def write_back(segments: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """Speaker and turn of each segment; a segment of no turn is of an unknown speaker."""
    of = turns.select(*keys, "turn_index", "member_id", F.explode("segment_ids").alias("segment_id"))
    return segments.join(of, [*keys, "segment_id"], "left")


def introduction_evidence(turns: DataFrame, introductions: DataFrame, keys: list[str]) -> DataFrame:
    """Turns whose speaker the turn before announced: introductions (keys, segment_id, member_id, ord), one a segment."""
    before = F.lag("segment_ids").over(Window.partitionBy(*keys).orderBy("turn_index"))
    lagged = turns.select(*keys, "turn_index", before.alias("_ids")).select(*keys, "turn_index", F.explode("_ids").alias("segment_id"))
    once = introductions.groupBy(*keys, "segment_id").agg(F.min_by("member_id", "ord").alias("member_id"))
    return lagged.join(once, [*keys, "segment_id"]).where("member_id is not null")


def announced(turns: DataFrame, introductions: DataFrame, keys: list[str]) -> DataFrame:
    """Turns that hold an announcement themselves."""
    own = turns.select(*keys, "turn_index", F.explode("segment_ids").alias("segment_id"))
    return own.join(introductions.select(*keys, "segment_id"), [*keys, "segment_id"], "left_semi").select(*keys, "turn_index").distinct()


def voice_counts(segments: DataFrame, keys: list[str], voice: str, name: str = "n_speaker_turns") -> DataFrame:
    """Segments that begin a speaker's turn (new_speaker), and distinct local voices, of each key."""
    return segments.groupBy(*keys).agg(F.count_if("new_speaker").alias(name), F.count_distinct(voice).alias("n_voices"))


def frame_counts(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames of each key, those with a printed name, and those with a standing person."""
    return frames.groupBy(*keys).agg(F.count("*").alias("n_frames"), F.count_if(F.col("chyron_name") != "").alias("n_chyron"), F.count_if("person_standing").alias("n_standing"))


def forced_cuts(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Indices of each key's chunks (keys, chunk_index, at_silence) after the first that are not cut at a pause."""
    forced = F.when(~F.col("at_silence") & (F.col("chunk_index") > 0), F.col("chunk_index"))
    return chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(forced)).alias("forced"))


def names_hint(members: DataFrame, most: int = 60) -> DataFrame:
    """The members (ord, name, tamil_name, party_code, current_roles) that a prompt names, at most ``most``: office holders first, each by ord."""
    office = (F.size("current_roles") > 0) & (F.col("current_roles") != F.array(F.lit("MLA")))
    role = F.coalesce(F.get("current_roles", 0), F.lit("MLA"))
    line = F.format_string("- %s (%s, %s, %s)", F.coalesce("tamil_name", F.lit("")), "name", "party_code", role)
    return members.select("ord", office.alias("office"), line.alias("line")).orderBy(F.col("office").desc(), "ord").limit(most)


def context_line(segment_id: Column, speaker: Column, role: Column, t_start: Column, original: Column, english: Column) -> Column:
    """The line by which a segment is shown to an answering model."""
    who = F.concat(F.coalesce(speaker, F.lit("Unknown speaker")), F.coalesce(F.concat(F.lit(" ("), role, F.lit(")")), F.lit("")))
    return F.format_string("[%s] %s at %ds: %s | %s", segment_id, who, F.bround(t_start).cast("long"), F.coalesce(original, F.lit("")), F.coalesce(english, F.lit("")))
