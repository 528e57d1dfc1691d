"""Grounded answers: citation checks, refusal and evidence cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.text import citations


def check_citations(answers: DataFrame) -> DataFrame:
    """answers (answer_id, text, context: array of ids) with good and bad citations and refusal.

    An answer without a citation from its context is a refusal.
    """
    cited = F.array_distinct(citations(F.col("text")))
    found = answers.withColumn("cited", cited)
    good = F.array_intersect("cited", "context")
    return found.withColumn("good", good).withColumn("bad", F.array_except("cited", "context")).withColumn("refused", F.size("good") == 0)


def evidence_cards(checked: DataFrame, segments: DataFrame) -> DataFrame:
    """One row for each good citation in order, with the segment's own columns."""
    cards = checked.select("answer_id", F.posexplode("good").alias("pos", "segment_id"))
    return cards.join(segments, "segment_id", "left")


def strip_citations(text: Column, bad: Column) -> Column:
    """The text without its bad citations, each with a bracket before it and a comma, blanks or bracket after it."""
    one = lambda t, b: F.regexp_replace(t, F.concat(F.lit(r"\[?"), b, F.lit(r"(?!\d),?\s*\]?")), F.lit(""))
    return F.aggregate(F.array_sort(bad), text, one)


# The fields of an evidence card, in order.
CARD = ("id", "t_start", "t_end", "speaker", "speaker_tamil", "party", "roles", "confidence", "evidence_kinds", "text_ta", "text_en", "numeric_flags")


def card_of() -> Column:
    """The evidence card of a segment with its speaker struct; lists that are missing are empty."""
    none = F.array().cast("array<string>")
    sp = F.col("speaker")
    values = {"speaker": sp["name"], "speaker_tamil": sp["tamil_name"], "party": sp["party_code"], "roles": F.coalesce(sp["roles"], none), "confidence": sp["confidence"], "evidence_kinds": F.coalesce(sp["evidence_kinds"], none), "numeric_flags": F.coalesce(F.col("numeric_flags"), none)}
    return F.struct(*[values.get(c, F.col(c)).alias(c) for c in CARD])


def answer_records(answers: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Whole answers (keys, answer_id, question, text, context): text without bad citations, refusal, cards in the order cited, context.

    segments has the artifact schema under the same keys.
    """
    checked = check_citations(answers).withColumn("answer", strip_citations(F.col("text"), F.col("bad")))
    cited = checked.select(*keys, "answer_id", F.posexplode("good").alias("pos", "id")).join(segments.select(*keys, "id", card_of().alias("card")), [*keys, "id"])
    cards = cited.groupBy(*keys, "answer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "card"))), lambda x: x["card"]).alias("citations"))
    joined = checked.join(cards, [*keys, "answer_id"], "left")
    return joined.select(*keys, "answer_id", "question", "answer", "refused", "citations", F.col("context").alias("context_ids"))
