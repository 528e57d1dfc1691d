"""Who speaks: evidence votes, confidence, office rules and face verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Confidence by evidence, its cap under conflict, and the steps of face verification.
CONFIDENCE = {"several": 0.95, "chyron": 0.85, "introduction": 0.75, "conflict": 0.6, "procedure": 0.7}


def evidence_vote(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """The winning member of each turn from evidence (keys, member, kind, ord).

    Most votes win, ties go to the member first seen. Several members are a conflict, which a single
    distinct chyron member overrides; the winner's distinct kinds are sorted.
    """
    per = evidence.groupBy(*keys, "member").agg(F.count("*").alias("votes"), F.min("ord").alias("first"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    best = per.groupBy(*keys).agg(F.max_by(F.struct("member", "votes", "kinds"), F.struct("votes", -F.col("first"))).alias("best"), F.count("*").alias("members"), F.collect_list(F.when(F.array_contains("kinds", "chyron"), F.struct("member", "votes", "kinds"))).alias("shown"))
    conflict = F.col("members") > 1
    chosen = F.when(conflict & (F.size("shown") == 1), F.col("shown")[0]).otherwise(F.col("best"))
    return best.select(*keys, chosen["member"].alias("member"), chosen["votes"].alias("votes"), chosen["kinds"].alias("kinds"), conflict.alias("conflict"))


def confidence_of(kinds: Column, conflict: Column) -> Column:
    base = F.when(F.size(kinds) > 1, CONFIDENCE["several"]).when(F.array_contains(kinds, "chyron"), CONFIDENCE["chyron"]).otherwise(CONFIDENCE["introduction"])
    return F.when(conflict, F.least(base, F.lit(CONFIDENCE["conflict"]))).otherwise(base)


def presiding(turns: DataFrame, speaker: str) -> DataFrame:
    """Unnamed turns with an announcement are the presiding member's."""
    takes = F.col("member").isNull() & F.col("announced")
    return turns.withColumn("kinds_procedure", takes).withColumn("confidence", F.when(takes, CONFIDENCE["procedure"]).otherwise(F.col("confidence"))).withColumn("member", F.when(takes, F.lit(speaker)).otherwise(F.col("member")))


def face_verdict(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Verdict of each turn from votes (keys, expected, picked, on_lineup); picked is null for none."""
    right = F.coalesce(F.col("picked") == F.col("expected"), F.lit(False))
    other = F.coalesce((F.col("picked") != F.col("expected")) & F.col("on_lineup"), F.lit(False))
    verdict = F.when(F.every(right), "confirmed").when(F.some(right), "partial").when(F.some(other), "contradicted").otherwise("unrecognised")
    return votes.groupBy(*keys).agg(verdict.alias("verdict"), F.count("*").alias("n_votes"))


def overlay_confidence(confidence: Column, verdict: Column) -> Column:
    """Confidence after face verification; no verdict and unrecognised leave it."""
    moved = F.when(verdict == "confirmed", F.least(F.lit(0.98), confidence + 0.15)).when(verdict == "partial", F.least(F.lit(0.95), confidence + 0.05)).when(verdict == "contradicted", F.greatest(F.lit(0.3), confidence - 0.3))
    return F.round(F.coalesce(moved, confidence), 2)


def convergent_pick(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Turns all of whose votes (keys, expected, picked, on_lineup) are one and the same wrong candidate of the lineup.

    A vote for none (null) is a vote like any other, so it stands against the others' agreement.
    """
    alike = F.count_distinct(F.coalesce("picked", F.lit("NONE"))) == 1
    found = votes.groupBy(*keys).agg(alike.alias("alike"), F.every(F.coalesce("on_lineup", F.lit(False))).alias("listed"), F.min("picked").alias("picked"), F.min("expected").alias("expected"))
    return found.where(F.col("alike") & F.col("listed") & (F.col("picked") != F.col("expected"))).select(*keys, "picked")


def decoys(members: DataFrame, keys: list[str], n: int = 4) -> DataFrame:
    """Up to n other members of the same keys for each member: member_id, place (1 to n), decoy.

    The members of a key stand in a ring in the order of a hash of their ids, and each gets the n after
    it: seeded, the same in every run, and n rows a member whatever the key's size.
    """
    ring = Window.partitionBy(*keys).orderBy(F.sha2(F.col("member_id").cast("string"), 256), "member_id")
    ranked = members.select(*keys, "member_id", (F.row_number().over(ring) - 1).cast("long").alias("_at"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    asked = ranked.where("_n > 1").withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(n).cast("long"), F.col("_n") - 1))))
    asked = asked.withColumn("_want", (F.col("_at") + F.col("place")) % F.col("_n"))
    others = ranked.select(*keys, F.col("_at").alias("_want"), F.col("member_id").alias("decoy"))
    return asked.join(others, [*keys, "_want"]).select("member_id", F.col("place").cast("long").alias("place"), "decoy")
