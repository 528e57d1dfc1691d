"""Chat formatting after cumulative-snapshot collapse.

Logs often store a conversation again after every turn, so most rows repeat the turns before. Every
turn gets a rolling hash of the conversation up to it: the running XOR of 128-bit hashes of (place,
role, text), kept in two 64-bit columns, so equal prefixes have equal hashes wherever they are
logged. A conversation whose whole hash is the hash of a proper prefix of another one is a snapshot
of it, and an anti-join drops it. Of equal conversations the one with the smallest id stays. What
stays is maximal and is rendered as one text.

A running window needs no row that holds a conversation; prefixes are made distinct on the map side
before they are shuffled, so a first turn that a third of all conversations share is a few rows. The
turns of a conversation meet only where its one text is rendered.

Turns are ordered by turn number (null first), then role, then text. A null role is ``unknown``, a
null text is empty, and rows of a null conv_id are one conversation. Repeated rows are turns of
their own, and so are turns with one number. Other columns are ignored, whatever their names are. A
very long text is part of one turn. An empty table gives no rows. Markers of the template inside a text are broken up with a
space, so a text cannot open or close a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place, role, text and the rolling hash (a, b) of the conversation up to each turn."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    for name, seed in (("a", 1), ("b", 2)):
        placed = placed.withColumn(name, F.bit_xor(F.xxhash64("place", "role", "text", F.lit(seed))).over(order))
    last = F.lead("place").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).isNull()
    return placed.withColumn("last", last)


def maximal(rolled: DataFrame) -> DataFrame:
    """conv_id, place (number of turns) and copies of the conversations that are no snapshot of a longer one."""
    whole = rolled.where("last").groupBy("place", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    prefixes = rolled.where("not last").select("place", "a", "b").distinct()
    return whole.join(prefixes, ["place", "a", "b"], "left_anti").select("conv_id", "place", "copies")


def safe(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and the rendered text of every maximal conversation."""
    rolled = turns(conversations)
    kept = maximal(rolled).select(F.col("conv_id").alias("_id"), F.col("place").alias("n_turns"), "copies")
    part = F.concat(F.lit(OPEN), safe(F.col("role")), F.lit("\n"), safe(F.col("text")), F.lit(CLOSE + "\n"))
    joined = rolled.select("conv_id", "place", part.alias("part")).join(kept, F.col("conv_id").eqNullSafe(F.col("_id")))
    grouped = joined.groupBy("conv_id", "n_turns", "copies").agg(F.sort_array(F.collect_list(F.struct("place", "part"))).alias("parts"))
    return grouped.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.col("copies").alias("n_copies"), F.array_join(F.col("parts.part"), "").alias("rendered"))


def op10_snapshot_collapse_chat(spark: SparkSession, folder: str) -> DataFrame:
    """conv_id, n_turns, n_copies, n_chars and the SHA-256 of each rendered conversation.

    Null roles are ``unknown`` and null texts empty; rows of a null conv_id are one conversation; repeated rows are
    turns; of equal conversations the smallest id stays; an empty table gives no rows.
    """
    done = render(spark.read.parquet(f"{folder}/conversations.parquet"))
    return done.select("conv_id", "n_turns", "n_copies", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


ORACLE = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS place,
                  '<|im_start|>' || replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || chr(10)
                  || replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10) AS part
           FROM conversations),
p AS (SELECT conv_id, place, string_agg(part, '') OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS body,
             row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) AS back FROM t),
w AS (SELECT min(conv_id) AS conv_id, place, body, count(*) AS copies FROM p WHERE back = 1 GROUP BY place, body)
SELECT conv_id, place AS n_turns, copies AS n_copies, length(body) AS n_chars, sha256(body) AS rendered_sha256
FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.back > 1 AND p.place = w.place AND p.body = w.body)
"""
