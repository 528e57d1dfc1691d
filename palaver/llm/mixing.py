"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: the sources, in code-point order with null last, weigh 5, 2, 1 in turn and share a budget
of 150 % of all words; a target stops at REPEATS times its source's size and the excess is shared
among the others by weight, until none is above.

Blocks: the budget is cut into blocks of BLOCK words. Sainte-Lague gives each block to the source
with the highest quotient target / (2 * seats + 1), and the source's blocks to its shards in the same
way by shard size, so every quota is an integer and the quotas of a source add up to its own. The
highest quotients are found without listing them: a bisection on the price of a seat, then the ties
and the remainder one by one.

Selection: a source is dealt to shards by a hash of the id, as many as keep a shard near SHARD_WORDS
words (MAX_SHARDS at most), so no task holds a source. Within a shard the documents are ordered by a
seeded hash and their words numbered through; each pass over the shard is one run of blocks. A quota
takes whole passes first and then blocks of the next pass in the order of a seeded affine
permutation, so a document is cut at block edges and is taken REPEATS times at most. What is taken of a document is
its spans: ranges of its words (start, end, repeats), of which its taken words are the sum. op5 shuffles
only ids, sizes and hashes, never texts.

The driver holds a row for each source and shard, PLAN_ROWS at most, which is checked; a table of more
than MAX_SOURCES sources is refused.

Null and word-less texts have size 0 and nothing is taken of them. Repeated rows are rows of their
own. Reruns agree; rows that tie in every column are interchangeable. A very long text is cut at block edges as
any other. Columns of the input are kept as they are, whatever their names; the operator's own come after them. An
empty table gives no rows.
"""

from __future__ import annotations

from math import ceil, gcd

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a block.
BLOCK = 16
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
REPEATS = 2
SHARD_WORDS = 1 << 20
MAX_SHARDS = 1024
#: Sources of a mix at most; shards are dealt so that a plan has PLAN_ROWS rows at most.
MAX_SOURCES, PLAN_ROWS = 10_000, 200_000
SEED = 20240229


#: A word and the white space that follows it.
WORD = "[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> list[float]:
    """Target words of sources of these sizes, in the order that the weights go by."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    found, open_, left = [0.0] * len(sizes), set(range(len(sizes))), budget * sum(sizes)
    while open_:
        share = sum(weight[i] for i in open_)
        over = [i for i in sorted(open_) if left * weight[i] / share > repeats * sizes[i]]
        if not over:
            for i in open_:
                found[i] = left * weight[i] / share
            break
        for i in over:
            found[i] = float(repeats * sizes[i])
            open_.discard(i)
        left = budget * sum(sizes) - sum(found[i] for i in range(len(sizes)) if i not in open_)
    return found


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats for each party by the divisors 1, 3, 5, ...; ties go to the earlier party."""
    votes = np.asarray(votes, float)
    if seats <= 0 or not (votes > 0).any():
        return np.zeros(len(votes), np.int64)
    at_price = lambda price: np.floor((votes / price + 1) / 2).astype(np.int64)
    low, high = votes.sum() / (2 * seats + 2 * len(votes) + 2), 2 * votes.max() + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if at_price(mid).sum() > seats else (low, mid)
    given = at_price(high)
    while (left := seats - int(given.sum())) > 0:
        order = np.lexsort((np.arange(len(votes)), -votes / (2 * given + 1)))
        given[order[: min(left, 1)]] += 1
    return given


def stride(n: int, seed: int) -> int:
    """A step coprime to n, so that i -> (i * step + offset) mod n is a permutation."""
    step = (seed * 2654435761 + 40503) % n | 1 if n > 1 else 1
    while gcd(step, n) != 1:
        step += 2
    return step % n or 1


def plan(sized: DataFrame) -> list[dict]:
    """A row for each source and shard: target, blocks, quota and the permutation of its blocks."""
    by = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(by) > MAX_SOURCES:
        raise ValueError(f"a mix is of {MAX_SOURCES} sources at most: their quotas are one plan")
    by.sort(key=lambda r: (r.source is None, r.source or ""))
    aims = targets([r["size"] for r in by])
    quotas = sainte_lague(np.array(aims), round(sum(aims) / BLOCK))
    most = max(1, min(MAX_SHARDS, PLAN_ROWS // max(1, len(by))))
    shards = {r.source: min(most, max(1, ceil(r["size"] / SHARD_WORDS))) for r in by}
    dealt = sized.join(shard_table(sized, shards), sized.source.eqNullSafe(F.col("_s")), "left")
    parts = dealt.groupBy("source", shard_of(F.col("_shards")).alias("shard")).agg(F.sum("size").alias("size")).collect()
    rows, of = [], {}
    for part in sorted(parts, key=lambda p: p.shard):
        of.setdefault(part.source, []).append(part)
    for r, aim, quota in zip(by, aims, quotas, strict=True):
        own = of[r.source]
        sizes = np.array([p["size"] for p in own])
        # a shard can give every block of its REPEATS passes; what it can't hold goes to the others
        room = REPEATS * -(-sizes // BLOCK)
        seats = np.minimum(sainte_lague(sizes, int(quota)), room)
        while (short := min(int(quota), int(room.sum())) - int(seats.sum())) > 0:
            seats = np.minimum(seats + sainte_lague(np.where(seats < room, sizes, 0), short), room)
        for p, seat in zip(own, seats.tolist(), strict=True):
            n = int(-(-p["size"] // BLOCK))
            seed = SEED + 7919 * p.shard + sum(map(ord, r.source or "\0"))
            rows.append({"_s": r.source, "_shard": p.shard, "_shards": shards[r.source], "source_size": int(r["size"]), "target": float(aim), "_blocks": n, "_quota": int(seat), "_step": stride(n, seed) if n else 1, "_from": seed % n if n else 0})
    return rows


def shard_of(shards: Column) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED)), shards).cast("int")


def shard_table(df: DataFrame, shards: dict) -> DataFrame:
    table = df.sparkSession.createDataFrame(list(shards.items()), "_s string, _shards int")
    return F.broadcast(table)  # a row for each source


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a hash of the text, of docs (doc_id, text, source)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))


def mix(sized: DataFrame) -> DataFrame:
    """Rows of sizes_of(), and any columns besides, with source_size, target, taken and spans."""
    spark = sized.sparkSession
    rows = plan(sized.select("doc_id", "source", "size"))
    schema = "_s string, _shard int, _shards int, source_size long, target double, _blocks long, _quota long, _step long, _from long"
    table = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    dealt = sized.join(shard_table(sized, {r["_s"]: r["_shards"] for r in rows}), F.col("source").eqNullSafe(F.col("_s")), "left")
    dealt = dealt.withColumn("_at", shard_of(F.col("_shards"))).drop("_s", "_shards")
    # rows of one source and shard, in seeded order
    order = Window.partitionBy("source", "_at").orderBy(F.xxhash64("doc_id", F.lit(SEED + 1)), "doc_id", "size", "tie")
    placed = dealt.withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = placed.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_at") == F.col("_shard")), "left")
    spans = F.when(F.col("size") > 0, F.concat(whole_passes(), part_pass())).otherwise(F.array().cast(SPANS))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + (s["end"] - s["start"]) * s["repeats"])
    return joined.withColumn("spans", spans).select(*sized.columns, "source_size", "target", taken.alias("taken"), "spans")


def mix_sources(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source, ...) with mix_size, mix_source_size, mix_target, mix_taken and mix_spans at their end."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    at = {c: F.col(n) for c, n in zip(docs.columns, names, strict=True)}
    sized = own.select("*", at["doc_id"].cast("long").alias("doc_id"), at["source"].cast("string").alias("source"), word_count(at["text"]).alias("size"), F.xxhash64(at["text"]).alias("tie"))
    added = [F.col(c).alias(f"mix_{c}") for c in ("size", "source_size", "target", "taken", "spans")]
    return mix(sized).select(*[c.alias(n) for n, c in at.items()], *added)


SPANS = "array<struct<start: bigint, end: bigint, repeats: bigint>>"


def span(start: Column, end: Column, repeats: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), repeats.cast("long").alias("repeats"))


def whole_passes() -> Column:
    """The whole document as a span, where whole passes are taken."""
    many = F.floor(F.col("_quota") / F.col("_blocks"))
    return F.when(many > 0, F.array(span(F.lit(0), F.col("size"), many))).otherwise(F.array().cast(SPANS))


def part_pass() -> Column:
    """Spans of the document in the blocks chosen from the last, partial pass."""
    begin, end = F.col("_end") - F.col("size"), F.col("_end")
    extra = F.col("_quota") % F.col("_blocks")
    step = F.sequence(F.floor(begin / BLOCK), F.floor((end - 1) / BLOCK))
    chosen = lambda b: (b * F.col("_step") + F.col("_from")) % F.col("_blocks") < extra
    words = lambda b: span(F.greatest(begin, b * BLOCK) - begin, F.least(end, (b + 1) * BLOCK) - begin, F.lit(1))
    return F.transform(F.filter(step, chosen), words)


def taken_text(text: Column, spans: Column) -> Column:
    """The words of the spans with their white space; copies, and spans that do not meet, begin a new line."""
    once = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # noqa: E731  (a lambda would evaluate value for each span)
    return once(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda words: once(F.filter(spans, lambda s: s["end"] - s["start"] < F.size(words)), lambda part: joined_spans(text, spans, words, part)))


def joined_spans(text: Column, spans: Column, words: Column, part: Column) -> Column:
    whole = F.filter(spans, lambda s: s["end"] - s["start"] == F.size(words))
    copies = F.flatten(F.transform(whole, lambda s: F.array_repeat(text, s["repeats"].cast("int"))))
    cut = lambda s: F.array_join(F.slice(words, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "")
    apart = lambda s, i: F.when((i > 0) & (F.get(part, i - 1)["end"] != s["start"]), "\n").otherwise("")
    rest = F.array_join(F.transform(part, lambda s, i: F.concat(apart(s, i), cut(s))), "")
    return F.array_join(F.concat(copies, F.when(F.size(part) > 0, F.array(rest)).otherwise(F.array().cast("array<string>"))), "\n")


def op5_sainte_lague_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; texts are not shuffled.

    Null and word-less texts have size 0 and nothing taken; a null source is a source; repeated rows are rows of
    their own; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return mix(sizes_of(docs)).select("doc_id", "size", "source_size", "target", "taken")
