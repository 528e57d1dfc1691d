"""Closed-vocabulary entity resolution: alias index, exact then fuzzy names, unique office holders."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.text import normalise_name
from palaver.session import bounded, cut

#: Shares of what a similarity may lack that are looked at in turn: names that are nearly an alias never meet those that are merely alike.
STEPS = (0.25, 0.5, 1.0)


def alias_index(aliases: DataFrame) -> DataFrame:
    """alias and member_id for aliases (member_id, alias) that only one member has."""
    named = aliases.select("member_id", normalise_name(F.col("alias")).alias("alias")).where("alias <> ''")
    return named.groupBy("alias").agg(F.count_distinct("member_id").alias("n"), F.min("member_id").alias("member_id")).where("n = 1").select("alias", "member_id")


def resolve_exact(names: DataFrame, index: DataFrame) -> DataFrame:
    """names (name) with member_id, null where unknown."""
    return names.withColumn("alias", normalise_name(F.col("name"))).join(index, "alias", "left")


def similar_pairs(names: DataFrame, known: DataFrame, cutoff: float) -> DataFrame:
    """name and alias of every pair of names (name) and known (alias) that can have a similarity of ``cutoff`` or more.

    A similarity of c leaves at most (1 - c) of both texts' characters, say k, out of the common
    blocks. So of k + 1 equal parts of the alias one at least stands whole in the name, k places away at
    most. Aliases are found by their parts and both lengths, an equi-join; no pair of other texts is made.
    """
    share = 1 - cutoff
    slack = lambda a, b: F.floor((a + b) * share + 1e-9).cast("int")
    # the other text is at least so long, as no more than the shorter one can be common
    low, high = (lambda n: F.ceil(n * cutoff / (2 - cutoff) - 1e-9).cast("int")), (lambda n: F.floor(n * (2 - cutoff) / cutoff + 1e-9).cast("int"))
    part = lambda i, n, parts: F.expr(f"{i} * {n} div {parts}").cast("int")
    a = known.select("alias", F.length("alias").alias("la")).where("la > 0")
    a = a.withColumn("lb", F.explode(F.sequence(low(F.col("la")), high(F.col("la"))))).withColumn("k", slack(F.col("la"), F.col("lb")))
    a = a.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumn("at", part("i", "la", "(k + 1)")).withColumn("size", part("(i + 1)", "la", "(k + 1)") - F.col("at"))
    a = a.select("alias", "la", "lb", "i", F.expr("substring(alias, at + 1, size)").alias("piece"))
    b = names.select("name", F.length("name").alias("lb")).where("lb > 0")
    b = b.withColumn("la", F.explode(F.sequence(low(F.col("lb")), high(F.col("lb"))))).withColumn("k", slack(F.col("la"), F.col("lb")))
    b = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumn("at", part("i", "la", "(k + 1)")).withColumn("size", part("(i + 1)", "la", "(k + 1)") - F.col("at"))
    b = b.withColumn("p", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("k")), F.greatest(F.lit(0), F.least(F.col("lb") - F.col("size"), F.col("at") + F.col("k"))))))
    b = b.select("name", "la", "lb", "i", F.expr("substring(name, p + 1, size)").alias("piece")).distinct()
    return a.join(b, ["la", "lb", "i", "piece"]).select("name", "alias").distinct()


def resolve(names: DataFrame, index: DataFrame, cutoff: float = 0.88) -> DataFrame:
    """Exact aliases first; only distinct names that are left are compared by similarity, with the aliases that can have it.

    The similarity is the Ratcliff-Obershelp ratio of a pair, which tasks compute for pairs that the join
    has made; the best pair of a name is an aggregate, and of equal ratios that of the larger alias. Cutoffs come in
    falling order down to ``cutoff``: a pair at or above one of them is made there, so a name that has one has its best
    pair among them, and only names without one go on to the next.
    """
    found = resolve_exact(names, index)
    rest = cut(found.where("member_id is null and alias <> ''").select(F.col("alias").alias("name")).distinct())
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rate(batches):
        from difflib import SequenceMatcher

        for batch in batches:
            ratios = [SequenceMatcher(None, known, name).ratio() for name, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ratios, pa.float64())], names=["name", "alias", "ratio"])

    closest = []
    for step in STEPS:
        least = 1 - (1 - cutoff) * step if step < 1 else cutoff
        # a pair is few bytes and much work, so it is dealt out by number
        pairs = similar_pairs(rest, index.select("alias"), least).repartition(tasks, "name", "alias")
        rated = pairs.mapInArrow(rate, "name string, alias string, ratio double").where(F.col("ratio") >= least)
        closest.append(cut(rated.groupBy("name").agg(F.max(F.struct("ratio", "alias")).alias("b")).select("name", F.col("b.alias").alias("alias"))))
        rest = rest.join(closest[-1], "name", "left_anti")
        if rest.isEmpty():
            break
    best = reduce(DataFrame.unionAll, closest)
    fuzzy = best.join(index, "alias").select(F.col("name").alias("alias"), F.col("member_id").alias("fuzzy_id"))
    return found.join(fuzzy, "alias", "left").withColumn("member_id", F.coalesce("member_id", "fuzzy_id")).drop("fuzzy_id")


def unique_holders(members: DataFrame, offices: DataFrame) -> DataFrame:
    """office and member_id where exactly one member (member_id, role) holds it.

    A role holds an office if it equals it or goes on after it with a dash or comma, so a deputy
    does not hold the office itself.
    """
    role, want = F.lower(F.trim("role")), F.lower(F.col("office"))
    holds = (role == want) | F.startswith(role, F.concat(want, F.lit(" —"))) | F.startswith(role, F.concat(want, F.lit(" -"))) | F.startswith(role, F.concat(want, F.lit(",")))
    held = members.join(bounded(offices), holds)
    return held.groupBy("office").agg(F.count_distinct("member_id").alias("n"), F.min("member_id").alias("member_id")).where("n = 1").select("office", "member_id")


# Portfolio terms and the keyword of the English role, in order of precedence.
PORTFOLIOS = {
    "பொதுப்பணி": "Public Works",
    "நிதி": "Finance",
    "பள்ளிக் கல்வி": "School Education",
    "உயர் கல்வி": "Higher Education",
    "வேளாண்": "Agriculture",
    "மின்சார": "Electricity",
    "போக்குவரத்து": "Transport",
    "தொழில்": "Industries",
    "வருவாய்": "Revenue",
    "சட்டத்துறை": "Law",
    "ஊரக வளர்ச்சி": "Rural Development",
    "கூட்டுறவு": "Co-operation",
    "சுகாதார": "Health",
    "மக்கள் நல்வாழ்வு": "Health",
    "உள்ளாட்சி": "Local Administration",
    "நகராட்சி": "Municipal",
}
# Offices and their Tamil forms, in order of precedence.
OFFICES = {
    "Chief Minister": ["முதலமைச்சர்", "முதல்வர்"],
    "Deputy Chief Minister": ["துணை முதலமைச்சர்", "துணை முதல்வர்"],
    "Speaker": ["சபாநாயகர்", "அவைத்தலைவர்", "பேரவைத் தலைவர்"],
    "Deputy Speaker": ["துணை சபாநாயகர்"],
    "Leader of the Opposition": ["எதிர்க்கட்சித் தலைவர்"],
}


def resolve_office(texts: DataFrame, members: DataFrame, longest_first: bool = True, word_start: bool = False) -> DataFrame:
    """text and member_id of the one holder of the office that a text names, null where none is.

    Portfolios come before offices, each in its order, and a term whose office has several holders is
    passed over. longest_first lets a longer office term hide a shorter one inside it, so "Deputy
    Speaker" is not read as "Speaker"; without it, terms are tried in order alone. With ``word_start`` a term counts only
    where a word begins, so that a short one is not read inside another word.
    """
    spark = texts.sparkSession
    terms = [(i, term, keyword, True) for i, (term, keyword) in enumerate(PORTFOLIOS.items())]
    terms += [(1000 + 10 * i + j, term, office, False) for i, (office, forms) in enumerate(OFFICES.items()) for j, term in enumerate([office, *forms])]
    vocabulary = spark.createDataFrame(terms, "ord int, term string, wanted string, portfolio boolean")
    role = F.lower("role")
    keywords = spark.createDataFrame([(k,) for k in sorted(set(PORTFOLIOS.values()))], "office string")
    ministers = members.where(F.contains(role, F.lit("minister"))).join(F.broadcast(keywords), F.contains(role, F.lower("office")))
    ministers = ministers.groupBy("office").agg(F.count_distinct("member_id").alias("n"), F.min("member_id").alias("member_id")).where("n = 1").select(F.col("office").alias("wanted"), "member_id", F.lit(True).alias("portfolio"))
    offices = unique_holders(members, spark.createDataFrame([(o,) for o in OFFICES], "office string")).select(F.col("office").alias("wanted"), "member_id", F.lit(False).alias("portfolio"))
    there = F.contains(F.lower("text"), F.lower("term"))
    if word_start:
        there = F.rlike(F.lower("text"), F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}])\Q"), F.lower("term"), F.lit(r"\E")))
    named = texts.select("text").distinct().join(F.broadcast(vocabulary), there)
    if longest_first:
        longer = named.select("text", F.col("term").alias("over"), F.col("portfolio").alias("over_portfolio"))
        hidden = named.join(longer, "text").where((F.col("term") != F.col("over")) & ~F.col("portfolio") & ~F.col("over_portfolio") & F.contains(F.lower("over"), F.lower("term"))).select("text", "term").distinct()
        named = named.join(hidden, ["text", "term"], "left_anti")
    held = named.join(ministers.union(offices), ["wanted", "portfolio"]).groupBy("text").agg(F.min_by("member_id", "ord").alias("member_id"))
    return texts.join(held, "text", "left")
