"""Quality rules combined by weak supervision, in place of a filter that all of them must pass.

Each rule looks at counts of the whole text and votes good (1), bad (-1) or abstains (0). The rules'
accuracies are not given: expectation-maximisation estimates two for each rule, how often it is right
on good texts and on bad ones where it votes, and the share of good texts, from how the votes agree
over all documents. A rule that passes nearly everything so weighs little when it passes and much
when it does not. A text is kept if the posterior probability that it is good is KEEP or more and
the two base rules do not fail.

The counts are made natively, per row: no shuffle, and no Python on the executors. The only thing
that leaves them is the number of rows with each pattern of votes, of which there are at most
3 ** len(RULES). EM runs on that table in a few milliseconds and its result is a column expression.

Null, empty and word-less texts have zero words, so base_failed holds and they are not kept. The
input's other columns play no part. Repeated rows give repeated rows; an empty table gives none.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.session import cut

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORD = "[^\\x20\\x09-\\x0D]+"
KEEP = 0.5
#: Priors of the share of good texts and of a rule's accuracy on good and on bad ones, and their weight in votes.
PRIOR_GOOD, PRIOR_ON_GOOD, PRIOR_ON_BAD, PRIOR_WEIGHT = 0.85, 0.97, 0.35, 10.0
EM_ROUNDS = 50


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each text that the rules look at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    base = docs.select(
        "doc_id",
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        (F.length(text) - F.length(F.translate(text, "!?", ""))).cast("long").alias("_cries"),
        (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("long").alias("_capitals"),
        (F.length(text) - F.length(F.translate(text, PUNCTUATION, ""))).cast("long").alias("_marks"),
    )
    # explode of a one-element array keeps the arrays columns of their own, so that lambdas read them as they are
    base = base.select("*", F.explode(F.array("_w")).alias("_words")).drop("_w")
    n = F.size("_words")
    runs = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")))
    base = base.select("*", F.explode(F.array(F.when(n >= 3, F.sort_array(runs)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))).alias("_runs"))
    same = lambda j, i: F.coalesce(F.get("_runs", j)["h"] == F.get("_runs", i)["h"], F.lit(False))
    twice = F.filter(F.transform("_runs", lambda r, k: F.when(same(k - 1, k) | same(k + 1, k), r["i"])), lambda i: i.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))
    return base.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("_lines"),
        "_cries",
        "_capitals",
        "_marks",
        F.size(F.array_distinct("_words")).cast("long").alias("_kinds"),
    )


def vote(good: Column, bad: Column) -> Column:
    """1 where good holds, else -1 where bad holds, else 0."""
    return F.when(good, 1).when(bad, -1).otherwise(0)


def rules() -> dict[str, Column]:
    """The rules' votes over the columns of counts()."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols": vote(F.col("n_symbols") * 100 <= words, F.col("n_symbols") * 10 >= words),
        "dup_lines": vote((F.col("n_dup_lines") == 0) & (F.col("_lines") >= 2), F.col("n_dup_lines") * 10 >= F.col("_lines") * 3),
        "word_length": vote((chars >= 3 * words) & (chars <= 12 * words), (chars < 2 * words) | (chars > 20 * words)),
        "repeats": vote(F.col("n_repeat_words") * 20 <= words, F.col("n_repeat_words") * 4 >= words),
        "marks": vote(F.col("_marks") * 16 <= chars, F.col("_marks") * 10 >= chars),
        "kinds": vote(F.col("_kinds") * 4 >= words, F.col("_kinds") * 8 <= words),
        "cries": vote(F.col("_cries") * 50 <= words, F.col("_cries") * 5 >= words),
        "capitals": vote(F.col("_capitals") * 5 <= chars, F.col("_capitals") * 2 >= chars),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[tuple[float, float]]]:
    """Prior log-odds of a good text and, for each rule, what a good and a bad vote add to them,
    from counted vote patterns."""
    n_rules = len(patterns[0][0]) if patterns else 0
    good, on_good, on_bad = PRIOR_GOOD, [PRIOR_ON_GOOD] * n_rules, [PRIOR_ON_BAD] * n_rules
    for _ in range(EM_ROUNDS):
        prior, weights = log(good / (1 - good)), vote_weights(on_good, on_bad)
        total = likely = 0.0
        right = {1: [PRIOR_ON_GOOD * PRIOR_WEIGHT] * n_rules, -1: [PRIOR_ON_BAD * PRIOR_WEIGHT] * n_rules}
        cast = {1: [PRIOR_WEIGHT] * n_rules, -1: [PRIOR_WEIGHT] * n_rules}
        for votes, n in patterns:
            z = prior + sum(w[0] if v > 0 else w[1] for v, w in zip(votes, weights, strict=True) if v)
            p = 1 / (1 + exp(-max(-60.0, min(60.0, z))))
            total, likely = total + n, likely + n * p
            for j, v in enumerate(votes):
                if v:
                    cast[1][j] += n * p
                    cast[-1][j] += n * (1 - p)
                    right[v][j] += n * (p if v > 0 else 1 - p)
        good = min(0.98, max(0.5, (likely + PRIOR_GOOD * PRIOR_WEIGHT) / (total + PRIOR_WEIGHT)))
        on_good = [min(0.999, max(0.5, a / c)) for a, c in zip(right[1], cast[1], strict=True)]
        # a rule is never taken to be worse than a guess: that would turn its meaning round
        on_bad = [min(0.999, max(1 - g, b / c)) for g, b, c in zip(on_good, right[-1], cast[-1], strict=True)]
    return log(good / (1 - good)), vote_weights(on_good, on_bad)


def vote_weights(on_good: list[float], on_bad: list[float]) -> list[tuple[float, float]]:
    return [(log(g / (1 - b)), log((1 - g) / b)) for g, b in zip(on_good, on_bad, strict=True)]


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the posterior for every row of docs (doc_id, text)."""
    voted = cut(counts(docs.select("doc_id", "text")).select("*", *[v.cast("int").alias(f"vote_{k}") for k, v in rules().items()]))
    names = [f"vote_{k}" for k in rules()]
    rows = voted.groupBy(*names).count().collect()  # at most 3 ** len(names)
    prior, weights = fit(sorted((tuple(r[:-1]), r[-1]) for r in rows))
    z = F.lit(prior)
    for name, (up, down) in zip(names, weights, strict=False):
        z = z + F.when(F.col(name) > 0, up).when(F.col(name) < 0, down).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    posterior = 1 / (1 + F.exp(-z))
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (posterior >= KEEP)).alias("kept"), posterior.alias("posterior"), *names)


def op7_weak_supervision_quality(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior and votes of all documents.

    Null and empty texts have no words and fail; a very long text is counted whole, in its row's own arrays; repeated
    rows are judged alike; an empty table gives no rows.
    """
    return judge(spark.read.parquet(f"{folder}/documents.parquet"))
