"""Sets of segments as bitmaps: mergeable words of bits, turned into lists of ids only where they leave the engine.

A segment's ordinal is the number in its id. A set is one row for each word of WORD ordinals that it
touches, (word, bits), built by the bitwise aggregates with map-side combine, or those words in one
sorted array, which is a sixtieth of the set's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ordinals of a word: fewer than a long has bits, so that no shift reaches the sign.
WORD = 60


def ordinal_of(segment_id: Column) -> Column:
    """The number in a segment's id (S001); null where there is none."""
    return F.regexp_extract(segment_id, r"^S(\d{1,18})$", 1).try_cast("long")


def segment_name(ordinal: Column) -> Column:
    digits = ordinal.cast("string")
    return F.concat(F.lit("S"), F.when(ordinal < 1000, F.lpad(digits, 3, "0")).otherwise(digits))


def word_of(ordinal: Column) -> Column:
    return F.floor(ordinal / WORD).cast("long")


def bit_of(ordinal: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(ordinal, F.lit(WORD)).cast("int"))


def merged(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """by, word, bits and further aggregates of rows (by, ordinal); a null ordinal is in no set."""
    return rows.groupBy(*[F.col(c) for c in by], word_of(F.col("ordinal")).alias("word")).agg(F.bit_or(bit_of(F.col("ordinal"))).alias("bits"), *more)


def packed() -> Column:
    """Aggregate of rows (word, bits) of one set: its words in order."""
    return F.array_sort(F.collect_list(F.when(F.col("bits").isNotNull(), F.struct("word", "bits"))))


def size_of(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w["bits"]))


def lowest(word: Column, bits: Column) -> Column:
    """The smallest ordinal of a word that is not empty."""
    return word * WORD + F.bit_count(bits.bitwiseAND(-bits) - 1)


def first_of(words: Column) -> Column:
    """The smallest ordinal of a set; null for the empty one."""
    w = F.get(words, F.lit(0))
    return lowest(w["word"], w["bits"])


def ordinals(words: Column, most: int | None = None) -> Column:
    """The ordinals of a set in order, or the first ``most`` of them, for which no more words are read."""
    some = words if most is None else F.slice(words, 1, most)
    places = F.sequence(F.lit(0), F.lit(WORD - 1))
    listed = F.flatten(F.transform(some, lambda w: F.transform(F.filter(places, lambda i: F.getbit(w["bits"], i) == 1), lambda i: w["word"] * WORD + i)))
    return listed if most is None else F.slice(listed, 1, most)


def segment_names(words: Column, most: int | None = None) -> Column:
    return F.transform(ordinals(words, most), segment_name)
