"""Column expressions over transcript text: tokens, names, numbers, citations, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words and what they are worth.
TAMIL_NUMBER_WORDS = {"நூறு": 100, "ஆயிரம்": 1000, "லட்சம்": 100_000, "இலட்சம்": 100_000, "கோடி": 10_000_000}
ENGLISH_NUMBER_WORDS = {"hundred": 100, "thousand": 1000, "lakh": 100_000, "crore": 10_000_000, "million": 1_000_000, "billion": 1_000_000_000}
# Honorifics that carry no identity.
HONORIFICS = ("DR", "THIRU", "TMT", "SELVI", "MR", "MRS", "MS")


def tokenize(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, or of Tamil code points."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+|[\\u0B80-\\u0BFF]+"), F.lit(0))


def normalise_name(name: Column) -> Column:
    """Upper case without honorifics, dots and zero-width characters, single spaces."""
    bare = F.regexp_replace(F.upper(name), "(?U)\\b(" + "|".join(HONORIFICS) + ")\\b\\.?", " ")
    bare = F.regexp_replace(bare, "[.\\u200B\\u200C\\u200D]", " ")
    return F.trim(F.regexp_replace(bare, "\\s+", " "))


def digit_tokens(text: Column) -> Column:
    """Sorted runs of digits of any script, without separators."""
    found = F.regexp_extract_all(text, F.lit("(?U)\\d[\\d,.]*"), F.lit(0))
    return F.array_sort(F.transform(found, lambda t: F.rtrim(F.replace(t, F.lit(",")), F.lit("."))))


def scale_words(text: Column, vocabulary: dict[str, int]) -> Column:
    """Sorted worths of the number words in a text.

    English words are matched whole and in the plural; Tamil ones as substrings, the longest spelling
    first, so a spelling inside another counts once.
    """
    parts = []
    for word, worth in vocabulary.items():
        if word.isascii():
            count = F.regexp_count(text, F.lit(f"(?i)\\b{word}s?\\b"))
        else:
            longer = [w for w in vocabulary if w != word and word in w]
            count = F.regexp_count(text, F.lit(word))
            for w in longer:
                count = count - F.regexp_count(text, F.lit(w))
        parts.append(F.array_repeat(F.lit(worth).cast("long"), count))
    return F.array_sort(F.concat(*parts))


def numeric_guard(source: Column, target: Column, source_words: dict = TAMIL_NUMBER_WORDS, target_words: dict = ENGLISH_NUMBER_WORDS) -> Column:
    """Kinds of numeric mismatch between two versions of a text: digits, scale."""
    digits = F.when(digit_tokens(source) != digit_tokens(target), F.lit("digits"))
    named = scale_words(source, source_words)
    scale = F.when((F.size(named) > 0) & (named != scale_words(target, target_words)), F.lit("scale"))
    return F.array_compact(F.array(digits, scale))


def citations(text: Column) -> Column:
    """Segment ids cited in brackets, in order, repeats included; ids may have more than three digits."""
    groups = F.regexp_extract_all(text, F.lit("\\[[^\\[\\]]*S\\d{3}[^\\[\\]]*\\]"), F.lit(0))
    return F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit("S\\d{3,}"), F.lit(0))))


def node_key(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.lower(F.trim(name)))


def relation_type(predicate: Column) -> Column:
    """An upper-case identifier; RELATED_TO where nothing is left."""
    bare = F.regexp_replace(F.upper(F.trim(predicate)), "[^A-Za-z0-9]+", "_")
    bare = F.trim(bare, F.lit("_"))
    return F.when(bare == "", "RELATED_TO").otherwise(bare)


def preview(text: Column, limit: int = 90) -> Column:
    """White space collapsed, cut at a limit with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit), F.lit("…")))


def strip_fence(body: Column) -> Column:
    """A model's response without a Markdown code fence around it."""
    return F.trim(F.regexp_replace(F.trim(body), "(?s)^```[A-Za-z]*\\s*|\\s*```$", ""))


def canonical_text(text: Column, limit: int = 4096) -> Column:
    """Long strings are replaced by their own hash before a request is hashed."""
    return F.when(F.length(text) > limit, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)


def request_key(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON of a request: sorted keys, no spaces."""
    ordered = F.struct(*[canonical_text(fields[k]).alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def has_tamil(text: Column) -> Column:
    """Whether a text has a code point of the Tamil block."""
    return F.rlike(text, F.lit("[\\u0B80-\\u0BFF]"))


def chunk_prefix(voice: Column) -> Column:
    """The chunk of a local voice label (chunk:voice)."""
    return F.substring_index(voice, ":", 1)


def namespace(name: Column) -> Column:
    """A name that is safe as a folder: runs of other characters become one underscore."""
    return F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_")


def redact(text: Column, secret: str) -> Column:
    """The text without a secret; an empty secret hides nothing."""
    return F.replace(text, F.lit(secret), F.lit("***")) if secret else text


def frame_name(t: Column) -> Column:
    """The file of the frame at t seconds: tenths of a second in six digits."""
    return F.format_string("frame_%06d.jpg", F.bround(t * 10).cast("long"))


def midpoint(start: Column, end: Column) -> Column:
    return (start + end) / 2


def merged_map(base: Column, over: Column) -> Column:
    """Both maps' entries; where both have a key the second one's."""
    only = F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k))
    return F.map_concat(only, over)


def eta(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds that are left at the rate so far; null before anything is done."""
    return F.when(done > 0, F.round((total - done) * elapsed / done, 1))
