"""Brute-force statements of the operators' results, and the odd rows that every operator meets."""

import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_rows():
    """Nulls in every column, empty and blank texts, one long text, ties, repeated rows."""
    body = "one two three four five six seven eight nine ten eleven twelve"
    return [
        (1, body, "en", "a", 60),
        (2, body, "en", "b", 60),
        (2, body, "en", "b", 60),
        (3, "", "de", None, 0),
        (4, None, None, "a", None),
        (5, " \n\t ", None, None, 3),
        (6, "\n".join(f"line {i} of many words" for i in range(3000)), "fr", "c", None),
        (7, "1234 !!", "de", "b", 7),
        (8, "ÄÖ ü āĀ 中文 text", "de", "c", 9),
        (None, body, "en", "a", 60),
    ]


def with_clashes(df):
    """The same rows with columns named as the operators' own."""
    from pyspark.sql import functions as F

    names = ["n_words", "score", "key", "size", "taken", "_drop", "_words", "spans", "id", "component_id", "a.b"]
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def shingles(text, width):
    w = SPACED.findall(lower(text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def linked(rows, width, p, q):
    """Smallest reachable id of every id, by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in where[g] if j > i).items():
            if q * n >= p * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(texts, length):
    """Per text: the bytes that a repeated string of this length covers."""
    where = defaultdict(list)
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            where[t[i : i + length]].append((k, i))
    covered = [bytearray(len(t)) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for k, i in places:
                covered[k][i : i + length] = b"\x01" * length
    return covered
