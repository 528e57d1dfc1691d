"""Importance resampling against a brute force over Counters, and the trie against plain counting."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from helpers import ALNUM, DOCS, lower, odd_rows, with_clashes

from palaver.llm import resampling as rs


def runs(text, longest):
    w = ALNUM.findall(lower(text))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(rows, items, longest=1, buckets=10_000, least=20, share=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in side for f in runs(x, longest)[1]) for side in ([r[1] for r in rows], items))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out, fit = [], []
    for r in rows:
        n, fs = runs(r[1], longest)
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([r[0], len(fs), weight, score, None])
        if n >= least:
            fit.append(out[-1])
    fit.sort(key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for i, x in enumerate(fit[: share * len(fit) // 100]):
        x[4] = i + 1
    return sorted(map(tuple, out), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows_of(n):
    return [(i, " ".join(f"W{(i * 7 + k * k) % 97}" for k in range(i % 60)) + "!", "en", "a", 0) for i in range(n)]


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 50)])
def test_equals_brute_force(spark, longest, buckets):
    rows, items = rows_of(400) + odd_rows(), ["w1 w2 w3 w4", None, "", "w1 w2"]
    docs = with_clashes(spark.createDataFrame(rows, DOCS)).repartition(6)
    target = spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "item_id string, text string")
    assert found(rs.resample(docs, target, longest, buckets)) == plain(rows, items, longest, buckets)


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id string, text string")
    assert rs.resample(docs, target).count() == 0
    assert found(rs.resample(spark.createDataFrame(rows_of(60), DOCS), target)) == plain(rows_of(60), [])


def test_sample_keeps_its_columns(spark):
    docs = spark.createDataFrame(rows_of(400), DOCS)
    target = spark.createDataFrame([("a", "w1 w2 w3")], "item_id string, text string")
    made = rs.drawn(docs, target)
    assert made.columns == docs.columns
    assert {r.doc_id for r in made.collect()} == {r[0] for r in plain(rows_of(400), ["w1 w2 w3"]) if r[4]}


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_small_tries_and_pieces_change_nothing(monkeypatch, longest):
    texts = [r[1] for r in rows_of(80)] + ["", "a", "x" * 500 + " " + "y z " * 300]
    monkeypatch.setattr(rs, "PIECE", 32)
    monkeypatch.setattr(rs, "TRIE_NODES", 20)
    trie = rs.WordTrie(longest, 97)
    for t in texts:
        trie.count_text(t.encode())
    trie.flush()
    fs = [f for t in texts for f in runs(t, longest)[1]]
    assert {i: n for i, n in enumerate(trie.totals) if n} == Counter(zlib.crc32(f.encode()) % 97 for f in fs)
    import numpy as np

    gains = np.arange(97) - 40
    scored = rs.WordTrie(longest, 97, gains)
    for t in texts:
        n, features = runs(t, longest)
        assert scored.weigh(t.encode()) == (n, sum(zlib.crc32(f.encode()) % 97 - 40 for f in features))
        assert rs.features(n, longest) == len(features)


def test_a_node_takes_up_its_parents_crc():
    trie = rs.WordTrie(3, 10)
    trie.count_text(b"one two three")
    assert sorted(trie.crc) == sorted(zlib.crc32(x) for x in (b"one", b"two", b"three", b"one two", b"two three", b"one two three"))
