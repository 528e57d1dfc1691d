"""The exact operators against brute force, on odd rows and on the smallest tables."""

import hashlib
import os
import random
import re
from pathlib import Path

import numpy as np
import oracle
import pytest
from helpers import ALNUM, DOCS, SPACED, linked, lower, odd_rows, repeats, with_clashes
from pyspark.sql import functions as F

from palaver.llm import chat, decontaminate, jaccard, linededup, mixing, quality, registry, sorting
from palaver.llm import repeats as rp

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    assert oracle.spark_rows(registry.queries()[name](spark, FOLDER)) == oracle.rows_of(registry.oracle_sql()[name], FOLDER)


# -- decontamination


def contaminated(text, items, width=10):
    words, hit, found = ALNUM.findall(lower(text)), set(), set()
    for item, body in items:
        w = ALNUM.findall(lower(body))
        size = min(width, len(w))
        for s in range(len(w) - size + 1) if size else ():
            for i in range(len(words) - size + 1):
                if words[i : i + size] == w[s : s + size]:
                    hit.update(range(i, i + size))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [None, 60])
def test_decontamination(spark, odd, empty, monkeypatch, block):
    if block:
        monkeypatch.setattr(decontaminate, "ITEM_BLOCK_BYTES", block)
    items = [(1, "Three, FOUR five"), (10, "nine ten eleven twelve thirteen"), (2, "four five six seven eight nine ten eleven twelve"), (3, None), (4, "  "), (None, "中文"), (5, "line 7 of many words line 8 of many words line 9 of"), (5, "line 7 of many words line 8 of many words line 9 of")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.report(decontaminate.mark(odd.select("doc_id", "text"), table))
    expected = sorted(((i, *contaminated(t, items)) for i, t, *_ in odd_rows()), key=repr)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected
    kept = decontaminate.clean(with_clashes(odd), table)
    assert kept.columns == with_clashes(odd).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in expected if not r[5]), key=repr)
    assert decontaminate.report(decontaminate.mark(empty.select("doc_id", "text"), table)).count() == 0
    assert decontaminate.clean(odd, table.limit(0)).count() == len(odd_rows())


def test_repeated_items_are_one(spark, monkeypatch):
    """Copies of an item make no block of their own, and a benchmark without words hits nothing."""
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK_BYTES", 400)
    passes = []
    whole = decontaminate.scan
    monkeypatch.setattr(decontaminate, "scan", lambda docs, index: passes.append(len(index.ids)) or whole(docs, index))
    items = spark.createDataFrame([(1, "one two three four five six")] * 300 + [(2, "other words of an item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero one two three four five six"), (2, "nothing")], "doc_id long, text string")
    found = decontaminate.report(decontaminate.mark(docs, items)).collect()
    assert sorted((r.doc_id, r.n_hit, r.n_items) for r in found) == [(1, 6, 1), (2, 0, 0)] and sum(passes) == 2
    assert [r.n_hit for r in decontaminate.report(decontaminate.mark(docs, items.select("item_id", F.lit(" ").alias("text")))).collect()] == [0, 0]


# -- line dedup


def test_lines_of_many_sites(spark, odd, empty):
    rows = [(10 + i, f"own {i}\n same line \nrare {i % 2}\n\nsame line", "en", f"s{i}", 1) for i in range(6)] + [(30, "same line", None, None, 1)]
    docs = odd.union(spark.createDataFrame(rows, DOCS))
    found = {r.doc_id: r for r in linededup.dedup_lines(with_clashes(docs), 5).collect()}
    assert found[10].text == "own 0\n same line \nrare 0\n"  # the first copy stays, with its spaces
    assert [found[10 + i].text for i in (1, 5)] == ["own 1\nrare 1\n", "own 5\nrare 1\n"]
    assert found[30].text == "" and found[30].lines_removed == 1
    assert [found[i].text for i, t, *_ in odd_rows()] == [t for _, t, *_ in odd_rows()]
    assert found[4].line_count == 0 and found[3].line_count == 1
    assert linededup.dedup_lines(empty).count() == 0


def test_hll_and_exact_counts_agree_at_the_threshold(spark):
    rows = [(s * 10 + k, f"line of {k}", "en", f"s{s}", 1) for k in (7, 8, 9) for s in range(k)]
    docs = spark.createDataFrame(rows, DOCS)
    gone = sorted(r.doc_id for r in linededup.dedup_lines(docs).where("lines_removed > 0").collect())
    assert gone == sorted(s * 10 + k for k in (8, 9) for s in range(1, k))


def test_sketches_decide_far_from_the_threshold(spark, monkeypatch):
    """Without any exact count, lines of very many sites go all the same, and those near the threshold stay."""
    none = lambda lines, near, min_sites: near.limit(0)
    monkeypatch.setattr(linededup, "exact_spread", none)
    rows = [(s * 10 + k, f"line of {n}", "en", f"s{s}", 1) for k, n in enumerate((9, 90)) for s in range(n)]
    gone = [r for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).where("lines_removed > 0").collect()]
    assert len(gone) == 89 and {r.doc_id % 10 for r in gone} == {1}


def test_no_table_of_lines_and_sites_is_made(spark, monkeypatch):
    """A wrong estimate shows: with very small sketches and no margin the estimate alone decides."""
    monkeypatch.setattr(linededup, "LG_K", 4)
    monkeypatch.setattr(linededup, "SIGMAS", 0.0)
    monkeypatch.setattr(linededup, "exact_spread", lambda lines, near, min_sites: near.limit(0))
    rows = [(s, "same line", "en", f"s{s}", 1) for s in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    estimate = docs.agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", F.lit(4))).alias("n")).first().n
    assert estimate != 400
    assert linededup.boilerplate(docs, estimate - 2).count() == 1 and linededup.boilerplate(docs, estimate + 3).count() == 0


# -- near duplicates


def near_copies(rng, groups, size):
    rows, i = [], 1000
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 160))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            rows.append((i, " ".join(w)))
            i += 1
    return rows


@pytest.mark.parametrize(("width", "p", "chunk"), [(4, 85, 1024), (5, 80, 3)])
def test_components(spark, odd, empty, monkeypatch, width, p, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = near_copies(random.Random(width), 12, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(odd.select("doc_id", "text"))
    expected = linked([*rows, *{(r[0], r[1]) for r in odd_rows() if r[0] is not None}], width, p, 100)
    found = jaccard.link_components(spark, with_clashes(docs), width, p, 100).collect()
    assert len(found) == len(rows) + len(odd_rows())
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None and expected[r.doc_id] != (r.n_shingles, r.component_id)] == []
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    assert jaccard.link_components(spark, empty).count() == 0


def test_blocks_never_lose_a_pair():
    """Linked sets of every size share a shipped block."""
    rng = np.random.default_rng(1)
    for n in [*range(1, 80), 200, 900]:
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        gone = int(0.15 * len(a))  # as many taken away as the bound allows
        b = a[gone:]
        if 100 * len(b) >= 85 * len(a):
            assert len(np.intersect1d(jaccard.signatures(a, 85, 100), jaccard.signatures(b, 85, 100)))


def test_ids_with_two_texts_and_one_of_each(spark, odd, empty):
    """Rows of one id are judged by their own texts; of a group one row stays, repeated rows included."""
    word = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    rows = [(7, word("a")), (7, word("b")), (8, word("a") + " end"), (9, word("b") + " end"), (9, word("b") + " end"), (3, word("c")), (3, word("c")), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.link_components(spark, docs, 5, 80, 100).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(3, 3), (3, 3), (7, 7), (7, 7), (8, 7), (9, 7), (9, 7), (12, 12)]
    kept = jaccard.one_of_each(with_clashes(docs), 5, 80, 100)
    assert kept.columns == with_clashes(docs).columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(7, word("a")), (7, word("b")), (3, word("c")), (12, "")])
    assert sorted((r.doc_id or 0) for r in jaccard.one_of_each(odd).collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    assert jaccard.one_of_each(empty).count() == 0


@pytest.mark.parametrize("few", [20_000, 0])
def test_links_merge_the_same_in_one_task_and_in_steps(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW_LINKS", few)
    rng = random.Random(40)
    links = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)]
    root = {i: i for link in links for i in link}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = {r.id: r.root for r in jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: find(i) for i in root if find(i) != i}
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_unrelated_sets_are_out_before_verification(spark):
    """Long texts with many shared passages give no pair for verification; the sketch grows with the set."""
    rng = random.Random(31)
    passages = [" ".join(f"p{k}.{i}" for i in range(60)) for k in range(40)]
    body = lambda: " ".join(rng.choice(passages) if rng.random() < 0.02 else f"u{rng.randrange(10**9)}" for _ in range(20_000))
    docs = spark.createDataFrame([(i, body()) for i in range(6)], "doc_id long, text string")
    rows = jaccard.describe(docs, 5, 80, 100)
    sets = rows.select("hi", "sid", "n_shingles", "need0", "need1", "bits", "doc_id", "th")
    pairs = spark.createDataFrame([(a.sid, b.sid) for a in sets.collect() for b in sets.collect() if a.sid < b.sid], "a long, b long")
    assert jaccard.near(pairs, sets, 80, 100).count() == 0
    assert jaccard.live_rows(jaccard.block_rows(docs, 5, 80, 100), sets).count() == 0


def test_hot_blocks_are_dealt_out(spark, monkeypatch):
    """A group of copies beyond HOT, in several batches, is one component."""
    monkeypatch.setattr(jaccard, "HOT", 3)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w if k != i % 200 else f"x{i}" for k, w in enumerate(base))) for i in range(150)] + [(900 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(190))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = {r.doc_id: r.component_id for r in jaccard.link_components(spark, docs, 5, 80, 100).collect()}
    assert found == {i: (0 if i < 900 else i) for i, _ in rows}


# -- mixing


def test_targets_and_seats():
    assert mixing.targets([100, 100, 100]) == [200.0, 150.0, 100.0] or sum(mixing.targets([100, 100, 100])) == pytest.approx(450)
    for sizes in ([10, 1000, 5, 0], [7], [0, 0], []):
        found = mixing.targets(sizes)
        assert sum(found) == pytest.approx(1.5 * sum(sizes))
        assert all(t <= 2 * s + 1e-9 for t, s in zip(found, sizes, strict=True))
    rng = random.Random(5)
    for _ in range(60):
        votes = [rng.choice([0, 3, 3, 10.5, 200]) for _ in range(rng.randrange(1, 7))]
        seats, given = rng.randrange(0, 50), None
        given = [0] * len(votes)
        for _ in range(seats if any(votes) else 0):
            k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * given[i] + 1), -i))
            given[k] += 1
        assert mixing.sainte_lague(np.array(votes, float), seats).tolist() == given


def test_mix(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 2000)
    rng = random.Random(2)
    rows = [(100 + i, " ".join(["w"] * rng.randrange(1, 200)), "en", rng.choice(["p", "q", "r", "é", None]), 1) for i in range(400)]
    docs = odd.union(spark.createDataFrame(rows, DOCS))
    found = mixing.mix_sources(with_clashes(docs)).collect()
    assert len(found) == len(rows) + len(odd_rows())
    assert all(r.mix_size == len(SPACED.findall(r.text or "")) and 0 <= r.mix_taken <= 2 * r.mix_size for r in found)
    sizes = {}
    for r in found:
        sizes.setdefault(r.source, []).append(r)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    aims = mixing.targets([sum(r.mix_size for r in sizes[s]) for s in order])
    for s, aim in zip(order, aims, strict=True):
        assert {r.mix_source_size for r in sizes[s]} == {sum(r.mix_size for r in sizes[s])}
        assert [r.mix_target for r in sizes[s]] == pytest.approx([aim] * len(sizes[s]))
        assert abs(sum(r.mix_taken for r in sizes[s]) - aim) <= 0.02 * aim + 2 * mixing.BLOCK * 20
    again = mixing.mix_sources(with_clashes(docs)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    assert mixing.mix_sources(empty).count() == 0


# -- quality


def base_counts(text):
    text = text or ""
    w = SPACED.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {g for g in grams if grams.count(g) > 1} if len(grams) < 500 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts_and_posterior(spark, odd, empty):
    good, bad = " ".join(f"word{i}" for i in range(80)), " ".join(f"W#%{i}!!" for i in range(80))
    extra = [(40 + i, good + f" tail{i}\nsecond line {i}", "en", "a", 1) for i in range(30)] + [(80 + i, bad + f" !#{i}", "en", "a", 1) for i in range(6)]
    found = quality.judge(with_clashes(odd.union(spark.createDataFrame(extra, DOCS)))).collect()
    texts = {r[0]: r[1] for r in [*odd_rows(), *extra]}
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(texts[r.doc_id]), r.doc_id
    kept = {r.doc_id: r.kept for r in found}
    assert all(kept[40 + i] for i in range(30)) and not any(kept[80 + i] for i in range(6))
    assert quality.judge(empty).count() == 0


def test_em_finds_the_weak_rule():
    """Two rules that agree with the truth and one that guesses."""
    rng, counts = random.Random(4), {}
    for _ in range(4000):
        y = 1 if rng.random() < 0.7 else -1
        v = tuple(y if rng.random() < a else -y for a in (0.95, 0.9, 0.55))
        counts[v] = counts.get(v, 0) + 1
    _, weights = quality.fit(sorted(counts.items()))
    assert [round(up - down) for up, down in weights][0] >= 4 and weights[1][0] - weights[1][1] > 3 and weights[2][0] - weights[2][1] < 1


# -- exact substrings


def test_deep_shallow_order():
    rng = random.Random(8)
    for _ in range(120):
        letters = rng.choice([b"ab", b"a", bytes(range(256)), b"\0a"])
        base = [bytes(rng.choices(letters, k=rng.randrange(60))) for _ in range(4)]
        strings = [rng.choice(base) + bytes(rng.choices(letters, k=rng.randrange(8))) for _ in range(50)]
        order, lcp = sorting.deep_shallow(strings)
        ranked = [strings[i] for i in order]
        assert sorted(order.tolist()) == list(range(50)) and ranked == sorted(strings)
        assert [len(os.path.commonprefix(x)) for x in zip(ranked, ranked[1:], strict=False)] == lcp[1:].tolist()


def test_only_groups_of_three_different_strings_get_a_trie(monkeypatch):
    """Pairs and equal strings are ordered without one; order and common prefixes are those of a plain sort."""
    rng, made = np.random.default_rng(4), []
    monkeypatch.setattr(sorting.BlindTrie, "__init__", lambda self, strings, f=sorting.BlindTrie.__init__: (made.append(1), f(self, strings))[1])
    strings = []
    for k in range(300):
        head = k.to_bytes(8, "big") + b"x" * 30
        strings += [head + bytes(rng.integers(97, 99, 6).tolist())] * int(rng.integers(1, 6)) + [head] * int(k % 2)
    strings += [b"\0" * 40 + t for t in (b"a", b"b", b"", b"b", b"\0")] + [b"\0\0", b"\0", b""]
    order, lcp = sorting.deep_shallow(strings)
    assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
    assert lcp[0] == 0 and all(n == len(os.path.commonprefix([strings[i], strings[j]])) for n, i, j in zip(lcp[1:], order, order[1:]))
    assert len(made) == 1


@pytest.mark.parametrize("piece", [1 << 16, 700])
def test_anchors_of_a_block_are_those_of_its_texts(monkeypatch, piece):
    """Texts of a block are looked at together, and each has the anchors and hashes that it has alone."""
    monkeypatch.setattr(rp, "PIECE", piece)
    rng = np.random.default_rng(6)
    texts = [rng.integers(97, 101, n, dtype=np.uint8) for n in (0, 399, 400, 401, 3000, 5, 1200, 0)] + [np.full(900, 97, np.uint8)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    wanted = np.array([True] * 6 + [False] + [True] * 2)
    text, place, core, whole, left, right = rp.anchors(np.concatenate(texts), bounds, wanted, rp.BYTES)
    for k, t in enumerate(texts):
        at = place[text == k]
        assert all(any(i <= p <= i + 200 for p in at) for i in range(len(t) - 399)) == (bool(wanted[k]) or len(t) < 400)
        alone = rp.anchors(t, np.array([0, len(t)]), np.array([wanted[k]]), rp.BYTES)
        assert all((x[text == k] == y).all() for x, y in zip((place, core, whole, left, right), alone[1:], strict=True))
        assert (np.diff(at) > 0).all() and (left[text == k] == np.minimum(at, 200)).all() and (right[text == k] == np.minimum(len(t) - at - 200, 200)).all()


@pytest.mark.parametrize("most", [20_000, 3])
def test_repeats(spark, odd, empty, monkeypatch, most):
    monkeypatch.setattr(rp, "GROUP_ROWS", most)
    monkeypatch.setattr(rp, "SORT_ROWS", 50)
    rng = random.Random(most)
    text = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    shared = [text(n) for n in (330, 400, 520, 1500)]
    rows = [(100 + i, text(rng.randrange(300)) + rng.choice(shared) + text(rng.randrange(250)) + rng.choice(shared)) for i in range(30)]
    rows += [(200, "ab" * 700), (201, "x" * 399), (202, "x" * 401), (203, rows[0][1]), (204, shared[2][:430] + "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(odd.select("doc_id", "text"))
    raw = [((t or "").encode(), i) for i, t in [*rows, *[(r[0], r[1]) for r in odd_rows()]]]
    expected = []
    for cover, (t, i) in zip(repeats([t for t, _ in raw], 400), raw, strict=True):
        kept = bytes(b for b, c in zip(t, cover, strict=True) if not c)
        expected.append((i, len(t), len(t) - len(kept), len(re.findall(rb"\x01+", cover)), hashlib.sha256(kept).hexdigest()))
    found = rp.remove_repeats(with_clashes(docs)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(expected, key=repr)
    assert rp.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("most", [20_000, 4])
def test_passages_of_over_fifty_words(spark, odd, monkeypatch, most):
    """Words in passages of 51 words or more that occur again, against brute force; shorter ones and short-worded bytes do not count."""
    monkeypatch.setattr(rp, "GROUP_ROWS", most)
    rng = random.Random(most)
    words = lambda n: " ".join(rng.choice(["a", "to", "the", "seventeen", "é"]) + str(rng.randrange(300)) for _ in range(n))
    shared = [words(n) for n in (50, 51, 60, 140)]
    rows = [(100 + i, words(rng.randrange(70)) + rng.choice([" ", "\n"]) + rng.choice(shared) + " " + words(rng.randrange(70)) + " " + rng.choice(shared)) for i in range(24)]
    rows += [(200, words(80)), (201, shared[1]), (202, shared[0]), (203, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(odd.select("doc_id", "text"))
    every = [*rows, *[(r[0], r[1]) for r in odd_rows()]]
    split = [tuple((t or "").split()) for _, t in every]
    expected = sorted(((i, sum(c)) for (i, _), c in zip(every, repeats(split, 51), strict=True)), key=repr)
    found = rp.remove_repeats(docs).select("doc_id", "n_passage_words").collect()
    assert sorted(((r.doc_id, r.n_passage_words) for r in found), key=repr) == expected


def test_a_passage_in_very_many_neighbourhoods(spark, monkeypatch):
    """One core in thousands of different neighbourhoods, dealt out, split by content, and never sorted in one task."""
    monkeypatch.setattr(rp, "GROUP_ROWS", 40)
    monkeypatch.setattr(rp, "HOT", 2)
    rng = random.Random(77)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = text(460)
    rows = [(i, text(rng.randrange(300)) + passage + text(rng.randrange(300))) for i in range(3000)]
    rows += [(5000 + i, text(250) + passage[i : i + 399] + text(250)) for i in range(60)]
    found = rp.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    by = {r.doc_id: r for r in found}
    for i, t in rows:
        at = t.find(passage)
        if at >= 0:
            # a few bytes beside the passage agree by chance with some other row
            assert 460 <= by[i].n_removed <= 460 + 2 * 8 and by[i].n_spans == 1, (i, by[i].n_removed)
            assert bytes(by[i].kept)[: max(0, at - 8)] == t.encode()[: max(0, at - 8)]
        else:
            assert by[i].n_removed == 0 or by[i].n_removed >= 400
    assert len(found) == len(rows)


# -- chat


def test_snapshots_collapse(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", None), (None, "bye<|im_end|>")]
    rows = [(c, t, *turns[t], 0) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1), (5, 3)) for t in range(n)] + [(6, 0, "user", "other", 0), (None, None, "user", "alone", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    found = {r.conv_id: r for r in chat.render(df).collect()}
    assert sorted(found, key=repr) == [2, 6, None]
    assert (found[2].n_turns, found[2].n_copies) == (4, 2)
    assert found[2].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>unknown\nbye<| im_end|><|im_end|>\n"
    assert chat.render(df.limit(0)).count() == 0


def test_tied_turns_and_long_conversations(spark):
    """Turns of one number follow role and text; a conversation of thousands of turns is one text; clashing columns do not matter."""
    rows = [(1, 0, "user", "b", "x", 1), (1, 0, "assistant", "a", "x", 1), (1, 0, "user", "a", "x", 1), (2, 0, "assistant", "a", "y", 1)]
    rows += [(3, t, "user", f"turn {t}", "z", 1) for t in range(5000)] + [(4, t, "user", f"turn {t}", "z", 1) for t in range(4999)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, _id string, copies int")
    found = {r.conv_id: r for r in chat.render(df).collect()}
    assert sorted(found) == [1, 3] and found[3].n_turns == 5000 and found[3].rendered.count("turn ") == 5000
    assert found[1].rendered == "<|im_start|>assistant\na<|im_end|>\n<|im_start|>user\na<|im_end|>\n<|im_start|>user\nb<|im_end|>\n"
    assert chat.op10_snapshot_collapse_chat.__doc__
