"""The base rules against the plain expressions, and what the bootstrapped patterns add."""

import hashlib
import re

import pytest
from helpers import DOCS, odd_rows, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st

from palaver.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def plain(text):
    spans = [(m.start(), k, m.end()) for k, (kind, rule) in enumerate(RULES.items()) for m in re.finditer(rule, text or "") if valid(kind, m[0])]
    return sorted(spans)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+19 (04\n,é%", max_size=60))
def test_base_rules_equal_the_plain_expressions(text):
    assert pii.base_spans(text)[0] == plain(text)


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "+1" + " " * 300_000, "1." * 150_000, "@" * 100_000):
        spans, refused = pii.base_spans(text)
        list(pii.instances(text, spans, refused))


def card(i):
    body = f"4{i * 7919 % 10**14:014d}"
    return next(body + str(c) for c in range(10) if pii.luhn(body + str(c)))


def corpus():
    """Phones, cards and addresses among words; some run into one another, so that the base rules refuse them."""
    rows = []
    for i in range(120):
        rows.append((100 + i, f"kelo {i % 9}b mora+ phone: +1 ({200 + i}) 555-{1000 + i} tesu, w{i}a", "en", "a", 0))
        rows.append((1000 + i, f"oro card {card(i)} linu", "en", "a", 0))
        rows.append((2000 + i, f"ip 10.{i}.3.4 and user{i}@mail.example.com.", "en", "a", 0))
    for i in range(90):  # numbers as long as cards that are none
        rows.append((3000 + i, f"oro w{i} {card(i)[:-1]}{(int(card(i)[-1]) + 1) % 10} linu", "en", "a", 0))
    rows.append((5000, f"kelo +1 (999) 555-1234 {card(777)} tesu", "en", "b", 0))  # both are refused by the base rules
    rows.append((5001, "kelo phone: 555 0147 29 tesu", "en", "b", 0))  # a form of its own, behind words that stand before phones
    rows.append((5002, "clean: 4111 1111 1111 1112 of 300.1.1.1, 12 and 555 0147 29 and Version 2.0.", "en", "b", 0))
    return rows


@pytest.fixture(scope="module")
def made(spark):
    docs = with_clashes(spark.createDataFrame(corpus() + odd_rows(), DOCS)).repartition(3)
    return pii.find_spans(docs).collect()


def test_base_spans_stay(made):
    texts = {r[0]: r[1] for r in corpus() + odd_rows()}
    assert len(made) == len(corpus() + odd_rows())
    for r in made:
        base = [tuple(s) for s in r.base]
        if r.doc_id in texts and r.doc_id != 2:
            assert base == plain(texts[r.doc_id])
        assert set(base) <= {tuple(s) for s in r.spans}


def test_patterns_find_what_the_rules_refuse(made):
    texts, by = dict((r[0], r[1]) for r in corpus()), {r.doc_id: r for r in made}
    named = lambda i: [(pii.KINDS[k], texts[i][a:b]) for a, k, b in map(tuple, by[i].spans)]
    assert not by[5000].base and named(5000) == [("phone", "+1 (999) 555-1234"), ("card", card(777))]
    assert not by[5001].base and named(5001) == [("phone", "555 0147 29")]


def test_clean_texts_are_left_alone(made):
    for r in made:
        if r.doc_id != 5000 and r.doc_id != 5001:
            assert r.spans == r.base


def test_query_columns(spark, tmp_path):
    spark.createDataFrame(corpus(), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in pii.op12_bootstrapped_pii(spark, str(tmp_path)).collect()}
    for i, text, *_ in corpus():
        spans = plain(text)
        shown = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert rows[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in spans) for n in range(4)]
    assert rows[5000].spans == "phone:5:22,card:23:39"


def test_few_seeds_teach_nothing_and_empty_tables_give_none(spark):
    few = [(1, "tel +1 (999) 555-1234 and", "en", "a", 0), (2, "tel +1 (998) 555-1234 4111 and", "en", "a", 0)]
    assert all(r.spans == r.base for r in pii.find_spans(spark.createDataFrame(few, DOCS)).collect())
    assert pii.find_spans(spark.createDataFrame([], DOCS)).count() == 0


def test_every_stated_result_is_sql():
    from palaver.llm import registry

    assert all(isinstance(x, str) for x in registry.oracle_sql().values()) and set(registry.oracle_sql()) < set(registry.queries())
