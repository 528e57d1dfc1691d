"""Text functions, attribution, retrieval, graph and answer operators on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from palaver.functions import text as tx
from palaver.operators import answer as an
from palaver.operators import attribution as at
from palaver.operators import graph as gr
from palaver.operators import provenance as pv
from palaver.operators import retrieval as rt
from palaver.operators import roster as rs


def value(spark, expression):
    return spark.range(1).select(expression).first()[0]


@pytest.mark.parametrize(
    ("text", "ids"),
    [("a [S001, S002] b S003 [S001]", ["S001", "S002", "S001"]), ("[S1000]", ["S1000"]), ("[x] S001", []), ("", [])],
)
def test_citations(spark, text, ids):
    assert value(spark, tx.citations(F.lit(text))) == ids


def test_numeric_guard(spark):
    guard = lambda a, b: value(spark, tx.numeric_guard(F.lit(a), F.lit(b)))
    assert guard("1,000 x", "1000 x") == []
    assert guard("1 ஆயிரம் கோடி", "1 lakh crore") == ["scale"]
    assert guard("இலட்சம்", "one lakh") == []
    assert guard("௧௨", "12") == ["digits"]


def test_names_keys_and_fences(spark):
    assert value(spark, tx.normalise_name(F.lit("Dr. m.k​  Name"))) == "M K NAME"
    assert value(spark, tx.normalise_name(F.lit("Amr Drake"))) == "AMR DRAKE"
    assert value(spark, tx.relation_type(F.lit("wrote letter to"))) == "WROTE_LETTER_TO"
    assert value(spark, tx.relation_type(F.lit(" -- "))) == "RELATED_TO"
    assert value(spark, tx.strip_fence(F.lit("```json\n{}\n```"))) == "{}"
    assert value(spark, tx.tokenize(F.lit("Café தமிழ் 12a"))) == ["caf", "தமிழ்", "12a"]
    assert value(spark, tx.preview(F.lit("a  b"), 2)) == "a …"
    a = value(spark, tx.request_key(x=F.lit("1"), y=F.lit("2")))
    assert a == value(spark, tx.request_key(y=F.lit("2"), x=F.lit("1"))) != value(spark, tx.request_key(x=F.lit("1"), y=F.lit("3")))


def test_votes_ties_and_conflict(spark):
    data = [(1, "X", "chyron", 0), (1, "Y", "introduction", 1), (2, "Y", "introduction", 0), (2, "Y", "introduction", 1), (2, "X", "chyron", 2), (3, "Z", "introduction", 0), (3, "Z", "chyron", 1)]
    df = spark.createDataFrame(data, "turn long, member string, kind string, ord long")
    found = at.evidence_vote(df, ["turn"]).withColumn("c", at.confidence_of(F.col("kinds"), F.col("conflict")))
    assert sorted(tuple(r) for r in found.select("turn", "member", "conflict", "c").collect()) == [(1, "X", True, 0.6), (2, "X", True, 0.6), (3, "Z", False, 0.95)]


def test_face_verdicts(spark):
    data = [(1, "E", "E"), (1, "E", "E"), (2, "E", "E"), (2, "E", None), (3, "E", "X"), (3, "E", None), (4, "E", None), (5, "E", "Q")]
    df = spark.createDataFrame(data, "turn long, expected string, picked string").withColumn("on_lineup", F.col("picked").isin("E", "X"))
    found = at.face_verdict(df, ["turn"])
    assert sorted(r.verdict for r in found.collect()) == ["confirmed", "contradicted", "partial", "unrecognised", "unrecognised"]
    moved = found.orderBy("turn").select(at.overlay_confidence(F.lit(0.85), F.col("verdict"))).collect()
    assert [r[0] for r in moved] == [0.98, 0.9, 0.55, 0.85, 0.85]
    assert [tuple(r) for r in at.convergent_pick(df, ["turn"]).orderBy("turn").collect()] == []  # none beside X, Q on no lineup
    alike = df.where("turn = 3 and picked = 'X'").unionAll(df.where("turn = 5"))
    assert [tuple(r) for r in at.convergent_pick(alike, ["turn"]).collect()] == [(3, "X")]


def test_roster_ambiguity_fuzzy_and_offices(spark):
    aliases = spark.createDataFrame([("1", "A Kumar"), ("2", "A. Kumar"), ("3", "Selvi Meenakshi"), ("4", "Raman")], "member_id string, alias string")
    names = spark.createDataFrame([("a kumar",), ("Meenakshy",), ("thiru Raman",), ("Nobody",)], "name string")
    found = {r.name: r.member_id for r in rs.resolve(names, rs.alias_index(aliases)).collect()}
    assert found == {"a kumar": None, "Meenakshy": "3", "thiru Raman": "4", "Nobody": None}
    members = spark.createDataFrame([(1, "Deputy Leader of the Opposition"), (2, "Leader of the Opposition — House"), (3, "Minister"), (4, "Minister")], "member_id long, role string")
    offices = spark.createDataFrame([("Leader of the Opposition",), ("Minister",)], "office string")
    assert [tuple(r) for r in rs.unique_holders(members, offices).collect()] == [("Leader of the Opposition", 2)]


def test_fusion_and_splice(spark):
    keys = ["v"]
    ranks = lambda order, name: spark.createDataFrame([("a", 1, d, i + 1) for i, d in enumerate(order)], f"v string, query_id long, doc_id string, {name} long")
    fused = rt.rrf(ranks("ABC", "dense_rank"), ranks("CAB", "sparse_rank"), keys, 3)
    assert [r.doc_id for r in fused.orderBy("rank").collect()] == ["A", "C", "B"]
    hits = ranks("ABCD", "rank")
    model = spark.createDataFrame([("a", 1, "D", 1), ("a", 1, "Z", 2), ("a", 1, "B", 3), ("a", 1, "D", 4)], "v string, query_id long, doc_id string, model_rank long")
    assert [r.doc_id for r in rt.rerank_splice(hits, model, keys, 4).orderBy("final_rank").collect()] == ["D", "B", "A", "C"]
    context = rt.assemble_context(hits.where("rank <= 2"), ranks("BXY", "rank"), keys, 3)
    assert [r.doc_id for r in context.orderBy("place").collect()] == ["A", "B", "X"]


def test_graph_provenance_and_expansion(spark):
    keys = ["video_id"]
    rows = spark.createDataFrame([("v", 1, []), ("v", 2, ["S001"]), ("v", 3, ["S001", "S009"]), ("w", 2, ["S001"]), ("v", 4, ["none"])], "video_id string, row_id long, ids array<string>")
    known = spark.createDataFrame([("v", "S001"), ("w", "S009")], "video_id string, id string")
    assert [(r.video_id, r.row_id) for r in gr.provenance_filter(rows, known, keys).collect()] == [("v", 2)]
    words = lambda *n: [(0, sum(1 << x for x in n))]
    nodes = spark.createDataFrame([("v", "a", "Budget", "", 0, words(1, 2)), ("v", "b", "ab", None, 1, words(3)), ("v", "c", "Water", None, 2, words(2, 4, 5)), ("w", "a", "Budget", None, 0, words(9))], "video_id string, key string, label string, tamil string, first long, words array<struct<word:bigint,bits:bigint>>")
    edges = spark.createDataFrame([("v", "a", "c", 0)], "video_id string, source string, target string, ord long")
    asked = spark.createDataFrame([("v", 1, "the BUDGET of ab")], "video_id string, query_id long, text string")
    assert [r.id for r in gr.expand(asked, nodes, edges, keys).orderBy("rank").collect()] == ["S001", "S002", "S004"]


def test_answers(spark):
    df = spark.createDataFrame([(1, "x [S001, S009]", ["S001"]), (2, "no id", ["S001"])], "answer_id long, text string, context array<string>")
    checked = an.check_citations(df)
    assert [(r.good, r.bad, r.refused) for r in checked.orderBy("answer_id").collect()] == [(["S001"], ["S009"], False), ([], [], True)]


def test_offices_by_portfolio_and_longest_term(spark):
    members = spark.createDataFrame([(1, "Speaker"), (2, "Deputy Speaker"), (3, "Minister — Finance"), (4, "Minister — Health"), (5, "Minister — Health and Law")], "member_id long, role string")
    texts = spark.createDataFrame([("the Deputy Speaker",), ("சபாநாயகர்",), ("நிதி அமைச்சர்",), ("சுகாதார அமைச்சர்",), ("nobody",)], "text string")
    found = {r.text: r.member_id for r in rs.resolve_office(texts, members).collect()}
    assert found == {"the Deputy Speaker": 2, "சபாநாயகர்": 1, "நிதி அமைச்சர்": 3, "சுகாதார அமைச்சர்": None, "nobody": None}
    assert {r.text: r.member_id for r in rs.resolve_office(texts, members, False).collect()}["the Deputy Speaker"] == 1


def test_sets_of_segments_as_words_of_bits(spark):
    from palaver.operators import provenance as pv

    n = [1, 59, 60, 61, 119, 120, 1000, 15000]
    df = spark.createDataFrame([("a", x) for x in n * 3] + [("b", None)], "key string, ordinal long")
    sets = pv.merged(df, ["key"]).groupBy("key").agg(pv.packed().alias("w"))
    found = {r.key: tuple(r)[1:] for r in sets.select("key", pv.size_of(F.col("w")), pv.first_of(F.col("w")), pv.ordinals(F.col("w")), pv.segment_names(F.col("w"), 3)).collect()}
    assert found == {"a": (8, 1, n, ["S001", "S059", "S060"]), "b": (0, None, [], [])}
    assert value(spark, pv.ordinal_of(F.lit("S1234"))) == 1234 and value(spark, pv.ordinal_of(F.lit("x"))) is None


def test_graph_never_crosses_recordings(spark):
    """Two recordings with the same ids, names and speakers: each has its own nodes, edges and answers."""
    keys = ["video_id"]
    roster = spark.createDataFrame([("m1", "A", None, "P", None, None)], "member_id string, name string, tamil_name string, party_code string, roles array<string>, portrait string")
    said = [("v1", "TOPIC", "Water", "", None, 1, 1), ("v1", "TOPIC", "water", "நீர்", None, 2, 2), ("v1", "PERSON", "", None, "m1", 1, 3), ("v2", "TOPIC", "Water", "", None, 3, 1), ("v2", "PERSON", "", None, "m1", 2, 2)]
    mentions = spark.createDataFrame(said, "video_id string, kind string, name string, tamil string, member_id string, ordinal long, ord long")
    nodes = gr.assemble_nodes(mentions, roster, keys)
    from palaver.operators import provenance as pv

    assert sorted((r.video_id, r.key, r.label, r.ids) for r in nodes.withColumn("ids", pv.segment_names(F.col("words"))).collect()) == [("v1", "PERSON:a", "A", ["S001"]), ("v1", "TOPIC:water", "Water", ["S001", "S002"]), ("v2", "PERSON:a", "A", ["S002"]), ("v2", "TOPIC:water", "Water", ["S003"])]
    segments = spark.createDataFrame([("v1", 1, "m1"), ("v1", 2, None), ("v2", 1, "m1"), ("v2", 3, None)], "video_id string, ordinal long, member_id string")
    assert [(r.video_id, r.source, r.target) for r in gr.discussed_edges(nodes, segments, keys).collect()] == [("v1", "PERSON:a", "TOPIC:water")]
    rel = spark.createDataFrame([("v1", 1, "x", "says", "water"), ("v2", 1, "A", "says", "water")], "video_id string, relation_id long, subject string, predicate string, object string").withColumn("segment_ids", F.array(F.lit("S001")))
    members = spark.createDataFrame([("A", "A")], "alias string, name string")
    assert [(r.video_id, r.source) for r in gr.resolve_endpoints(rel, nodes, members, keys).collect()] == [("v2", "PERSON:a")]


def test_first_writers_of_one_place_have_a_total_order(spark):
    roster = spark.createDataFrame([], "member_id string, name string, tamil_name string, party_code string, roles array<string>, portrait string")
    rows = [("v", "TOPIC", "cold anvil", t, None, 1, 1) for t in ("ப9", "ப27", "ப188")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "video_id string, kind string, name string, tamil string, member_id string, ordinal long, ord long").repartition(3)
        assert gr.assemble_nodes(df, roster, ["video_id"]).first().tamil == "ப188"


def test_automaton_finds_all_names():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from palaver.operators.automaton import Automaton

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text("abஅ ", min_size=1, max_size=4), min_size=1, max_size=12, unique=True), st.text("abஅ c", max_size=40))
    def check(names, text):
        machine = Automaton(names)
        assert {names[k] for k in machine.find(text)} == {n for n in names if n in text}
        starts = {n for n in names if any(text.startswith(n, i) and (i == 0 or not text[i - 1].isalnum()) for i in range(len(text)))}
        assert {names[k] for k in machine.find(text, True)} == starts

    check()


def test_names_by_blocks_and_slices(spark, monkeypatch):
    from palaver.operators import automaton

    monkeypatch.setattr(automaton, "NAMES", 3)
    monkeypatch.setattr(automaton, "TEXTS", 2)
    names = spark.createDataFrame([("v", f"n{i}x") for i in range(11)] + [("w", "n1x"), ("v", None), ("v", "")], "video_id string, name string")
    texts = spark.createDataFrame([("v", q, f"n{q}x and n{q + 1}x, n9x") for q in range(7)] + [("w", 1, "n1x n2x"), ("u", 1, "n1x")], "video_id string, query_id long, text string")
    made = automaton.occurrences(texts, names, ["video_id"], F.col("text"), F.col("name"))
    expected = {("v", q, n) for q in range(7) for n in (f"n{q}x", f"n{q + 1}x", "n9x")} | {("w", 1, "n1x")}
    assert {tuple(r) for r in made.collect()} == expected and made.count() == len(expected)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_similar_names_equal_all_pairs(spark):
    """The best alias of each name by comparing all pairs, against the join by parts."""
    import difflib
    import random

    rng = random.Random(5)
    known = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randint(1, 24))).strip().upper() for _ in range(150)} - {""})
    spoilt = lambda t: "".join(c for c in t if rng.random() > 0.07) + rng.choice(["", "A", "BC"])
    names = sorted({spoilt(rng.choice(known)).strip() for _ in range(200)} - {""})
    index = rs.alias_index(spark.createDataFrame([(str(i), a) for i, a in enumerate(known)], "member_id string, alias string"))
    rows = {r.alias: r.member_id for r in index.collect()}
    expected = {}
    for n in names:
        bare = " ".join(n.split())
        close = difflib.get_close_matches(bare, sorted(rows), n=1, cutoff=0.88)
        expected[n] = rows.get(bare) or (rows[close[0]] if close else None)
    found = {r.name: r.member_id for r in rs.resolve(spark.createDataFrame([(n,) for n in names], "name string"), index).collect()}
    assert found == expected and sum(v is not None for v in expected.values()) > 100


def test_names_near_an_alias_do_not_meet_all_that_are_alike(spark, monkeypatch):
    """Every second name lacks a letter, one is further off: only that one meets aliases that are merely alike."""
    made, similar = [], rs.similar_pairs

    def counted(names, known, cutoff):
        pairs = similar(names, known, cutoff)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(rs, "similar_pairs", counted)
    index = rs.alias_index(spark.createDataFrame([(i, f"Supplier#{i:09d}") for i in range(80)], "member_id int, alias string"))
    names = {f"Suplier#{i:09d}" if i % 2 else f"Supplier#{i:09d}": i for i in range(80)} | {"Spplr#000000042": 42, "Customer 7": None}
    found = {r.name: r.member_id for r in rs.resolve(spark.createDataFrame([(n,) for n in names], "name string"), index).collect()}
    assert found == names and sum(made) < 400


def test_nodes_of_members_of_one_name_and_of_others(spark):
    """Members that share a key are one node, with the attributes of the first mention in the whole order, whoever is mentioned."""
    schema = "member_id string, name string, tamil_name string, party_code string, roles array<string>, portrait string"
    roster = spark.createDataFrame([("m1", "A", "z", "P", ["r"], None), ("m2", "a", None, "Q", None, "p"), ("m3", "A", "y", "P", ["r"], None), ("m4", "B", None, None, None, None)], schema)
    rows = [("v", "m1", "", 1, 5), ("v", "m2", "", 61, 5), ("v", "m3", "", 2, 5), ("w", "m2", "", 1, 3), ("w", "m1", "", 1, 4), ("x", None, "A ", 1, 2), ("x", "m1", "", 2, 2), ("y", None, "b", 1, 1), ("y", "m4", "", 1, 1), ("z", "m4", "", None, 1)]
    mentions = spark.createDataFrame(rows, "video_id string, member_id string, name string, ordinal long, ord long").withColumn("kind", F.lit("PERSON")).withColumn("tamil", F.lit(""))
    nodes = gr.assemble_nodes(mentions, roster, ["video_id"])
    got = sorted((r.video_id, r.key, r.label, r.tamil, r.party, r.member_id, r["first"], r.ids) for r in nodes.withColumn("ids", pv.ordinals(F.col("words"))).collect())
    assert got == [
        ("v", "PERSON:a", "A", "y", "P", "m3", 5, [1, 2, 61]),
        ("w", "PERSON:a", "a", None, "Q", "m2", 3, [1]),
        ("x", "PERSON:a", "A", "z", "P", "m1", 2, [1, 2]),
        ("y", "PERSON:b", "B", None, None, "m4", 1, [1]),
        ("z", "PERSON:b", "B", None, None, "m4", 1, []),
    ]


def test_nodes_are_made_once_and_without_the_roster_in_their_shuffle(spark):
    from palaver.plans import graphs, jobs

    folder = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (graphs.discussed_edges(spark, folder), jobs.graph_export(spark, folder)):
        assert "l_orderkey" not in plan(df)
    lines = [x for x in plan(graphs.assembled(spark, folder)).splitlines() if "Aggregate" in x and "word" in x]
    assert lines and not any("roles#" in x or "party_code#" in x for x in lines)


def test_expansion_reads_its_edges_once(spark):
    words = [(0, 2)]
    nodes = spark.createDataFrame([("v", k, k, None, i, words) for i, k in enumerate(("budget", "water"))], "video_id string, key string, label string, tamil string, first long, words array<struct<word:bigint,bits:bigint>>")
    asked = spark.createDataFrame([("v", 1, "the budget")], "video_id string, query_id int, text string")
    edges = spark.range(5, 6).select(F.lit("v").alias("video_id"), F.lit("water").alias("source"), F.lit("budget").alias("target"), F.col("id").alias("ord"))
    found = gr.expand(asked, nodes, edges, ["video_id"])
    assert [r.id for r in found.collect()] == ["S001"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (5, 6") == 1


def test_office_terms_at_word_starts(spark):
    members = spark.createDataFrame([(3, "Minister — Finance")], "member_id long, role string")
    texts = spark.createDataFrame([("நிதி அமைச்சர்",), ("அநிதி",)], "text string")
    found = lambda **k: {r.text: r.member_id for r in rs.resolve_office(texts, members, **k).collect()}
    assert found() == {"நிதி அமைச்சர்": 3, "அநிதி": 3} and found(word_start=True) == {"நிதி அமைச்சர்": 3, "அநிதி": None}


def test_edges_are_made_in_partitions_by_the_tables_rows(spark, monkeypatch):
    """Ten times the rows a partition takes are ten times the partitions, with the same edges."""
    from palaver import session
    from palaver.plans import graphs

    folder = "/root/testdata/sf0.001"
    rows = lambda: sorted(map(tuple, graphs.graph_edges(spark, folder).collect()))
    plain = rows()
    monkeypatch.setattr(session, "PARTITION_ROWS", 500)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    plan = graphs.edges(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-lines // 500)})" in plan and rows() == plain


def test_many_names_are_found_by_pieces_as_by_an_automaton(spark, monkeypatch):
    """Texts are not dealt to blocks of names: none moves; lengths of one byte and more, Tamil, word starts."""
    from palaver.operators import automaton

    names = ["n1", "1x", "x", "நி", "நிதி", "n1x and", "ab", "ப1", "ப12"] + [f"other{i}" for i in range(30)]
    listed = spark.createDataFrame([(v, n) for v in "vw" for n in names if v == "v" or len(n) > 2], "video_id string, name string")
    rows = [("v", 1, "n1x and நிதி"), ("v", 2, "ப123 other7 cab"), ("w", 3, "n1x and நிதி"), ("w", 4, ""), ("u", 5, "n1x"), ("v", 6, None)]
    texts = spark.createDataFrame(rows, "video_id string, query_id long, text string")
    there = lambda t, n, w: any(t.startswith(n, i) and not (w and i and t[i - 1].isalnum()) for i in range(len(t)))
    for most in (1000, 5):
        monkeypatch.setattr(automaton, "NAMES", most)
        for starts in (False, True):
            made = automaton.occurrences(texts, listed, ["video_id"], F.col("text"), F.col("name"), starts)
            expected = sorted((v, q, n) for v, q, t in rows if t for n in names if (v == "v" or v == "w" and len(n) > 2) and there(t, n, starts))
            assert sorted(tuple(r) for r in made.collect()) == expected
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "CoGroup" not in plan and "BroadcastHashJoin" in plan


def test_expansion_moves_one_row_for_a_node_of_a_question(spark):
    """Ids are listed in order where a node's list is made: no window by question, and mentions without a member meet no roster."""
    words = lambda *n: [(0, sum(1 << x for x in n))]
    nodes = [("v", "a", "alpha", None, 1, words(1, 2, 3)), ("v", "b", "beta", None, 0, words(2, 5)), ("v", "c", "gamma", None, 2, words(*range(7, 20))), ("v", "d", "delta", None, 3, [])]
    nodes = spark.createDataFrame(nodes, "video_id string, key string, label string, tamil string, first long, words array<struct<word:bigint,bits:bigint>>")
    edges = spark.createDataFrame([("v", "b", "c", 4), ("v", "a", "d", 1), ("v", "d", "b", 1)], "video_id string, source string, target string, ord long")
    asked = spark.createDataFrame([("v", 1, "alpha beta"), ("v", 2, "delta"), ("v", 3, "gamma alpha"), ("v", 4, "none")], "video_id string, query_id long, text string")
    found = gr.expand(asked, nodes, edges, ["video_id"])
    got = sorted((r.query_id, r["rank"], r.id) for r in found.collect())
    assert got == [(q, i + 1, f"S{n:03}") for q, ids in ((1, (2, 5, 7, 8, 1, 3)), (2, (2, 5, 1)), (3, (1, 2, 3, 7, 8, 9))) for i, n in enumerate(ids)]
    assert not any("Window" in x and "query_id" in x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines())
    schema = "video_id string, kind string, name string, tamil string, member_id string, ordinal long, ord long"
    said = spark.createDataFrame([("v", "TOPIC", "Water", "", None, 1, 1), ("v", "PERSON", "", None, "m1", 1, 3), ("v", "PERSON", "X", None, "m2", 1, 4)], schema)
    roster = spark.createDataFrame([("m1", "A", None, "P", None, None)], "member_id string, name string, tamil_name string, party_code string, roles array<string>, portrait string")
    made = gr.assemble_nodes(said, roster, ["video_id"])
    assert sorted(r.key for r in made.collect()) == ["PERSON:a", "PERSON:x", "TOPIC:water"]
    assert "Union" in made._jdf.queryExecution().optimizedPlan().toString()
