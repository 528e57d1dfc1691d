"""Search by recording: ranks, heaps, the stored index, and groups that stay bounded."""

import numpy as np
from pyspark.sql import functions as F

from palaver.operators import index as ix
from palaver.operators import ranks
from palaver.operators import retrieval as rt
from palaver.operators.dealing import dealt

KEYS = ["video_id"]


def test_ranks_of_one_hot_key_with_ties_and_nulls(spark):
    rows = [("a", i % 7, i) for i in range(500)] + [("b", 1, 1), (None, None, 2), (None, 3, 3)] + [("a", 3, 3)] * 40
    df = spark.createDataFrame(rows, "k string, x long, i long").repartition(5)
    found = ranks.ranked_rows(df, ["k"], [F.col("x").desc_nulls_last(), F.col("i").asc()]).collect()
    assert len(found) == len(rows)
    for key in ("a", "b", None):
        own = sorted((r for r in found if r.k == key), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        order = [(r.x is None, -(r.x or 0), r.i) for r in own]
        assert order == sorted(order)


def plain_hybrid(docs, vectors, scores, query, k):
    """Ranks of all documents on both sides, fused."""
    dense = {d: i + 1 for i, d in enumerate(sorted(docs, key=lambda d: (-round(float(np.dot(vectors[d], query)), 9), d)))}
    sparse = {d: i + 1 for i, d in enumerate(sorted(docs, key=lambda d: (-round(scores.get(d, 0.0), 9), d)))}
    fused = sorted(docs, key=lambda d: (-round(1 / (60 + dense[d]) + 1 / (60 + sparse[d]), 9), dense[d]))
    return fused[:k]


def test_hybrid_equals_full_ranks(spark, monkeypatch):
    """Negative, zero, tied and missing scores; blocks of a few rows."""
    for name, n in (("VECTORS", 30), ("SCORED", 20), ("IDS", 25), ("QUESTIONS", 2), ("FAN", 3)):
        monkeypatch.setattr(rt, name, n)
    rng = np.random.default_rng(3)
    docs = {v: list(range(n)) for v, n in (("a", 260), ("b", 90), ("c", 5))}
    vectors = {v: {d: rng.integers(-2, 3, 3).astype(float) for d in own} for v, own in docs.items()}
    asked = {(v, q): rng.integers(-2, 3, 3).astype(float) for v in docs for q in range(4)}
    scores = {(v, q): {d: float(rng.choice([-1.0, 0.0, 0.5, 2.0])) for d in docs[v] if rng.random() < q / 3} for v, q in asked}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    table = frame([(v, d) for v in docs for d in docs[v]], "video_id string, doc_id long")
    space = frame([(v, d, list(map(float, x))) for v in docs for d, x in vectors[v].items()], "video_id string, doc_id long, embedding array<float>")
    wanted = frame([(v, q, list(map(float, x))) for (v, q), x in asked.items()], "video_id string, query_id long, query array<float>")
    rated = frame([(v, q, d, s) for (v, q), own in scores.items() for d, s in own.items()], "video_id string, query_id long, doc_id long, score double")
    found = {}
    for r in rt.hybrid(table, space, rated, wanted, KEYS, 6).orderBy("rank").collect():
        found.setdefault((r.video_id, r.query_id), []).append(r.doc_id)
    assert found == {(v, q): plain_hybrid(docs[v], vectors[v], scores[v, q], asked[v, q], 6) for v, q in asked}


def test_one_term_in_a_million_documents_is_many_small_groups(spark):
    scored = spark.range(1_000_000).select(F.lit("v").alias("video_id"), F.lit(1).cast("long").alias("query_id"), F.col("id").alias("doc_id"), F.lit(1.0).alias("s"))
    asked = spark.createDataFrame([("v", 1, [(1.0, 5)])], "video_id string, query_id long, cands array<struct<s:double,doc_id:long>>")
    left, _, by = dealt(scored, asked, [*KEYS, "query_id"], F.col("doc_id"), F.lit(0), rt.SCORED, rt.QUESTIONS)
    sizes = left.groupBy(*by).count()
    assert sizes.agg(F.max("count")).first()[0] < 1.1 * rt.SCORED and sizes.count() == 20
    top = rt.best(scored.withColumnRenamed("s", "score"), [*KEYS, "query_id"], rt.by_score(), 5)
    assert [r.doc_id for r in top.orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # heaps in every task, before rows move


def test_stored_index_reads_the_buckets_of_its_terms(spark, tmp_path):
    path = f"{tmp_path}/index"
    text = lambda d: f"alpha w{d % 13} beta{d % 5} " * (1 + d % 3)
    docs = spark.createDataFrame([(f"v{d % 3}", d, text(d)) for d in range(90)], "video_id string, doc_id long, text string")
    ix.append(docs, KEYS, path)
    asked = spark.createDataFrame([("v0", 1, "alpha beta3 nowhere"), ("v1", 2, "w4 w4"), ("v9", 3, "alpha")], "video_id string, query_id long, text string")
    rows = lambda df: sorted((r.video_id, r.query_id, r.doc_id, round(r.score, 9)) for r in df.collect())
    assert rows(ix.search(spark, path, asked, KEYS)) == rows(rt.bm25(docs, asked, KEYS))
    wanted = rt.wanted_terms(asked, KEYS)
    terms = sorted(r.b for r in wanted.select(ix.bucket_of(F.col("term")).alias("b")).distinct().collect())
    plan = ix.postings(spark, path, KEYS, wanted)._jdf.queryExecution().executedPlan().toString()
    assert f"IN ({','.join(map(str, terms))})" in plan.split("PartitionFilters: [")[1].split("]")[0]  # the scan lists no other folder
    # an update of one recording: what it was is read no more, and compaction drops it
    changed = docs.where("video_id = 'v0' and doc_id < 40").withColumn("text", F.concat("text", F.lit(" beta3")))
    ix.append(changed, KEYS, path)
    now = changed.unionByName(docs.where("video_id <> 'v0'"))
    assert rows(ix.search(spark, path, asked, KEYS)) == rows(rt.bm25(now, asked, KEYS))
    ix.compact(spark, path, f"{tmp_path}/small", KEYS)
    assert rows(ix.search(spark, f"{tmp_path}/small", asked, KEYS)) == rows(rt.bm25(now, asked, KEYS))
    assert spark.read.parquet(f"{tmp_path}/small/postings").count() < spark.read.parquet(f"{path}/postings").count()


def test_a_scan_of_one_small_file_is_dealt_out(spark, tmp_path):
    from palaver.session import spread

    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(100).repartition(9).write.option("maxRecordsPerFile", 1).parquet(f"{tmp_path}/many")
    one, many = spark.read.parquet(f"{tmp_path}/one"), spark.read.option("openCostInBytes", "1g").parquet(f"{tmp_path}/many")
    assert spread(one).count() == 10 and "Exchange" in spread(one)._jdf.queryExecution().executedPlan().toString()
    parts = many.rdd.getNumPartitions()
    moved = "Exchange" in spread(many)._jdf.queryExecution().executedPlan().toString()
    assert moved == (parts < spark.sparkContext.defaultParallelism)


def test_words_are_counted_as_the_tokenizer_has_them(spark, monkeypatch):
    """Parts of a few bytes, Tamil beside ASCII, other scripts, empty and missing texts; the index's build moves postings once."""
    from palaver.functions.text import tokenize
    from palaver.operators import counting

    monkeypatch.setattr(counting, "TEXT", 40)
    monkeypatch.setattr(counting, "ROWS", 3)
    texts = ["Alpha beta alpha", "", None, "அவை12அவை x", "ஆ", "a୿b ఀc é-E0 àb", "İK K9", "...", "beta " * 30, "a", "a"]
    docs = spark.createDataFrame([("v" if i % 3 else None, i, t) for i, t in enumerate(texts)], "video_id string, doc_id long, text string").coalesce(1)
    tokens = {r.doc_id: r.t for r in docs.select("doc_id", tokenize(F.col("text")).alias("t")).collect()}
    found = counting.counted(docs, KEYS)
    assert sorted((r.doc_id, r.term, r.tf, r.dl) for r in found.where("term is not null").collect()) == sorted((d, w, t.count(w), len(t)) for d, t in tokens.items() for w in set(t or []))
    whole = {r.video_id: tuple(r)[1:] for r in found.where("term is null").groupBy("video_id").agg(F.sum("df"), F.sum("tf"), F.sum("dl")).collect()}
    own = lambda v: [tokens[i] for i in range(len(texts)) if (i % 3 > 0) == (v is not None)]
    assert whole == {v: (len(own(v)), sum(t is not None for t in own(v)), sum(len(t or []) for t in own(v))) for v in ("v", None)}
    some = counting.counted(docs, KEYS, terms=["alpha", "12"]).where("term is not null")
    assert sorted((r.doc_id, r.term, r.tf) for r in some.collect()) == [(0, "alpha", 2), (3, "12", 1)]
    counts = counting.counted(docs, KEYS, postings=False).where("term is not null").groupBy("video_id", "term").agg(F.sum("df").alias("n"))
    assert {(r.video_id, r.term): r.n for r in counts.collect()} == {(v, w): sum(w in (t or []) for t in own(v)) for v in ("v", None) for w in {x for t in own(v) for x in t or []}}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_document_without_a_text_is_a_document(spark, tmp_path, monkeypatch):
    """It counts for the idf and not for the mean length, as in the SQL; and the idfs of words no one asks for are in the mean."""
    texts = ["a b", None, "b c c", "", "d b", None]
    docs = spark.createDataFrame([("v", i, t) for i, t in enumerate(texts)], "video_id string, doc_id long, text string")
    asked = spark.createDataFrame([("v", 1, "b c")], "video_id string, query_id long, text string")
    tokens = [t.split() for t in texts if t is not None]
    idf = {w: np.log(len(texts) - n + 0.5) - np.log(n + 0.5) for w, n in (("a", 1), ("b", 3), ("c", 1), ("d", 1))}
    idf = {w: x if x >= 0 else 0.25 * np.mean(list(idf.values())) for w, x in idf.items()}
    mean = sum(map(len, tokens)) / len(tokens)
    expected = {i: sum(idf[w] * t.split().count(w) * 2.5 / (t.split().count(w) + 1.5 * (0.25 + 0.75 * len(t.split()) / mean)) for w in "bc") for i, t in enumerate(texts) if t}
    ix.append(docs, KEYS, f"{tmp_path}/index")
    for few in (100_000, 1):  # more query terms than are sent to the tasks
        monkeypatch.setattr(rt, "BROADCAST_ROWS", few)
        for found in (rt.bm25(docs, asked, KEYS), ix.search(spark, f"{tmp_path}/index", asked, KEYS)):
            assert {r.doc_id: round(r.score, 9) for r in found.collect()} == {i: round(float(s), 9) for i, s in expected.items()}


def watched(spark, texts):
    """Documents of two recordings, and the number of times that one of them was read."""
    seen = spark.sparkContext.accumulator(0)

    def read(row):
        seen.add(1)
        return row

    rows = [(f"v{i % 2}", i // 2, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(read), "video_id string, doc_id long, text string"), seen


def test_bm25_reads_each_text_once(spark):
    docs, seen = watched(spark, [f"alpha w{i % 7} beta{i % 3} beta{i % 3}" for i in range(60)])
    asked = spark.createDataFrame([("v0", 1, "alpha beta1 nowhere"), ("v1", 2, "w4 w4")], "video_id string, query_id long, text string")
    assert rt.bm25(docs, asked, KEYS).count() > 0
    assert seen.value == 60


def test_ranks_count_the_scores_of_a_question_once(spark):
    """A side whose sizes are known is not counted again when it is dealt."""
    docs, seen = watched(spark, ["x"] * 40)
    sizes = spark.createDataFrame([("v0", 20), ("v1", 20)], "video_id string, n long")
    asked = spark.createDataFrame([("v0", 1), ("v1", 2)], "video_id string, query_id long")
    left, _, by = dealt(docs, asked, KEYS, F.col("doc_id"), F.col("query_id"), 5, 5, sizes)
    assert seen.value == 0
    assert left.groupBy(*by).count().agg(F.sum("count")).first()[0] == 40 and seen.value == 40


def test_bundles_of_words_give_the_counts_of_the_vocabulary(spark, monkeypatch):
    """Parts of a few bytes, two keys with nulls, few buckets: the df of each word asked for, and how many others have the same; at most a bundle for each bucket leaves a part."""
    from palaver.functions.text import tokenize
    from palaver.operators import counting

    monkeypatch.setattr(counting, "TEXT", 90)
    monkeypatch.setattr(counting, "BUCKETS", 5)
    texts = ["Alpha beta alpha", "", None, "அவை12அவை x", "beta " * 9, "a b c d e f g h", "a b c", "a", "...", "İK K9 beta", "alpha z" + "y" * 90]
    rows = [("v" if i % 3 else None, i % 2, i, texts[i % len(texts)]) for i in range(44)]
    docs = spark.createDataFrame(rows, "video_id string, part long, doc_id long, text string").repartition(3)
    keys, terms = ["video_id", "part"], ["a", "beta", "nowhere"]
    tokens = {r.doc_id: r.t for r in docs.select("doc_id", tokenize(F.col("text")).alias("t")).collect()}
    found = counting.surveyed(docs, keys, terms).persist()
    own = found.where("bucket is null").collect()
    assert sorted((r.doc_id, r.dl, r.numbers, r.tf) for r in own if r.dl is not None) == sorted((d, len(t), [i for i, w in enumerate(terms) if w in t], [t.count(w) for w in terms if w in t]) for d, t in tokens.items() if t is not None)
    assert sorted(r.doc_id for r in own if r.dl is None) == [d for d, t in sorted(tokens.items()) if t is None]
    df = {}
    for v, p, d, _ in rows:
        for w in set(tokens[d] or []):
            df[v, p, w] = df.get((v, p, w), 0) + 1
    for groups in (1, 4):
        tally, others = counting.tallied(found.where("bucket is not null"), keys, terms, groups).collect(), {}
        assert sorted((str(r.video_id), r.part, terms[r.term], r.df, r.times) for r in tally if r.term is not None) == sorted((str(v), p, w, n, 1) for (v, p, w), n in df.items() if w in terms)
        for r in tally:
            if r.term is None:
                others[r.video_id, r.part, r.df] = others.get((r.video_id, r.part, r.df), 0) + r.times
        expected = [(v, p, n) for (v, p, w), n in df.items() if w not in terms]
        assert others == {x: expected.count(x) for x in expected}
    bundles = found.where("bucket is not null")
    assert bundles.agg(F.max("bucket")).first()[0] < 5 and bundles.where("size(owners) > 1").count() > 0
    found.unpersist()


def test_every_question_of_the_table_is_asked(spark):
    from palaver.plans import searches

    folder = "/root/testdata/sf0.001"
    items = sorted(r.item_id for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect())
    asked = searches.questions(spark, folder).collect()
    assert sorted((r.video_id, r.query_id) for r in asked) == sorted((f"V{i}", q) for i in range(searches.RECORDINGS) for q in items)
    assert {r.query_id for r in searches.bm25_topk(spark, folder).select("query_id").distinct().collect()} == set(items)


def test_the_best_documents_are_those_of_all_scores(spark, monkeypatch):
    """Blocks of a few documents, equal scores, idfs below zero and of zero, documents without a text, two keys with nulls; more terms than are sent to the tasks."""
    monkeypatch.setattr(rt, "DOCUMENTS", 9)
    monkeypatch.setattr(rt, "CELLS", 12)
    rows = [("v" if i % 3 else "w", i % 2, i, None if i % 11 == 5 else f"alpha w{i % 7} w{i % 7} " + "beta " * (i % 4) + "even " * (i % 4 // 2)) for i in range(120)]
    docs = spark.createDataFrame(rows, "video_id string, part long, doc_id long, text string").repartition(2)
    asked = [(v, p, q, t) for v in "vwx" for p in (0, 1) for q, t in enumerate(("alpha", "beta w1 w1 w3", "even even", "w0 w1 w2 w3 w4 w5 w6 alpha", "nowhere", ""))]
    asked = spark.createDataFrame(asked, "video_id string, part long, query_id int, text string")
    keys = ["video_id", "part"]
    listed = lambda df: sorted((r.video_id, r.part, r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
    expected = listed(rt.best(rt.bm25(docs, asked, keys), [*keys, "query_id"], rt.by_score(), 4))
    assert expected and listed(rt.bm25_top(docs, asked, keys, 4)) == expected
    for name in ("RATED", "BROADCAST_ROWS"):
        monkeypatch.setattr(rt, name, 1)
        assert listed(rt.bm25_top(docs, asked, keys, 4)) == expected


def test_a_stored_index_is_asked_every_question(spark, tmp_path, monkeypatch):
    """All questions of the table; the best of groups of a few postings, after an update, are those of all scores."""
    from palaver.plans import searches

    items = {r.item_id for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()}
    assert {r.query_id for r in searches.stored_index_topk(spark, "/root/testdata/sf0.001").select("query_id").distinct().collect()} == items
    monkeypatch.setattr(ix, "POSTINGS", 20)
    rows = [("v" if i % 3 else "w", i, None if i % 11 == 5 else f"alpha w{i % 7} w{i % 7} " + "beta " * (i % 4)) for i in range(60)]
    docs = spark.createDataFrame(rows, "video_id string, doc_id long, text string")
    asked = [(v, q, t) for v in "vwx" for q, t in enumerate(("alpha", "beta w1 w1 w3", "w0 w1 w2 w3 w4 w5 w6 alpha", "nowhere", ""))]
    asked = spark.createDataFrame(asked, "video_id string, query_id long, text string")
    ix.append(docs.withColumn("text", F.when(F.col("video_id") == "w", "beta").otherwise(F.col("text"))), KEYS, f"{tmp_path}/index")
    ix.append(docs.where("video_id = 'w'"), KEYS, f"{tmp_path}/index")
    listed = lambda df: sorted((r.video_id, r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
    expected = listed(rt.best(rt.bm25(docs, asked, KEYS), [*KEYS, "query_id"], rt.by_score(), 4))
    assert expected and listed(ix.search_top(spark, f"{tmp_path}/index", asked, KEYS, 4)) == expected
    monkeypatch.setattr(rt, "RATED", 1)
    assert listed(ix.search_top(spark, f"{tmp_path}/index", asked, KEYS, 4)) == expected
