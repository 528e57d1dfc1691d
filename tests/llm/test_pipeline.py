"""The pipeline's stages on a small corpus with planted rows."""

import random
from collections import Counter

import corpus_pipeline as cp
from helpers import DOCS, linked, odd_rows


def corpus():
    rng = random.Random(11)
    words = {"en": ["the", "house", "with", "water", "thing", "ship"], "de": ["der", "schön", "über", "haus", "nicht", "straße"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + str(rng.randrange(40)) for _ in range(n))
    rows = [(i, text(lang := rng.choice(["en", "de"]), 60), lang, f"s{i % 9}", 1) for i in range(120)]
    rows += [(500 + i, "sign up now for more\n" + text("en", 40), "en", f"s{i}", 1) for i in range(9)]
    near = rows[5][1].split()
    rows.append((600, " ".join([*near[:-1], "changed"]), rows[5][2], "s1", 1))
    rows.append((601, "leak " + " ".join(f"item{k}" for k in range(12)) + " end", "en", "s2", 1))
    rows.append((602, "1234 5678", "en", "s2", 9))
    return rows


def test_stages(spark, tmp_path):
    d = str(tmp_path)
    docs = spark.createDataFrame(corpus(), DOCS)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"item{k}" for k in range(12)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for number, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, d)
        assert out.columns[:5] == cp.COLUMNS and (number == 4 or len(out.columns) == 5)
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    ids = [set(x) for x in seen.values()]
    assert {r[0] for r in corpus()} - ids[0] == {602}
    assert ids[1] == ids[0]
    assert sum("sign up now" in r.text for r in seen["line_dedup"].values()) == 1
    near = linked([(i, r.text) for i, r in seen["line_dedup"].items()], 5, 80, 100)
    assert ids[2] == {i for i in ids[1] if near[i][1] == i} and 600 not in ids[2] and 5 in ids[2]
    assert ids[2] - ids[3] == {601}
    assert ids[4] <= ids[3] and all(0 < r.taken <= 2 * r["size"] for r in seen["mixing"].values())
    assert {r.doc_id for r in cp.run(spark, d).collect()} == ids[4]


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    """Each stage on the odd rows themselves, and on no rows, gives what its docstring says."""
    d = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, stages = spark.createDataFrame(odd_rows(), DOCS), dict(cp.STAGES)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=repr)
    every = sorted((r[0] for r in odd_rows()), key=repr)
    assert not {3, 4, 5, 7} & set(ids(stages["language_id"](spark, docs, d)))
    unlabelled = docs.where("doc_id = 1").selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    assert stages["language_id"](spark, unlabelled, d).count() == 0
    lines = stages["line_dedup"](spark, docs, d)
    assert ids(lines) == every and sorted(map(repr, lines.collect())) == sorted(map(repr, docs.collect()))
    assert ids(stages["near_duplicates"](spark, docs, d)) == sorted([1, 3, 4, 5, 6, 7, 8, None], key=repr)
    assert ids(stages["decontamination"](spark, docs, d)) == every
    mixed = stages["mixing"](spark, docs, d).collect()
    assert mixed and not {r.doc_id for r in mixed} & {3, 4, 5} and all(len(r.text.split()) == r.taken for r in mixed)
    for stage in stages.values():
        found = stage(spark, docs.limit(0), d)
        assert found.count() == 0 and found.columns[:5] == cp.COLUMNS


def test_mixing_emits_the_taken_words(spark):
    rng = random.Random(3)
    text = lambda i: "".join(f"w{i}.{k}" + rng.choice([" ", "\n", "  "]) for k in range(rng.randrange(1, 150)))
    rows = [(i, text(i), "en", "abc"[i % 3], None) for i in range(150)]
    found = cp.mix_sources(spark, spark.createDataFrame(rows, DOCS), "").collect()
    emitted, aims = {}, {}
    for r in found:
        own = rows[r.doc_id][1].split()
        assert len(r.text.split()) == r.taken and set(r.text.split()) <= set(own)
        assert max(Counter(r.text.split()).values()) <= 2
        assert r.n_chars is None and r.text == rows[r.doc_id][1] or r.n_chars == len(r.text)
        emitted[r.source] = emitted.get(r.source, 0) + len(r.text.split())
        aims[r.source] = r.target
    for s, aim in aims.items():
        assert abs(emitted[s] - aim) <= 0.02 * aim + 32
