"""The learned operators: held-out accuracy, exact counts, gradients, and odd rows."""

import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import DOCS, SPACED, lower, odd_rows, with_clashes
from pyspark.sql import functions as F

from palaver.llm import langid, lm, toxicity
from palaver.llm.blocks import bounded_sample, crc_remainder

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@needs_tables
def test_language_accuracy(spark):
    found = {r.doc_id: r for r in langid.op1_byte_network_language_id(spark, FOLDER).collect()}
    truth = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()
    held = [r for r in truth if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert {r["doc_id"] for r in held} == {i for i, r in found.items() if r.held_out}
    assert np.mean([found[r["doc_id"]].lang_pred == r["lang"] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_of_odd_rows(spark, odd):
    scorer = langid.fit(odd.where("text is not null and lang is not null").select("text", "lang"))
    found = langid.predict(with_clashes(odd), scorer).collect()
    assert [r.doc_id for r in found if r.lang_pred == "und"] == [3, 4, 5, 7]
    assert {r.lang_pred for r in found} <= {"en", "de", "fr", "und"}
    assert langid.predict(odd.limit(0), scorer).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(odd.limit(0).select("text", "lang"))).collect()} == {"und"}


def test_equal_texts_are_judged_alike(spark):
    """Repeated rows, and texts that tie, have one prediction, and a sample is the same in every run."""
    rows = [(i, "der alte baum steht dort" if i % 2 else "the old tree stands there", "de" if i % 2 else "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    scorer = langid.fit(docs.select("text", "lang"))
    assert len({(r.text, r.lang_pred, r.lang_score) for r in langid.predict(docs, scorer).collect()}) == 2
    labelled = docs.select("text", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    net = toxicity.fit(labelled)
    assert len({(r.text, r.toxicity) for r in toxicity.score(docs, net).collect()}) == 2
    many = spark.range(4000).select(F.col("id").cast("string").alias("text")).unionAll(spark.range(2000).select(F.lit("copy").alias("text")))
    draw = lambda df: [r.text for r in bounded_sample(df, 50, F.col("text")).collect()]
    assert draw(many) == draw(many.repartition(7)) and len(set(draw(many))) == len(draw(many)) > 40


def test_language_tables_equal_the_network():
    net = langid.ByteNetwork(["x", "y"])
    rows = np.random.default_rng(0).integers(0, 256, (5, langid.WINDOW), dtype=np.uint8)
    pooled, _ = net.pooled(rows)
    assert langid.Scorer(net).windows(rows) == pytest.approx(langid.softmax(np.maximum(pooled, 0) @ net.out + net.out_bias), abs=1e-5)


def test_toxicity_gradients():
    """Backward passes against differences of the loss."""
    net = toxicity.GatedNetwork(lm.Head(toxicity.Words(*toxicity.block_of([b"idiot fine words"]), toxicity.ALNUM).hashes))
    for p in net.parameters():
        p *= 1.5
    data, offsets = toxicity.block_of([b"you are an idiot", b"fine words here"])
    inputs, target, weight = net.inputs(data, offsets), np.array([1.0, 0.0]), np.array([1.0, 2.0])
    _, index = net.best_windows(inputs)

    def loss():
        z = net.logits(net.gates(inputs), index).astype(np.float64)
        return (weight * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - target * z)).sum() / weight.sum()

    grads = net.gradients(inputs, net.gates(inputs), index, target, weight)
    rng = np.random.default_rng(3)
    for p, g in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax() if rng.random() < 0.9 else 0, p.shape)
        old, h = p[at], 1e-2
        p[at] = old + h
        up = loss()
        p[at] = old - h
        down = loss()
        p[at] = old
        assert (up - down) / (2 * h) == pytest.approx(float(g[at]), rel=0.08, abs=2e-4)


def test_toxicity_learns_and_meets_odd_rows(spark, odd):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    rows = []
    for i in range(240):
        words, toxic = [word() for _ in range(int(rng.integers(3, 140)))], int(i % 4 == 0)
        if toxic:
            words[int(rng.integers(len(words)))] = "moronic"
        rows.append((i, " ".join(words), toxic))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.fit(labelled.where("doc_id < 180").select("text", "toxic"))
    scores = {r.doc_id: r.toxicity for r in toxicity.score(labelled, net).collect()}
    held = [(scores[i] >= toxicity.THRESHOLD, bool(t)) for i, _, t in rows if i >= 180]
    assert np.mean([a == b for a, b in held]) > 0.9
    found = toxicity.score(with_clashes(odd), net).collect()
    assert len(found) == len(odd_rows()) and all(0 <= r.toxicity <= 1 for r in found)
    assert len({r.toxicity for r in found if r.doc_id in (3, 4, 5)}) == 1
    assert toxicity.fit(labelled.where("toxic = 1").select("text", "toxic")) == 1.0
    assert {r.toxicity for r in toxicity.score(odd, 0.25).collect()} == {0.25}
    assert toxicity.score(odd.limit(0), net).count() == 0


def test_toxicity_learns_passages_at_the_end_of_long_texts(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 12))
    rows = []
    for i in range(60):
        words, toxic = [word() for _ in range(820)], int(i % 3 == 0)
        if toxic:
            words[-int(rng.integers(1, 20))] = "moronic"
        rows.append((i, " ".join(words), toxic))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.fit(labelled.where("doc_id < 45").select("text", "toxic"))
    scores = {r.doc_id: r.toxicity for r in toxicity.score(labelled.where("doc_id >= 45"), net).collect()}
    assert np.mean([(scores[i] >= toxicity.THRESHOLD) == bool(t) for i, _, t in rows if i >= 45]) > 0.9


def test_every_word_is_in_a_window():
    for n in [*range(0, 200), 1000]:
        owner, first = toxicity.windows_of(np.array([n]))
        covered = {w for s in first for w in range(s, min(n, s + toxicity.WINDOW))}
        assert len(owner) and covered == set(range(n))


@pytest.mark.parametrize("head", [50_000, 6])
def test_language_model_counts(spark, odd, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    docs = with_clashes(odd)
    found = lm.score_corpus(docs, crc_remainder("doc_id", 7) == 2).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [(i, [*SPACED.findall(lower(t)), None]) for i, t, *_ in odd_rows()]
    counts = Counter(w for i, words in tokens if not held(i) for w in words)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(((i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=repr) == expected
    assert all(r.score < 0 for r in found)


def test_language_model_is_normalised(spark):
    """The probabilities of all known words, one unknown word and the end sum to one after a context."""
    docs = spark.createDataFrame([(i, "a b a c d e f g a b") for i in range(4)], "doc_id long, text string")
    base = {r.doc_id: r.score for r in lm.score_corpus(docs, F.lit(False)).collect()}
    assert len(set(base.values())) == 1
    model = lm.LogBilinear(7)
    before = np.array([[1, 2]] * 7)
    assert np.exp(model.log_probs(before, np.arange(7))).sum() == pytest.approx(1, abs=1e-5)
    assert lm.score_corpus(docs.limit(0), F.lit(False)).count() == 0
    assert [round(r.base_score, 9) for r in lm.score_corpus(docs, F.lit(True)).collect()] == [0.0] * 4


def test_language_model_scores_by_brute_force(spark, monkeypatch):
    """Score of every text from the model itself: class and unit shares by plain sums, words without a unit by their share."""
    rng = np.random.default_rng(12)
    words = [f"w{int(k)}" for k in rng.zipf(1.5, 4000) % 300]
    rows = [(i, " ".join(words[i * 40 : i * 40 + int(rng.integers(0, 40))])) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lm, "UNITS", 40)
    held = crc_remainder("doc_id", 7) == 2
    corpus = lm.Corpus(docs.where(~held).select("text"))
    model = lm.fit(docs.where(~held).select("text"), corpus)
    assert corpus.units == 40
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.split())
    own = lambda w: int(lm.Tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), corpus.head, 40).units[0])
    unit = {w: own(w) for w in {*words, "unseen"}}
    endings = corpus.head.endings
    assert endings == 5 and len([w for w in counts if unit[w] >= endings]) == 34
    share = {}
    for e in range(endings):
        others = [w for w in counts if unit[w] == e]
        for w in [*others, None]:
            share[e, w] = (counts.get(w, 0) + 1) / (sum(counts[x] for x in others) + len(others) + 1)
        assert sum(v for (k, _), v in share.items() if k == e) == pytest.approx(1)

    def probability(before, u):
        r = sum(model.context[b] * model.place[k] for k, b in enumerate(before))
        part = lambda v, bias, i: float(np.exp(v[i] @ r + bias[i]) / np.exp(v @ r + bias).sum())
        of = model.members(u // model.size)
        return part(model.group, model.group_bias, u // model.size) * part(model.target[of], model.bias[of], u - of.start)

    assert sum(probability([3, 39], u) for u in range(40)) == pytest.approx(1, abs=1e-5)
    found = {r.doc_id: r.score for r in lm.score_corpus(docs, held).collect()}
    for i, t in rows[::9]:
        seen, total = [39, 39], 0.0
        for w in [*t.split(), None]:
            u = 39 if w is None else unit[w]
            total += math.log10(probability(seen[::-1][:2], u)) + (math.log10(share.get((u, w), share.get((u, None)))) if u < endings else 0)
            seen.append(u)
        assert found[i] == pytest.approx(total, abs=1e-3 * max(1, len(t.split())) ** 0.5)


def test_language_model_is_the_same_however_rows_are_split(spark, monkeypatch):
    """Reruns with 1, 2 and 8 partitions, several parts and a tree of sums; every training token is learnt from."""
    rng = np.random.default_rng(8)
    words = [f"w{int(k)}" for k in rng.zipf(1.4, 9000) % 500]
    rows = [(i, " ".join(words[i * 60 : i * 60 + int(rng.integers(0, 60))])) for i in range(150)] + [(7, "w1 w2 w3")] * 3
    monkeypatch.setattr(lm, "UNITS", 80)
    monkeypatch.setattr(lm, "PART_TOKENS", 700)
    monkeypatch.setattr(lm, "FIRST_ROWS", 10)
    seen, held = [], crc_remainder("doc_id", 7) == 2
    for n in (1, 2, 8):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        seen.append(sorted((r.doc_id, r.score, r.base_score) for r in lm.score_corpus(docs, held).collect()))
    for other in seen[1:]:
        assert [x[0] for x in other] == [x[0] for x in seen[0]]
        assert np.allclose([x[1:] for x in other], [x[1:] for x in seen[0]], rtol=1e-5)
    training = docs.where(~held).select("doc_id", "text")
    corpus, learner = lm.Corpus(training), None
    learner = lm.Learner(lm.LogBilinear(corpus.units), 1)
    sums = {r.piece: np.frombuffer(r.sums, np.float64) for r in lm.learn_everywhere(training, corpus, learner).collect()}
    flat, model = np.concatenate([sums[k] for k in sorted(sums)]), learner.model
    assert flat[-lm.CONTEXT :] == pytest.approx(corpus.words + corpus.ends)  # the last weights are of all tokens that were learnt from


def test_a_learning_step_is_the_plain_one_in_few_calls(monkeypatch):
    """A step's gradients are those of single tokens and noise, and its logits are made at once, however many classes there are."""
    monkeypatch.setattr(lm, "BATCH", 1 << 20)
    model, rng = lm.LogBilinear(400), np.random.default_rng(5)
    model.begin(rng.integers(1, 50, 400))
    learner, calls, drawn = lm.Learner(model, 3), [], []
    old = [p.copy() for p in model.parameters()]
    before, after = rng.integers(0, 400, (300, 2)), np.sort(rng.integers(0, 400, 300))
    weight = rng.integers(1, 4, 300).astype(np.float32)
    monkeypatch.setattr(lm, "sigmoid", lambda x, f=lm.sigmoid: (calls.append(x.shape), f(x))[1])
    monkeypatch.setattr(np, "searchsorted", lambda *a, f=np.searchsorted: (drawn.append(f(*a)), drawn[-1])[1])
    learner.step(before, after, weight)
    assert len(calls) <= 3  # not one for each of 20 classes
    context, target, bias, group, group_bias, place = (p.astype(np.float64) for p in old)
    sums, there = [np.zeros_like(p) for p in (context, target, bias, group, group_bias, place)], np.unique(after // model.size)

    def hold(r, w, back, vectors, biases, share, k, row, true):
        e = w * (1 / (1 + math.exp(-(vectors[row] @ r + biases[row] - math.log(lm.NOISE * share[row])))) - true)
        sums[k][row] += e * r
        sums[k + 1][row] += e
        back += e * vectors[row]

    for b, a, w in zip(before, after, weight, strict=True):
        r, back, own = (context[b] * place).sum(axis=0), np.zeros(lm.DIM), a // model.size
        for row, true in [(own, 1), *((c, 0) for c in drawn[0])]:
            hold(r, w, back, group, group_bias, model.group_share, 3, row, true)
        for row, true in [(a, 1), *((u, 0) for u in drawn[1][list(there).index(own)])]:
            hold(r, w, back, target, bias, model.share, 1, row, true)
        for k, unit in enumerate(b):
            sums[0][unit] += back * place[k]
            sums[5][k] += back * context[unit]
    for p, q, g in zip(old, model.parameters(), sums, strict=True):
        assert np.allclose(q, p - lm.RATE * g / np.sqrt(0.1 + g * g), atol=2e-5)


def test_logits_far_from_nought_are_normalised():
    model = lm.LogBilinear(30)
    model.bias[::7], model.bias[3], model.group_bias[:] = 400, -700, [900, -900, 20, 0, 5]
    every = model.log_probs(np.array([[1, 2]] * 30), np.arange(30))
    assert np.isfinite(every).all() and np.exp(every).sum() == pytest.approx(1, abs=1e-5)
    turned = model.log_probs(np.array([[1, 2]] * 30), np.arange(30)[::-1])
    assert np.allclose(turned[::-1], every)


def test_a_very_long_text_is_scored_whole(spark):
    long = " ".join(f"w{i % 700}" for i in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, "w1 w2"), (3, long)], "doc_id long, text string")
    found = {r.doc_id: r for r in lm.score_corpus(docs, F.col("doc_id") == 3).collect()}
    assert found[3].n_tokens == found[1].n_tokens == 400_001 and found[3].n_known == 400_001
    assert found[3].score == pytest.approx(found[1].score, rel=1e-6) and found[3].score > found[3].base_score


def test_language_model_gains_over_the_unigram_model(spark):
    """Words that follow each other are learnt: held-out texts are likelier than by their counts."""
    rng = np.random.default_rng(2)
    kinds = [[f"{c}{k}" for k in range(30)] for c in "abc"]
    rows = [(i, " ".join(rng.choice(kinds[i % 3], 60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lm.score_corpus(docs, F.col("doc_id") >= 360).where("held_out").collect()
    assert sum(r.score - r.base_score for r in found) / sum(r.n_tokens for r in found) > 0.15
