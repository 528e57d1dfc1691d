"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is read as words, each with two inputs: a row of a word table and the mean of hashed
character-trigram rows, so unseen and altered words still have a meaning. Two gated recurrent
networks run over windows of WINDOW words that begin every STRIDE words, one forwards and one
backwards; attention pools the states of a window into one vector and a logistic unit scores it. A
text's score is that of its highest window: a passage counts the same wherever it stands and however
long the text is. All windows of the whole text are scored.

Labels are learnt from a bounded sample of the allowed rows (TRAIN_ROWS of each class), each whole; a
text is learnt by the one of all its windows that scores highest at the time. The word table begins at
the smoothed log-odds of a word between the two classes of the sample; words of fewer than LEAST_DOCS
of its texts have no row and are known by their trigrams alone. Every fifth text of the sample
is not learnt from: the final scale is fitted on those, to the share of toxic rows among all labelled
ones. Null, empty and word-less texts have one empty
window, whose score is learnt like any other. With labels of one class only, that share is every
text's score. Equal texts have equal scores, ties among windows go to the first; an empty table gives
no rows; columns of the input other than the text are kept as they are, one named toxicity is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.blocks import ALNUM, Words, bounded_sample, crc_remainder, cut_blocks, utf8, with_computed
from palaver.llm.lm import Head

WINDOW, STRIDE = 48, 32
HIDDEN = 6
WORD_DIM, CHAR_DIM = 3, 3
CHAR_ROWS = 1 << 14
#: Bound of the training sample: whole rows of each class.
TRAIN_ROWS = 1500
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: A small sample is gone over more often, for so many steps at least.
LEAST_STEPS = 120
LEAST_DOCS = 4
#: Texts that the smoothed log-odds of a word are drawn to even by, and the slower rate of the word table.
SMOOTH, WORD_RATE = 12, 0.1
#: Share by which the network's tables shrink in each step, in units of the rate.
DECAY = 0.02
#: Scores at or above it predict a toxic text.
THRESHOLD = 0.3


class Inputs:
    """Word and trigram rows of every word of a block of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, known: Head):
        words = Words(data, offsets, ALNUM)
        self.bounds = words.bounds
        self.word = known.ids(words.hashes)  # -1, the last row of the word table, for others
        low = words.data.astype(np.uint32)
        before, after = np.zeros_like(low), np.zeros_like(low)
        before[1:], after[:-1] = low[:-1], low[1:]
        inside = ALNUM[words.data]
        before[~np.concatenate([[False], inside[:-1]])] = 1
        after[~np.concatenate([inside[1:], [False]])] = 1
        gram = (before * np.uint32(0x9E3779B1) ^ low * np.uint32(0x85EBCA77) ^ after * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        self.gram = (gram >> np.uint32(18)).astype(np.int64)[inside]
        self.lengths = words.ends - words.starts
        self.text = words.text

    def heads(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and first word of every window of texts of so many words; each text has one at least."""
    many = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(counts)), many)
    return owner, STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedNetwork:
    def __init__(self, known: Head, seed: int = 17):
        self.known = known
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.words = normal(len(known.hashes) + 1, WORD_DIM, scale=0.05)
        self.chars = normal(CHAR_ROWS, CHAR_DIM, scale=0.3)
        self.inside = normal(2, d, 3 * h, scale=0.4)
        self.state = normal(2, h, 3 * h, scale=0.3)
        self.bias = np.zeros((2, 3 * h), np.float32)
        self.look = normal(2 * h, scale=0.5)
        self.out = normal(2 * h, scale=0.5)
        self.last = np.full(1, -2, np.float32)
        self.scale = (1.0, 0.0)
        # training begins where the first unit of each direction follows the words' log-odds and draws attention
        self.inside[:, 0, 2 * h] = 1
        self.look[[0, h]] = 2
        self.out[[0, h]] = 2

    def parameters(self) -> list[np.ndarray]:
        return [self.words, self.chars, self.inside, self.state, self.bias, self.look, self.out, self.last]

    def inputs(self, data: np.ndarray, offsets: np.ndarray) -> Inputs:
        return Inputs(data, offsets, self.known)

    def gates(self, inputs: Inputs) -> np.ndarray:
        """What every word adds to the gates of both directions; a last row stands for no word."""
        x = np.zeros((len(inputs.word) + 1, WORD_DIM + CHAR_DIM), np.float32)
        x[:-1, :WORD_DIM] = self.words[inputs.word]
        if len(inputs.word):
            x[:-1, WORD_DIM:] = np.add.reduceat(self.chars[inputs.gram], inputs.heads(), axis=0) / inputs.lengths[:, None]
        return x

    def run(self, x: np.ndarray, index: np.ndarray, keep: bool = False):
        """States of both directions over windows of rows of x; index is windows x WINDOW, -1 for none."""
        n, h = len(index), HIDDEN
        live = (index >= 0).astype(np.float32)
        states = np.zeros((2, WINDOW, n, h), np.float32)
        kept = []
        for way in (0, 1):
            into = x @ self.inside[way] + self.bias[way]
            s = np.zeros((n, h), np.float32)
            order = range(WINDOW) if way == 0 else range(WINDOW - 1, -1, -1)
            for t in order:
                a = into[index[:, t]]
                gates = sigmoid(a[:, : 2 * h] + s @ self.state[way][:, : 2 * h])
                u, r = gates[:, :h], gates[:, h:]
                c = np.tanh(a[:, 2 * h :] + (r * s) @ self.state[way][:, 2 * h :])
                m = live[:, t, None] * u
                if keep:
                    kept.append((way, t, s, u, r, c))
                s = s + m * (c - s)
                states[way, t] = s
        return states, live, kept

    def pool(self, states: np.ndarray, live: np.ndarray):
        """Attention over the steps: pooled states, weights and logits."""
        h = HIDDEN
        e = states[0] @ self.look[:h] + states[1] @ self.look[h:]
        e = np.where(live.T > 0, e, -1e9)
        e = np.exp(e - e.max(axis=0))
        w = e / e.sum(axis=0)
        both = np.concatenate([(w[..., None] * states[k]).sum(axis=0) for k in (0, 1)], axis=1)
        return both, w, both @ self.out + self.last

    def logits(self, x: np.ndarray, index: np.ndarray) -> np.ndarray:
        states, live, _ = self.run(x, index)
        return self.pool(states, live)[2]

    def gradients(self, inputs: Inputs, x: np.ndarray, index: np.ndarray, target: np.ndarray, weight: np.ndarray):
        h = HIDDEN
        states, live, kept = self.run(x, index, keep=True)
        both, w, z = self.pool(states, live)
        d = ((sigmoid(z) - target) * weight / weight.sum()).astype(np.float32)
        g_out, g_last = both.T @ d, d.sum(keepdims=True)
        d_both = d[:, None] * self.out
        score = np.stack([(states[k] * d_both[None, :, k * h : (k + 1) * h]).sum(-1) for k in (0, 1)]).sum(0)
        d_e = w * (score - (w * score).sum(axis=0)) * live.T
        g_look = np.concatenate([np.einsum("tn,tnh->h", d_e, states[k]) for k in (0, 1)])
        g_inside, g_state, g_bias = (np.zeros_like(p) for p in (self.inside, self.state, self.bias))
        d_x = np.zeros_like(x)
        d_s = None
        for way, t, s, u, r, c in reversed(kept):
            if d_s is None or (t == (WINDOW - 1 if way == 0 else 0)):
                d_s = np.zeros_like(s)
            own = slice(way * h, (way + 1) * h)
            d_s = d_s + w[t][:, None] * d_both[:, own] + d_e[t][:, None] * self.look[own]
            m = live[:, t, None]
            d_u = d_s * m * (c - s) * u * (1 - u)
            d_c = d_s * m * u * (1 - c * c)
            d_rs = d_c @ self.state[way][:, 2 * h :].T
            d_r = d_rs * s * r * (1 - r)
            d_gate = np.concatenate([d_u, d_r, d_c], axis=1)
            g_state[way][:, : 2 * h] += s.T @ d_gate[:, : 2 * h]
            g_state[way][:, 2 * h :] += (r * s).T @ d_c
            g_bias[way] += d_gate.sum(0)
            into = x[index[:, t]]
            g_inside[way] += into.T @ d_gate
            np.add.at(d_x, index[:, t], d_gate @ self.inside[way].T)
            d_s = d_s * (1 - m * u) + d_rs * r + d_gate[:, : 2 * h] @ self.state[way][:, : 2 * h].T
        g_words, g_chars = np.zeros_like(self.words), np.zeros_like(self.chars)
        if len(inputs.word):
            np.add.at(g_words, inputs.word, d_x[:-1, :WORD_DIM])
            np.add.at(g_chars, inputs.gram, np.repeat(d_x[:-1, WORD_DIM:] / inputs.lengths[:, None], inputs.lengths, axis=0))
        return [g_words, g_chars, g_inside, g_state, g_bias, g_look.astype(np.float32), g_out.astype(np.float32), g_last]

    def best_windows(self, inputs: Inputs, lanes: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Highest logit of each text and the word rows of the window that has it."""
        counts = np.diff(inputs.bounds)
        owner, first = windows_of(counts)
        step = np.arange(WINDOW)
        x = self.gates(inputs)
        z = np.empty(len(owner), np.float32)
        rows = lambda of: np.where(first[of, None] + step < counts[owner[of], None], inputs.bounds[owner[of], None] + first[of, None] + step, -1)
        for at in range(0, len(owner), lanes):
            of = np.arange(at, min(at + lanes, len(owner)))
            z[of] = self.logits(x, rows(of))
        rank = np.lexsort((-z, owner))
        top = rank[np.searchsorted(owner, np.arange(len(counts)))]
        return z[top], rows(top)

    def best_passages(self, texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Highest logit of each whole text and the words of the window that has it."""
        data, offsets = block_of(texts)
        tops, found = [], []
        for i, j in cut_blocks(offsets):
            own = self.inputs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            z, index = self.best_windows(own)
            tops.append(z)
            found += [own.text(row[0], row.max() + 1) if row[0] >= 0 else b"" for row in index]
        return np.concatenate(tops), found

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return np.round(sigmoid(a * self.best_windows(self.inputs(data, offsets))[0].astype(np.float64) + b), 6)  # sums differ in the last digits with the batch


def block_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def train(texts: list[bytes], target: np.ndarray, share: float, seed: int = 23) -> GatedNetwork:
    """Trains on whole texts; share is that of toxic rows among all labelled ones."""
    rng, checks = np.random.default_rng(seed), np.arange(len(texts)) % 5 == 4
    rows = np.bincount(target[~checks].astype(np.int64), minlength=2)
    words = Words(*block_of(texts), ALNUM)
    kinds = [np.unique(words.hashes[words.bounds[i] : words.bounds[i + 1]]) for i in range(len(texts))]
    seen = [np.unique(np.concatenate([np.zeros(0, np.uint64), *(kinds[i] for i in np.flatnonzero(~checks & (target == c)))]), return_counts=True) for c in (0, 1)]
    every, many = np.unique(np.concatenate([kinds[i] for i in np.flatnonzero(~checks)]), return_counts=True)
    net = GatedNetwork(Head(every[many >= LEAST_DOCS][np.argsort(-many[many >= LEAST_DOCS], kind="stable")]))
    part, odds = rows / rows.sum(), []
    for c in (0, 1):
        at = np.minimum(np.searchsorted(seen[c][0], net.known.hashes), max(0, len(seen[c][0]) - 1))
        found = np.where(seen[c][0][at] == net.known.hashes, seen[c][1][at], 0) if len(seen[c][0]) else np.zeros(len(net.known.hashes))
        odds.append(np.log((found + SMOOTH * part[c]) / part[c]))
    net.words[:-1, 0] = odds[1] - odds[0]
    net.words[-1] = 0
    tilt = np.where(target == 1, 0.5 / max(rows[1], 1), 0.5 / max(rows[0], 1))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    learnt, step = np.flatnonzero(~checks), 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, len(learnt))))):
        order = learnt[rng.permutation(len(learnt))]
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            own = net.inputs(*block_of(net.best_passages([texts[i] for i in pick])[1]))
            step += 1
            place = np.arange(WINDOW)
            index = np.where(place < np.diff(own.bounds)[:, None], own.bounds[:-1, None] + place, -1)
            grads = net.gradients(own, net.gates(own), index, target[pick], tilt[pick])
            grads[0][-1] = 0
            for k, (p, g, (m, v)) in enumerate(zip(net.parameters(), grads, moments, strict=True)):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (WORD_RATE if k == 0 else 1) * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) + DECAY * p)
    used = np.flatnonzero(checks) if len(set(target[checks])) == 2 else np.arange(len(texts))
    z = net.best_passages([texts[i] for i in used])[0].astype(np.float64)
    many = np.bincount(target[used].astype(np.int64), minlength=2)
    net.scale = calibrated(z, target[used], np.where(target[used] == 1, share / many[1], (1 - share) / many[0]))
    return net


def calibrated(z: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic fit of target on z, by Newton steps with a small ridge."""
    theta = np.array([1.0, 0.0])
    design = np.stack([z, np.ones_like(z)], 1)
    for _ in range(rounds):
        p = sigmoid(design @ theta)
        g = design.T @ (weight * (p - target)) + 1e-3 * (theta - [1.0, 0.0])
        hess = design.T @ (design * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hess, g), -1, 1)
    return max(float(theta[0]), 1e-3), float(theta[1])


def sampled(labels: DataFrame) -> tuple[DataFrame, float]:
    """A bounded sample of labels (doc_id, toxic), TRAIN_ROWS ids of each class, and the share of toxic ones among all.

    Ids are drawn before any text is read, so only the sample's texts are fetched.
    """
    labels = labels.where("toxic in (0, 1)").select("doc_id", "toxic").distinct()
    totals = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    each = [bounded_sample(labels.where(F.col("toxic") == c), TRAIN_ROWS, F.col("doc_id")) for c in (0, 1)]
    return each[0].union(each[1]), totals.get(1, 0) / max(1, sum(totals.values()))


def fit(labelled: DataFrame, share: float | None = None) -> GatedNetwork | float:
    """A network learnt from (text, toxic) rows, or the share of toxic ones where only one class is there.

    At most TRAIN_ROWS rows of each class are learnt from. share is that of toxic rows among all
    labelled ones, if these are a sample of them.
    """
    labelled = labelled.where("toxic in (0, 1)").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    totals = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values())) if share is None else share
    if len(totals) < 2:
        return share
    rows = []
    for c in (0, 1):
        found = bounded_sample(labelled.where(F.col("toxic") == c), TRAIN_ROWS, F.col("text")).select("text")
        rows += [(r.text.encode(), c) for r in found.collect()]
    rows.sort()
    return train([x for x, _ in rows], np.array([c for _, c in rows], np.float32), share)


def score(docs: DataFrame, net: GatedNetwork | float) -> DataFrame:
    """docs (with a text column) with toxicity at their end."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def compute(texts):
        data, offsets = utf8(texts)
        if isinstance(shared.value, float):
            return {"toxicity": np.full(len(offsets) - 1, shared.value)}
        found = [shared.value.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in cut_blocks(offsets)]
        return {"toxicity": np.concatenate(found) if found else []}

    return with_computed(docs, compute, "toxicity double")


def op3_gated_network_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents.

    Null, empty and word-less texts have the score of an empty window; repeated rows the same score;
    labels of one class only give all texts its share; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").where("toxic is not null")
    fold = crc_remainder("doc_id", 4) == 2
    chosen, share = sampled(labels.where(~fold))
    net = fit(docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), share)  # at most 2 * TRAIN_ROWS ids
    scored = score(docs.select("doc_id", fold.alias("held_out"), "text"), net)
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
