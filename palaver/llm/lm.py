"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

Tokens are the lower-cased words of a text and one end. The commonest tokens of the training rows have a
unit of their own in the neural model, UNITS with the others; every other word goes by its ending, its last
three bytes, to one of UNITS // 8 units, and within that unit has its smoothed share of the corpus. So
no unit stands for more than a small share of all tokens, and the model knows of a rare word how it
ends. The model predicts a vector from the two tokens before as a weighted sum of their vectors.
Units are dealt to classes in their order: the probability of a unit is that of its class times its
own within the class, both learnt by telling the true one from noise drawn from the unigram
distribution, and both normalised when it scores, by matrix products over all classes and all units
of a class. So the probabilities of all words and one unknown word of each ending sum to one after any
context.

What is learnt from. Word counts are those of all training rows over whole texts, made by one
aggregation; the commonest words come out of it. The neural model begins with a pass over FIRST_ROWS
whole rows. Then it learns from every token of every training text: texts become unit numbers, which
are dealt by a hash of the row to parts of about PART_TOKENS tokens, as many as the corpus needs. Each part goes on from the
first pass with its own copy, over its texts in the order of their hashes; equal tokens after
equal contexts are one step with their number as its weight. The copies are averaged, each unit by the
steps that have moved it, and added up in a tree. Parts, order and noise follow from the rows alone, so the model is the
same however the files are split and wherever tasks run, up to the last bits of float sums. What
travels is two bytes a token and the size of the model for each part, so what is learnt from grows with
the corpus and no driver holds it.

The counts of the HEAD commonest words are sent to the executors, a fixed number of them. Every other
word goes by its 64-bit hash to one shuffle in which its training count and the rows that need it
meet: a row for each document and word, so a word's rows are few by construction, and no table of all
words is ever gathered anywhere.

A null text is empty: one end. Repeated rows are rows of their own, as training text too. With no
training rows every token has a base probability of one and the model is uniform; an empty table
gives no rows. Columns of the input other than doc_id and text are not looked at, whatever their names
are. Of words with equal counts the smaller hash is the commoner.
"""

from __future__ import annotations

import copy
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.llm.blocks import NOT_SPACE, Words, bounded_sample, crc_remainder, cut_blocks, map_batches, mix, utf8
from palaver.session import cut

#: Units of the model: tokens of their own, the end among them, and an eighth of them for endings of all other words.
UNITS = 8192
#: Common words whose counts are held on every executor: the highest levels of counts that have so many words in all at most.
HEAD = 50_000
#: Whole rows of the first pass; training tokens that one copy of the model learns from, and those that are sorted at once.
FIRST_ROWS, PART_TOKENS, LEARN_TOKENS = 1000, 4_000_000, 1 << 20
DIM, CONTEXT, NOISE = 16, 2, 16
BATCH, RATE = 4096, 0.05
#: Tokens that are scored together, and those whose logits are made at once; logits that are not exponentiated as they are.
SCORE_TOKENS, LOGIT_ROWS, FAR = 1 << 18, 2048, 60.0
#: Words that are counted together.
COUNT_WORDS = 4_000_000
#: Pieces of the model that are averaged on their own.
PIECES = 64


class Head:
    """The common words: id of a word's hash, or -1."""

    def __init__(self, hashes: np.ndarray, endings: int = 1):
        self.endings = endings  # units of the words that have none of their own
        self.mask = np.uint64((1 << 20) - 1)
        slot = np.full(1 << 20, -1, np.int32)
        at = (hashes & self.mask).astype(np.int64)
        _, first = np.unique(at, return_index=True)  # of two words in one slot the more common one is in the head
        self.hashes = hashes[np.sort(first)]
        slot[(self.hashes & self.mask).astype(np.int64)] = np.arange(len(self.hashes))
        self.slot = slot

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int32)
        found = self.slot[(hashes & self.mask).astype(np.int64)]
        found[self.hashes[found] != hashes] = -1
        return found


class LogBilinear:
    """Vectors of units as context and as target; the first are those of endings, the last is the end.

    Units are dealt to classes in their order, which is that of their counts. The probability of a
    unit is that of its class times that of the unit within the class, both log-bilinear in the same
    predicted vector, so a normaliser is a sum over classes and one over the units of a class.
    """

    def __init__(self, units: int, seed: int = 29):
        rng = np.random.default_rng(seed)
        self.units, self.size = units, max(1, int(np.ceil(np.sqrt(units))))
        self.classes = -(-units // self.size)
        vectors = lambda n: rng.normal(0, 0.1, (n, DIM)).astype(np.float32)
        self.context, self.target, self.group = vectors(units), vectors(units), vectors(self.classes)
        self.place = np.ones((CONTEXT, DIM), np.float32)
        self.bias, self.group_bias = np.zeros(units, np.float32), np.zeros(self.classes, np.float32)
        self.share, self.group_share = np.full(units, 1.0), np.full(self.classes, 1.0)

    def begin(self, counts: np.ndarray, endings: int = 0) -> None:
        """Noise and biases from the units' training counts: the unigram distribution."""
        many = counts + np.where(np.arange(self.units) < endings, 0.5 / max(1, endings), 0.5)
        of = np.arange(self.units) // self.size
        groups = np.bincount(of, weights=many, minlength=self.classes)
        self.share, self.group_share = many / groups[of], groups / groups.sum()
        self.bias[:], self.group_bias[:] = np.log(self.share), np.log(self.group_share)

    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.target, self.bias, self.group, self.group_bias, self.place]

    def predicted(self, before: np.ndarray) -> np.ndarray:
        total = self.context.take(before[:, 0], axis=0) * self.place[0]
        for k in range(1, CONTEXT):
            total += self.context.take(before[:, k], axis=0) * self.place[k]
        return total

    def members(self, c: int) -> slice:
        return slice(c * self.size, min(self.units, (c + 1) * self.size))

    def segments(self, after: np.ndarray):
        """The order of tokens by class, and (class, begin, end) of each class in it."""
        of = (after // self.size).astype(np.uint16)
        order = np.argsort(of, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], np.diff(of[order]) > 0]))
        return order, zip(of[order][begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(after)], strict=True)

    def log_probs(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Normalised natural log-probability of each unit after its context (rows of CONTEXT units)."""
        found = np.empty(len(after))
        groups, units = (np.ascontiguousarray(with_column(*x).T) for x in ((self.group, self.group_bias), (self.target, self.bias)))
        for i in range(0, len(after), SCORE_TOKENS):
            old, own = before[i : i + SCORE_TOKENS], after[i : i + SCORE_TOKENS]
            logs = np.empty(len(own))
            order, parts = self.segments(own)
            for c, a, b in parts:
                of = self.members(c)
                vectors = np.ascontiguousarray(units[:, of])
                for k in range(a, b, LOGIT_ROWS):  # as many as stay in a cache
                    at = order[k : min(b, k + LOGIT_ROWS)]
                    r = with_column(self.predicted(old[at]), 1.0)
                    z = r @ groups
                    logs[at] = z[:, c]
                    logs[at] -= log_sums(z)
                    z = r @ vectors
                    logs[at] += z[np.arange(len(at)), own[at] - of.start]
                    logs[at] -= log_sums(z)
            found[i : i + SCORE_TOKENS] = logs
        return found


def log_sums(z: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of each row's exponentials; z may be overwritten."""
    if z.max() > FAR or z.min() < -FAR:
        top = z.max(axis=1)
        return top + np.log(np.exp(z - top[:, None]).sum(axis=1))
    return np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


class Learner:
    """Noise-contrastive steps of one model, with a rate for each parameter that falls with its gradients.

    A step tells the true class of each token from classes drawn from their unigram distribution, and
    its unit from units of its class drawn likewise; tokens of one class share their noise.
    """

    def __init__(self, model: LogBilinear, seed: int):
        self.model, self.rng = model, np.random.default_rng(seed)
        self.moments = [np.full(p.shape, 0.1, np.float32) for p in model.parameters()]
        self.touched = np.zeros((2, model.units), np.float32)  # steps that move a unit's context, and target, vector
        self.tokens = 0
        self.group_edges, self.edges = np.cumsum(model.group_share), np.cumsum(model.share)
        self.group_shift = np.log(NOISE * model.group_share).astype(np.float32)
        self.shift = np.log(NOISE * model.share).astype(np.float32)

    def learn(self, before: np.ndarray, after: np.ndarray) -> None:
        """Goes once over tokens, in a seeded order; equal ones are taken together."""
        before, after, many = distinct_tokens(before, after)
        order, weight, of = self.rng.permutation(len(after)), many.astype(np.float32), (after // self.model.size).astype(np.uint16)
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            rows = rows[np.argsort(of[rows], kind="stable")]
            self.step(before[rows], after[rows], weight[rows])

    def move(self, k: int, rows: np.ndarray, gradient: np.ndarray) -> None:
        """A step of the given rows of the k-th parameter."""
        s, own = self.moments[k].take(rows, axis=0) + gradient * gradient, self.model.parameters()[k]
        self.moments[k][rows] = s
        own[rows] = own.take(rows, axis=0) - RATE * gradient / np.sqrt(s)

    def step(self, before: np.ndarray, after: np.ndarray, weight: np.ndarray) -> None:
        """before, after and how often they occur, of tokens in the order of their classes."""
        m, rng = self.model, self.rng
        own = after // m.size
        old = [m.context.take(before[:, k], axis=0) for k in range(CONTEXT)]
        r = with_column(sum(x * m.place[k] for k, x in enumerate(old)), 1.0)
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        there, many = own[begin], np.diff(np.concatenate([begin, [len(own)]]))
        # noise: classes for all tokens, and a row of units for each class that is there
        classes = np.minimum(np.searchsorted(self.group_edges, rng.random(NOISE) * self.group_edges[-1]), m.classes - 1)
        low = np.where(there > 0, self.edges[np.maximum(there * m.size - 1, 0)], 0.0)
        high = self.edges[np.minimum((there + 1) * m.size, m.units) - 1]
        drawn = np.minimum(np.searchsorted(self.edges, low[:, None] + rng.random((len(there), NOISE)) * (high - low)[:, None]), m.units - 1)
        # what the tokens of a class are held against: its noise, itself, and the noise of classes
        against = np.empty((len(there), 2 * NOISE + 1, DIM + 1), np.float32)
        against[:, :NOISE] = with_column(m.target[drawn], (m.bias - self.shift)[drawn])
        groups = with_column(m.group, m.group_bias - self.group_shift)
        against[:, NOISE], against[:, NOISE + 1 :] = groups[there], groups[classes]
        parts = list(enumerate(zip(begin.tolist(), (begin + many).tolist(), strict=True)))
        false = np.empty((len(own), against.shape[1]), np.float32)
        for c, (i, j) in parts:  # small products, a class at a time
            np.matmul(r[i:j], against[c].T, out=false[i:j])
        sigmoid(false)
        false[:, NOISE] -= 1
        false *= weight[:, None]
        back, sums = np.empty((len(own), DIM + 1), np.float32), np.empty_like(against)
        for c, (i, j) in parts:
            np.matmul(false[i:j], against[c], out=back[i:j])
            np.matmul(false[i:j].T, r[i:j], out=sums[c])
        back = back[:, :DIM]
        # the true units
        vectors = m.target.take(after, axis=0)
        true = sigmoid(np.einsum("nd,nd->n", r[:, :DIM], vectors) + (m.bias - self.shift)[after])
        true -= 1
        true *= weight
        vectors *= true[:, None]
        back += vectors
        # moves
        for k, of, values in ((3, [there, classes], [sums[:, NOISE], sums[:, NOISE + 1 :].sum(axis=0)]), (1, [after, drawn.ravel()], [r * true[:, None], sums[:, :NOISE].reshape(-1, DIM + 1)])):
            rows, found = row_sums(np.concatenate(of), with_column(np.concatenate(values), 0.0))
            self.move(k, rows, found[:, :DIM])
            self.move(k + 1, rows, found[:, DIM])
        self.touched[1, rows] += 1
        place = np.stack([np.einsum("nd,nd->d", back, x) for x in old])
        rows, found = row_sums(before.T.ravel(), (back * m.place[:, None]).reshape(-1, DIM))
        self.move(0, rows, found)
        self.move(5, np.arange(CONTEXT), place)
        self.touched[0, rows] += 1
        self.tokens += float(weight.sum())


def with_column(rows: np.ndarray, last) -> np.ndarray:
    """rows with one more column at their end."""
    found = np.empty((*rows.shape[:-1], rows.shape[-1] + 1), np.float32)
    found[..., :-1], found[..., -1] = rows, last
    return found


def sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), made in place."""
    np.negative(x, out=x)
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the sum of the values of each: floats, an even number of columns, of which two are added at once as one complex number."""
    order = np.argsort(rows.astype(np.uint16) if rows.max(initial=0) < 1 << 16 else rows, kind="stable")
    ranked = rows[order]
    begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return ranked[begin], np.add.reduceat(values.take(order, axis=0).view(np.complex64), begin, axis=0).view(np.float32)


def endings_of(units: int) -> int:
    return max(1, units // 8)


def endings(words: Words, n: int) -> np.ndarray:
    """The unit, of n, of each word's ending: its last three bytes, or fewer."""
    lengths, key = words.ends - words.starts, np.zeros(len(words.ends), np.uint64)
    for k in range(3):
        key |= np.where(lengths > k, words.data[np.maximum(words.ends - 1 - k, 0)], 0).astype(np.uint64) << np.uint64(8 * k)
    return (mix(key) % np.uint64(n)).astype(np.int64)


def contexts(units: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The CONTEXT units before each token of texts of these lengths; before a text stand ends."""
    before = np.full((len(units), CONTEXT), end, np.int64)
    place = np.arange(len(units)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    for k in range(1, CONTEXT + 1):
        has = np.flatnonzero(place >= k)
        before[has, k - 1] = units[has - k]
    return before


def distinct_tokens(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different tokens with their contexts, and how many are each."""
    keys = after.astype(np.int64) << 32 | before[:, 0] << 16 | before[:, 1]
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    found, many = keys[first], np.diff(np.append(first, len(keys)))
    return np.stack([found >> 16 & 0xFFFF, found & 0xFFFF], axis=1), found >> 32, many


class Tokens:
    """Head ids of the words of a block, and its texts' tokens as units with an end after each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, head: Head, units: int):
        words = Words(data, offsets, NOT_SPACE)
        self.hashes, self.bounds = words.hashes, words.bounds
        self.ids = head.ids(words.hashes)
        self.counts = np.diff(words.bounds)
        first = head.endings
        #: words without a unit of their own
        self.other = (self.ids < 0) | (self.ids >= units - first - 1)
        self.word_units = np.where(self.other, endings(words, first), self.ids + first)
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.ends = words.bounds[1:] + np.arange(len(self.counts))
        self.units = np.zeros(len(owner) + len(self.ends), np.int64)
        self.units[np.arange(len(owner)) + owner] = self.word_units
        self.units[self.ends] = units - 1
        self.before = contexts(self.units, self.counts + 1, units - 1)

    def per_text(self, of_words: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_words)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def word_counts(training: DataFrame) -> DataFrame:
    """word (its hash), its ending and n, over the whole texts of all rows."""

    first = endings_of(UNITS)

    def each(batch):
        data, offsets = utf8(batch.column("text"))
        held, size = [], 0
        for i, j in cut_blocks(offsets):
            words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_SPACE)
            held.append((words.hashes, endings(words, first).astype(np.int32)))
            size += len(words.hashes)
            if size >= COUNT_WORDS or j == len(offsets) - 1:
                hashes, ending = (np.concatenate(x) for x in zip(*held, strict=True))
                word, at, n = np.unique(hashes, return_index=True, return_counts=True)
                yield {"word": word, "ending": ending[at], "n": n}
                held, size = [], 0

    return map_batches(training.select("text"), each, "word long, ending int, n long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def level(n):
    """The count itself up to 1000, and a hundredth of a unit of its logarithm above: counts of any size have few levels."""
    return F.when(n <= 1000, n).otherwise(1000 + F.floor(F.log(n / 1000) * 100)).cast("long")


class Corpus:
    """Counts of the training rows: the head's words, the other words of each ending, all words, kinds of words, and rows."""

    def __init__(self, training: DataFrame):
        table = cut(word_counts(training).withColumn("level", level(F.col("n"))))
        levels, least, found = sorted(table.groupBy("level").count().collect(), reverse=True), None, 0  # some thousands of rows at most
        for r in levels:
            found += r["count"]
            if found > HEAD:
                break
            least = r.level
        common = table.where(F.col("level") >= least).select("word", "ending", "n").collect() if least is not None else []  # HEAD rows at most
        common.sort(key=lambda r: (-r.n, r.word))
        totals = table.agg(F.sum("n").alias("words"), F.count("*").alias("kinds")).first()
        self.words, self.kinds, self.ends = totals.words or 0, totals.kinds, training.count()
        rows = {r.word: r for r in common}
        first = endings_of(UNITS)
        self.head = Head(np.array([r.word for r in common], np.int64).view(np.uint64), first)
        held = [rows[h] for h in self.head.hashes.view(np.int64).tolist()]
        self.counts = np.array([r.n for r in held], np.int64)
        self.units = min(UNITS, first + len(held) + 1)
        self.own = self.units - first - 1  # words with a unit of their own
        self.ending_n, self.ending_kinds = np.zeros(first, np.int64), np.zeros(first, np.int64)
        for r in table.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():  # a row for each ending
            self.ending_n[r.ending], self.ending_kinds[r.ending] = r.n, r.kinds
        for r in held[: self.own]:
            self.ending_n[r.ending] -= r.n
            self.ending_kinds[r.ending] -= 1

    def unit_counts(self) -> np.ndarray:
        return np.concatenate([self.ending_n, self.counts[: self.own], [self.ends]])


def fit(training: DataFrame, corpus: Corpus) -> LogBilinear:
    """The model, learnt from a first sample of whole rows and then from all training rows (text, and what tells them apart)."""
    model = LogBilinear(corpus.units)
    model.begin(corpus.unit_counts(), corpus.head.endings)
    texts = [(r.text or "").encode() for r in bounded_sample(training.select("text"), FIRST_ROWS, F.col("text"), seed=13).collect()]
    learner = Learner(model, 31)
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    for i, j in cut_blocks(offsets, 4 << 20):
        tokens = Tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], corpus.head, corpus.units)
        learner.learn(tokens.before, tokens.units)
    return averaged(model, learn_everywhere(training, corpus, learner)) if texts else model


def learn_everywhere(training: DataFrame, corpus: Corpus, learner: Learner) -> DataFrame:
    """(piece, sums): the pieces of the copies that the parts have learnt, weighted and added up."""
    parts = max(1, -(-(corpus.words + corpus.ends) // PART_TOKENS))
    fans = math.isqrt(parts - 1) + 1
    shared = training.sparkSession.sparkContext.broadcast((corpus.head, learner))

    def numbered(batch):
        head, learner = shared.value
        data, offsets = utf8(batch.column("text"))
        for i, j in cut_blocks(offsets):
            tokens = Tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], head, learner.model.units)
            units = tokens.units.astype(np.uint16)
            ids = [units[a:b].tobytes() for a, b in zip(np.concatenate([[0], tokens.ends[:-1] + 1]), tokens.ends + 1, strict=True)]
            yield {"part": batch.column("part")[i:j], "key": batch.column("key")[i:j], "ids": ids}

    def run(key, table):
        own, part = copy.deepcopy(shared.value[1]), key[0].as_py()
        own.touched[:], own.tokens, own.rng = 0, 0, np.random.default_rng([31, part])
        rows = sorted(zip(table.column("key").to_pylist(), table.column("ids").to_pylist(), strict=True))
        held, size = [], 0
        for n, (_, ids) in enumerate(rows):
            held.append(np.frombuffer(ids, np.uint16))
            size += len(held[-1])
            if size >= LEARN_TOKENS or n == len(rows) - 1:
                units = np.concatenate(held).astype(np.int64)
                own.learn(contexts(units, np.array([len(x) for x in held]), own.model.units - 1), units)
                held, size = [], 0
        sums = [x.tobytes() for x in np.array_split(weighted(own), PIECES)]
        return pa.table({"piece": pa.array(range(PIECES), pa.int32()), "fan": pa.array([part % fans] * PIECES, pa.int32()), "sums": pa.array(sums, pa.binary())})

    def add(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for piece, fan, sums in zip(*(batch.column(c).to_pylist() for c in ("piece", "fan", "sums")), strict=True):
                total[piece, fan] = total.get((piece, fan), 0) + np.frombuffer(sums, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["piece", "fan", "sums"])

    def added(copies, *by):
        return copies.repartition(*map(F.col, by)).sortWithinPartitions("piece", "fan", F.xxhash64("sums")).mapInArrow(add, "piece int, fan int, sums binary")

    key = F.xxhash64(*[F.col(f"`{c}`") for c in training.columns])
    dealt = training.select(F.pmod(key, F.lit(parts)).cast("int").alias("part"), key.alias("key"), "text")
    copies = map_batches(dealt, numbered, "part int, key long, ids binary").groupBy("part").applyInArrow(run, "piece int, fan int, sums binary")
    return added(added(copies, "piece", "fan").withColumn("fan", F.lit(0)), "piece").select("piece", "sums")


def weights_of(learner: Learner) -> list[np.ndarray]:
    """For each parameter, the weight of its rows: the steps that have moved a unit, or the tokens learnt from."""
    return [learner.touched[0], learner.touched[1], learner.touched[1], *[np.full(len(p), float(learner.tokens)) for p in learner.model.parameters()[3:]]]


def weighted(learner: Learner) -> np.ndarray:
    """All parameters times their weights, and the weights, in one row."""
    found = []
    for p, w in zip(learner.model.parameters(), weights_of(learner), strict=True):
        found += [(p.reshape(len(p), -1) * w[:, None].astype(np.float64)).ravel(), w.astype(np.float64)]
    return np.concatenate(found)


def averaged(model: LogBilinear, parts: DataFrame) -> LogBilinear:
    """The model with the weighted mean of its copies; what none of them has moved stays."""
    rows = {r.piece: np.frombuffer(r.sums, np.float64) for r in parts.collect()}  # PIECES rows, the model's size in all
    if not rows:
        return model
    flat, at = np.concatenate([rows[k] for k in sorted(rows)]), 0
    for p in model.parameters():
        total, weight = flat[at : at + p.size].reshape(len(p), -1), flat[at + p.size : at + p.size + len(p)]
        at += p.size + len(p)
        moved = weight > 0
        p.reshape(len(p), -1)[moved] = total[moved] / weight[moved, None]
    return model


def rare_sums(docs: DataFrame, head: Head) -> DataFrame:
    """For each row key with words outside the head: sum of log10(count + 1), and known words."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def each(batch):
        data, offsets = utf8(batch.column("text"))
        keys, held = np.asarray(batch.column("key"), np.int64), np.asarray(batch.column("held_out").to_pylist(), bool)
        for i, j in cut_blocks(offsets):
            words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_SPACE)
            rare = np.flatnonzero(shared.value.ids(words.hashes) < 0)
            owner, hashes = np.searchsorted(words.bounds, rare, "right") - 1 + i, words.hashes[rare]
            order = np.lexsort((hashes, owner))
            owner, hashes = owner[order], hashes[order]
            first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])])[: len(owner)])
            n = np.diff(np.concatenate([first, [len(owner)]]))
            yield {"word": hashes[first], "key": keys[owner[first]], "n": n, "trained": np.where(held[owner[first]], 0, n)}

    rows = map_batches(docs.select("key", "held_out", "text"), each, "word long, key long, n int, trained int")
    counted = rows.withColumn("c", F.sum("trained").over(Window.partitionBy("word")))
    return counted.groupBy("key").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))


def scored(docs: DataFrame, corpus: Corpus, model: LogBilinear) -> DataFrame:
    """doc_id, held_out, key and what the head and the model give for every row."""
    below = np.log10(corpus.ending_n + corpus.ending_kinds + 1.0)  # of the share of a word in its ending
    shared = docs.sparkSession.sparkContext.broadcast((corpus.head, model, np.log10(corpus.counts + 1.0), corpus.counts > 0, float(np.log10(corpus.ends + 1.0)), corpus.ends > 0, below))

    def each(batch):
        head, model, logs, seen, end_log, end_seen, below = shared.value
        data, offsets = utf8(batch.column("text"))
        out = {k: [] for k in ("n_tokens", "head_known", "head_log", "other_log", "model_log")}
        for i, j in cut_blocks(offsets):
            tokens = Tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], head, model.units)
            inside = tokens.ids >= 0
            log_c = np.where(inside, logs[tokens.ids] if len(logs) else 0.0, 0.0)
            out["n_tokens"].append(tokens.counts + 1)
            out["head_known"].append(tokens.per_text(inside & (seen[tokens.ids] if len(seen) else False)) + int(end_seen))
            out["head_log"].append(tokens.per_text(log_c) + end_log)
            out["other_log"].append(tokens.per_text(np.where(tokens.other, log_c - below[np.minimum(tokens.word_units, len(below) - 1)], 0.0)))
            probs = np.concatenate([[0.0], np.cumsum(model.log_probs(tokens.before, tokens.units))]) / np.log(10)
            out["model_log"].append(np.diff(probs[np.concatenate([[0], tokens.ends + 1])]))
        yield {c: batch.column(c) for c in ("doc_id", "held_out", "key")} | {k: np.concatenate(v) if v else [] for k, v in out.items()}

    return map_batches(docs, each, "doc_id long, held_out boolean, key long, n_tokens long, head_known long, head_log double, other_log double, model_log double")


def score_corpus(docs: DataFrame, held_out) -> DataFrame:
    """Scores of every row of docs (doc_id, text), learning from the rows that aren't held out."""
    rows = docs.select("doc_id", held_out.alias("held_out"), "text", F.xxhash64("doc_id", "text").alias("key"))
    training = rows.where("not held_out").select("doc_id", "text")
    corpus = Corpus(training)
    model = fit(training, corpus)
    rare = rare_sums(rows, corpus.head)
    total, kinds = corpus.words + corpus.ends, corpus.kinds + int(corpus.ends > 0)
    joined = scored(rows, corpus, model).join(rare, "key", "left").withColumn("copies", F.count("*").over(Window.partitionBy("key")))
    part = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("copies")
    base = F.col("head_log") + part("rare_log") - F.col("n_tokens") * float(np.log10(total + kinds + 1.0))
    within = F.col("other_log") + part("rare_log")
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("head_known") + part("rare_known")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model_log") + within).alias("score"))


def op8_log_bilinear_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability by the model) of all documents.

    A null or empty text is one end; a very long text is whole, in blocks; repeated rows give repeated rows;
    an empty table gives no rows.
    """
    return score_corpus(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), crc_remainder("doc_id", 7) == 2)
