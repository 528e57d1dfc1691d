"""Language identification with a byte convolutional network trained in numpy.

A text is read as UTF-8 bytes in fixed-length windows that cover the whole of it. Filters of several
widths slide over the bytes of a window, each filter keeps its largest response, and a softmax over
those gives the window's language probabilities; a text's prediction is the mean over its windows.

The first layer needs no embedding look-ups at run time: a filter of width w is a sum of w table
entries, one for each of its bytes, so one gather from a 256-row table serves every filter.

Training takes the text and language of a bounded sample of labelled rows (TRAIN_ROWS a language,
TRAIN_WINDOWS windows a row, spread over the row's whole text), and nothing else.

Null texts and texts without a letter are ``und`` with score 0. With no labelled row, every text is.
Equal texts have equal predictions, of equally probable languages the first by name; an empty table
gives no rows; columns of the input other than the text are kept as they are, those named as the
results are replaced.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.blocks import bounded_sample, crc_remainder, cut_blocks, map_batches, utf8, with_computed

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 10
EMBED = 6
#: Bounds of the training sample: rows of each language and windows of each row.
TRAIN_ROWS, TRAIN_WINDOWS = 500, 3
#: The rows of all languages that are looked at to fill it.
LOOK_ROWS = 12_000
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Stands for the bytes past a text's end.
PAD = 0


class ByteNetwork:
    def __init__(self, labels: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.embed = rng.normal(0, 0.3, (256, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.out_bias]

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter, and where it is."""
        n, size = windows.shape
        best = np.empty((n, FILTERS * len(WIDTHS)), np.float32)
        where = np.empty(best.shape, np.int64)
        x = self.embed[windows]
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            r = sum(x[:, i : size - w + 1 + i] @ f[i] for i in range(w))
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            where[:, own] = r.argmax(axis=1)
            best[:, own] = np.take_along_axis(r, where[:, None, own], 1)[:, 0]
        return best + self.bias, where

    def train(self, windows: np.ndarray, target: np.ndarray, seed: int = 5) -> None:
        """Cross entropy with balanced classes, by Adam."""
        rng = np.random.default_rng(seed)
        share = np.bincount(target, minlength=len(self.labels)).astype(np.float32)
        weight = (len(target) / np.maximum(share, 1) / len(self.labels))[target]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(target))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                step += 1
                for p, g, (m, v) in zip(self.parameters(), self.gradients(windows[rows], target[rows], weight[rows]), moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def gradients(self, windows, target, weight):
        n = len(windows)
        pooled, where = self.pooled(windows)
        hidden = np.maximum(pooled, 0)
        p = softmax(hidden @ self.out + self.out_bias)
        p[np.arange(n), target] -= 1
        p *= (weight / n)[:, None]
        d = (p @ self.out.T) * (pooled > 0)
        g_embed, g_filters = np.zeros_like(self.embed), []
        rows = np.arange(n)[:, None]
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            g = np.zeros_like(f)
            for i in range(w):
                byte = windows[rows, where[:, own] + i]
                g[i] = np.einsum("nfe,nf->ef", self.embed[byte], d[:, own])
                np.add.at(g_embed, byte, d[:, own][:, :, None] * f[i].T[None])
            g_filters.append(g)
        return [g_embed, *g_filters, d.sum(0), hidden.T @ p, p.sum(0)]

    def tables(self) -> list[np.ndarray]:
        """For each width, the responses of its filters to one byte at each of its places."""
        return [np.stack([self.embed @ f[i] for i in range(f.shape[0])]).astype(np.float32) for f in self.filters]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Scorer:
    """The trained network as tables, for whole texts."""

    def __init__(self, net: ByteNetwork):
        self.labels, self.bias, self.out, self.out_bias = net.labels, net.bias, net.out, net.out_bias
        taps = net.tables()
        #: a pair of bytes is looked up at once: 65536 rows for the first and second place of a filter
        self.pairs = [(t[0][:, None, :] + t[1][None, :, :]).reshape(65536, FILTERS) for t in taps]
        self.rest = [None, taps[1][2], (taps[2][2][:, None, :] + taps[2][3][None, :, :]).reshape(65536, FILTERS)]

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of each fixed-length window."""
        two = (rows[:, :-1].astype(np.int32) << 8) | rows[:, 1:]
        found = []
        for k, (first, rest) in enumerate(zip(self.pairs, self.rest, strict=True)):
            if k == 0:
                r = first[two]
            elif k == 1:
                r = first[two[:, :-1]]
                r += rest[rows[:, 2:]]
            else:
                r = first[two[:, :-2]]
                r += rest[two[:, 2:]]
            found.append(r.max(axis=1))
        return softmax(np.maximum(np.concatenate(found, 1) + self.bias, 0) @ self.out + self.out_bias)

    def texts(self, data: np.ndarray, offsets: np.ndarray, lanes: int = 256) -> np.ndarray:
        """Mean probabilities of each text; a text without bytes has none."""
        sizes = np.diff(offsets)
        many = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), many)
        begin = offsets[:-1][owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
        end = offsets[1:][owner]
        total = np.zeros((len(sizes), len(self.labels)))
        padded = np.concatenate([data, np.full(WINDOW, PAD, np.uint8)])
        step = np.arange(WINDOW)
        for at in range(0, len(owner), lanes):
            of = slice(at, at + lanes)
            rows = padded[begin[of, None] + step]
            short = end[of] - begin[of] < WINDOW
            rows[short] *= begin[of][short, None] + step < end[of][short, None]
            # a window counts as much as the bytes that it has
            np.add.at(total, owner[of], self.windows(rows) * np.minimum(end[of] - begin[of], WINDOW)[:, None])
        return total / np.maximum(sizes, 1)[:, None]


def has_letter(raw: bytes) -> bool:
    """ASCII letters are found at once; otherwise characters are looked at until one is a letter."""
    return any(65 <= b <= 90 or 97 <= b <= 122 for b in raw[:64]) or any(unicodedata.category(c)[0] == "L" for c in raw.decode("utf-8", "replace"))


def training_windows(labelled: DataFrame) -> tuple[np.ndarray, list[str]]:
    """Windows of a bounded, seeded sample of labelled rows (text, lang), taken all over each text."""

    def each(batch):
        data, offsets = utf8(batch.column("text"))
        rows, owner = [], []
        for i in range(len(offsets) - 1):
            starts = np.arange(offsets[i], offsets[i + 1], WINDOW)
            for s in starts[np.linspace(0, len(starts) - 1, min(TRAIN_WINDOWS, len(starts))).astype(int)]:
                rows.append(data[s : min(s + WINDOW, offsets[i + 1])].tobytes().ljust(WINDOW, bytes([PAD])))
                owner.append(i)
        yield {"lang": batch.column("lang").take(pa.array(owner, pa.int64())), "piece": rows}

    shares = labelled.groupBy("lang").count().collect()  # a row for each language
    total = sum(r["count"] for r in shares)
    look = min(1.3 * TRAIN_ROWS, LOOK_ROWS / max(1, len(shares)))  # every language has its part of the sample
    rate = F.create_map(*[F.lit(x) for r in shares for x in (r.lang, min(1.0, look / r["count"]))]) if shares else F.lit(None)
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = labelled.where(draw < rate[F.col("lang")]) if total else labelled
    chosen = bounded_sample(chosen, LOOK_ROWS, F.col("text"), seed=3)
    rows = map_batches(chosen.select("text", "lang"), each, "lang string, piece binary").collect()  # at most LOOK_ROWS * TRAIN_WINDOWS windows
    windows = np.frombuffer(b"".join(bytes(r.piece) for r in rows), np.uint8).reshape(-1, WINDOW)
    return windows, [r.lang for r in rows]


def fit(labelled: DataFrame) -> Scorer | None:
    """A scorer learnt from (text, lang) rows; rows without either are left out."""
    windows, langs = training_windows(labelled.where("text is not null and lang is not null"))
    order = np.lexsort([*windows[:, ::-1].T[:16], np.array(langs, dtype=object).astype(str)]) if langs else []
    if not len(order):
        return None
    labels = sorted(set(langs))
    net = ByteNetwork(labels)
    windows = windows[order]
    net.train(windows, np.array([labels.index(langs[i]) for i in order]))
    return Scorer(net)


def predict(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """docs (with a text column) with lang_pred and lang_score at their end."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def compute(texts):
        data, offsets = utf8(texts)
        langs, scores = [], []
        for i, j in cut_blocks(offsets):
            own = data[offsets[i] : offsets[j]]
            p = shared.value.texts(own, offsets[i : j + 1] - offsets[i]) if shared.value else np.zeros((j - i, 1))
            best = p.argmax(axis=1)
            for k in range(j - i):
                known = shared.value and has_letter(data[offsets[i + k] : offsets[i + k + 1]].tobytes())
                langs.append(shared.value.labels[best[k]] if known else "und")
                scores.append(round(float(min(1.0, p[k, best[k]])), 6) if known else 0.0)
        return {"lang_pred": langs, "lang_score": scores}

    return with_computed(docs, compute, "lang_pred string, lang_score double")


def op1_byte_network_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of all documents.

    Null texts and texts without a letter are ``und`` with score 0; repeated rows are predicted alike;
    an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    fold = crc_remainder("doc_id", 5) == 0
    scorer = fit(docs.where(~fold).select("text", "lang"))
    rows = docs.select("doc_id", fold.alias("held_out"), "text")
    return predict(rows, scorer).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
