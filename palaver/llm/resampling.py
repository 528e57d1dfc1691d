"""Importance resampling towards a target, by hashed n-gram features counted and scored in word tries.

Every run of 1 to ``longest`` consecutive words is a feature of its text; its bucket is the CRC32 of
its UTF-8 bytes modulo ``buckets``. A bucket's gain is the logarithm of how much likelier it is in the
target than in the documents; a document's weight is the sum over its features; a Gumbel draw from the
document's id turns weights into a sample without replacement: the highest scores.

Each task holds its words in a trie: a node is a run of words, with the number of times it was
walked and the CRC of its bytes, from which its children's CRC is taken up, so a run's bytes are
hashed once for the whole task and not once for every time it occurs. A trie that reaches its bound of
nodes is added to the task's bucket totals and begun anew, which changes no count. Totals by bucket
are all that leaves a task, and they are merged by a grouping. The second scan walks the same kind of
trie with each node's gain in place of its count.

What the driver gathers is one row for each bucket. The draw takes a share of all documents, so its
ranks are ranks by ranges over the whole table (palaver.operators.ranks), of rows of a few numbers.

Null, empty and word-less texts have no features and weight 0, and are not drawn. A very long text
is walked as any other. Repeated rows are rows of their own; rows that tie in score and id are ranked by
their number of features, then in any order. A null id is drawn as the empty string and comes last among ties. An
empty table gives no rows, an empty target a gain by the documents' counts alone. Only doc_id and text are
read, whatever other columns are called.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.blocks import small_batches
from palaver.operators.ranks import ranked_rows
from palaver.session import cut

#: Fixed by the statement of the query.
BUCKETS, LONGEST, SEED, LEAST_WORDS, SHARE = 10_000, 1, 2024, 20, 10
#: Nodes of a task's trie, and bytes of a text's words that are walked at once.
TRIE_NODES, PIECE = 200_000, 1 << 20

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def pieces(text: bytes, longest: int) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text, a bounded piece at a time, and how many of them begin runs in that piece.

    Words that follow those are the next piece's first, so that runs go over the cut.
    """
    begin, held = 0, []
    while begin < len(text):
        end = begin + PIECE
        if end < len(text):
            gap = _GAP.search(text, end)  # not within a word
            end = gap.end() if gap else len(text)
        held += _WORD.findall(text[begin:end].translate(_LOWER))
        own = len(held) if end >= len(text) else max(0, len(held) - longest + 1)
        yield held, own
        begin, held = end, held[own:]


class WordTrie:
    """Runs of up to ``longest`` words: per node the CRC of its bytes, its number of walks and its gain.

    The first words are in one table; a longer run is found by its parent's node and its last word.
    """

    def __init__(self, longest: int, buckets: int, gains: np.ndarray | None = None):
        self.longest, self.buckets, self.gains = longest, buckets, gains
        self.totals = np.zeros(buckets, np.int64)
        self.clear()

    def clear(self) -> None:
        self.first: dict[bytes, int] = {}
        self.longer: dict[tuple[int, bytes], int] = {}
        self.crc: list[int] = []
        self.count: list[int] = []
        self.gain: list[int] = []

    def add(self, crc: int) -> int:
        self.crc.append(crc)
        self.count.append(0)
        if self.gains is not None:
            self.gain.append(int(self.gains[crc % self.buckets]))
        return len(self.crc) - 1

    def root_child(self, word: bytes) -> int:
        node = self.first.get(word)
        if node is None:
            node = self.first[word] = self.add(zlib.crc32(word))
        return node

    def child(self, node: int, word: bytes) -> int:
        found = self.longer.get((node, word))
        if found is None:
            found = self.longer[node, word] = self.add(zlib.crc32(b" " + word, self.crc[node]))
        return found

    def walked(self, words: list[bytes], own: int) -> Iterator[tuple[int, int]]:
        """The nodes in which runs that begin at the first ``own`` words end, with their times; runs of one word are counted together."""
        for word, times in Counter(words if own == len(words) else words[:own]).items():
            yield self.root_child(word), times
        if self.longest > 1:
            for i in range(own):
                node = self.root_child(words[i])
                for word in words[i + 1 : i + self.longest]:
                    node = self.child(node, word)
                    yield node, 1

    def make_room(self) -> None:
        if len(self.crc) > TRIE_NODES:
            self.flush()

    def count_text(self, text: bytes) -> None:
        for words, own in pieces(text, self.longest):
            self.make_room()
            count = self.count
            for node, times in self.walked(words, own):
                count[node] += times

    def flush(self) -> None:
        """Adds the nodes' counts to the bucket totals and empties the trie."""
        if self.gains is None and self.crc:
            at = np.array(self.crc, np.int64) % self.buckets
            np.add.at(self.totals, at, np.array(self.count, np.int64))
        self.clear()

    def weigh(self, text: bytes) -> tuple[int, int]:
        """Number of words of a text and the sum of its runs' gains."""
        n = total = 0
        for words, own in pieces(text, self.longest):
            self.make_room()
            gain = self.gain
            for node, times in self.walked(words, own):
                total += gain[node] * times
            n += own
        return n, total


def features(n: int, longest: int) -> int:
    """Number of runs of 1 to ``longest`` words of a text of n words."""
    return sum(max(0, n - k) for k in range(longest))


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, one at a time; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py() or b""


def bucket_totals(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, how often features of all texts (text) fall into it."""

    def run(batches):
        trie = WordTrie(longest, buckets)
        for batch in batches:
            for text in texts_of(batch.column(0)):
                trie.count_text(text)
        trie.flush()
        at = np.flatnonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(trie.totals[at])], names=["bucket", "n"])

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: at most ``buckets`` rows of either side come to the driver."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, table in ((s, docs), (t, target)):
        for r in bucket_totals(table, longest, buckets).collect():
            counts[r.bucket] = r.n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of docs (doc_id, text)."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gains), len(gains)

    def run(batches):
        trie = WordTrie(longest, buckets, shared.value)
        for batch in batches:
            n, weights = [], []
            for text in texts_of(batch.column(1)):
                words, weight = trie.weigh(text)
                n.append(words)
                weights.append(weight)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array([features(x, longest) for x in n], pa.int64()), pa.array(weights, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """The seeded draw of an id, in thousandths, rounded down."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, share: int = SHARE) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank is null where it is not drawn.

    ``share`` is in hundredths of the documents of at least ``least_words`` words.
    """
    weighed = weigh(docs, gains_of(docs, target, longest, buckets), longest)
    scored = cut(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    fit = F.col("n_words") >= least_words
    quota = share * scored.where(fit).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    placed = ranked_rows(scored.withColumn("_fit", fit), ["_fit"], order, "_rank")
    rank = F.when(F.col("_fit") & (F.col("_rank") <= quota), F.col("_rank")).cast("long")
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The sample itself: rows of docs whose id was drawn, with their own columns; rows of one id go or stay together."""
    ids = resample(docs, target, **parameters).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_drawn")), "left_semi")


def op13_trie_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_features, weight, score and rank of all documents, resampled towards benchmark.

    Null, empty and word-less texts have no features, weight 0 and no rank; repeated rows are rows of their
    own; an empty table gives no rows.
    """
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, items)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM d) GROUP BY w),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY w),
v AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(w)), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(1, 9)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))) % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
s AS (SELECT b, sum(n)::DOUBLE AS n FROM dw JOIN v USING (w) GROUP BY b), t AS (SELECT b, sum(n)::DOUBLE AS n FROM bw JOIN v USING (w) GROUP BY b),
g AS (SELECT v.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS BIGINT) AS gain
      FROM (SELECT DISTINCT b FROM v) v LEFT JOIN s ON v.b = s.b LEFT JOIN t ON v.b = t.b),
x AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h, w FROM d),
y AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM (SELECT doc_id, unnest(w) AS w FROM d) JOIN v USING (w) JOIN g USING (b) GROUP BY doc_id),
z AS (SELECT x.doc_id, n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM x LEFT JOIN y ON x.doc_id = y.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT z.doc_id, n_features, weight, score, CASE WHEN r.rank <= 10 * r.n // 100 THEN r.rank END AS rank FROM z LEFT JOIN r ON z.doc_id = r.doc_id
"""
