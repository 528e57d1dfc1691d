"""Benchmark decontamination as a prefix-filtered set join.

A window of ``width`` consecutive item words (a shorter item is one window) must be contained whole
in a document, so its prefix is a single shingle: shingles are ordered by how rare they are in the
corpus, and a window is looked up by its rarest one alone. A window whose rarest shingle occurs
nowhere is dropped without a look-up. Where the shingle occurs, its place in the window fixes where
the window would begin; positional and length bounds discard places that would leave the document,
and the exact words are compared over the item-sized window that is left.

The corpus is only ever scanned: once to count the items' shingles, once to match. The items are
made distinct and taken in blocks of a fixed number of bytes; a block's index is the only thing sent to the executors,
so its size does not depend on either table. With several blocks, the scan is repeated per block and
each pass adds its spans and items to the row, with no shuffle and no join.

Null and word-less texts have no words and no hits. Repeated rows give repeated rows. A null item id
counts as the empty string; repeated item ids count once. Windows that tie in rarity are looked up by their first
shingle; which one does not change what is found. A very long text is a block of its own. Columns of the input named
_words, _spans or _items are replaced, others kept. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.blocks import ALNUM, Words, cut_blocks, map_batches, runs_hash, utf8
from palaver.session import cut

#: Words of a shingle; a shorter window is one shingle.
SHINGLE = 3
#: UTF-8 bytes of items whose index is held at once.
ITEM_BLOCK_BYTES = 8 << 20


class Windows:
    """The windows of a block of items, and the shingles by which they are looked up."""

    def __init__(self, ids: list[str], texts: list[str], width: int):
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        words = Words(data, offsets, ALNUM)
        self.ids, found = ids, {}
        for i in range(len(ids)):
            a, b = int(words.bounds[i]), int(words.bounds[i + 1])
            size = min(width, b - a)
            for s in range(a, b - size + 1) if size else ():
                found.setdefault(words.text(s, s + size), (s, size, set()))[2].add(i)
        self.texts = list(found)
        self.items = [sorted(x[2]) for x in found.values()]
        self.sizes = np.array([x[1] for x in found.values()], np.int64)
        begins = np.array([x[0] for x in found.values()], np.int64)
        self.full = np.zeros(len(begins), np.uint64)
        self.lengths = [int(n) for n in np.unique(self.sizes)]
        for n in self.lengths:
            at = self.sizes == n
            self.full[at] = runs_hash(words.hashes, n)[begins[at]]
        #: per shingle width: the shingles of its windows
        self.shingles, self._rows = {}, {}
        for k in sorted({min(SHINGLE, n) for n in self.lengths}):
            at = np.flatnonzero(np.minimum(self.sizes, SHINGLE) == k)
            runs = runs_hash(words.hashes, k)
            places = self.sizes[at] - k + 1
            window = np.repeat(at, places)
            place = np.arange(len(window)) - np.repeat(np.cumsum(places) - places, places)
            marks = runs[begins[window] + place]
            self.shingles[k], inverse = np.unique(marks, return_inverse=True)
            self._rows[k] = (window, place, inverse)
        self.entries = {}

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Keeps for each window the place of its rarest shingle; windows that can't occur go."""
        for k, (window, place, inverse) in self._rows.items():
            rank = np.lexsort((place, self.shingles[k][inverse], counts[k][inverse], window))
            _, first = np.unique(window[rank], return_index=True)
            chosen = rank[first]
            chosen = chosen[counts[k][inverse[chosen]] > 0]
            chosen = chosen[np.argsort(inverse[chosen], kind="stable")]
            marks, begin, many = np.unique(self.shingles[k][inverse[chosen]], return_index=True, return_counts=True)
            self.entries[k] = (Lookup(marks), begin, many, window[chosen], place[chosen])
        del self._rows


class Lookup:
    """Positions of hashes in a sorted array, behind a bitmap that lets few others through."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.mask = np.uint64((1 << max(12, int(8 * max(1, len(marks))).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[(marks & self.mask).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into hashes and into the sorted array of all that match."""
        if not len(self.marks):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[(hashes & self.mask).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.marks, hashes[at]), len(self.marks) - 1)
        same = self.marks[where] == hashes[at]
        return at[same], where[same]


def item_blocks(items: DataFrame, width: int) -> Iterator[Windows]:
    """The items' windows, a bounded block at a time."""
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    parts = max(1, -(-int(size) // ITEM_BLOCK_BYTES))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).collect() if parts > 1 else items.collect()
        if rows:
            rows.sort()
            yield Windows([r.id for r in rows], [r.text for r in rows], width)


def shingle_counts(docs: DataFrame, index: Windows) -> dict[int, np.ndarray]:
    """How often each of the block's shingles occurs in the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast({k: Lookup(v) for k, v in index.shingles.items()})

    def each(batch):
        sums = {k: np.zeros(len(x.marks), np.int64) for k, x in shared.value.items()}
        data, offsets = utf8(batch.column("text"))
        for i, j in cut_blocks(offsets):
            words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
            for k, lookup in shared.value.items():  # runs over two texts only add to a count
                _, where = lookup.find(runs_hash(words.hashes, k))
                sums[k] += np.bincount(where, minlength=len(sums[k]))
        for k, x in sums.items():
            at = np.flatnonzero(x)
            yield {"k": np.full(len(at), k), "at": at, "n": x[at]}

    counted = map_batches(docs.select("text"), each, "k int, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n"))
    counts = {k: np.zeros(len(v), np.int64) for k, v in index.shingles.items()}
    for row in counted.collect():  # at most one row for each shingle of the block
        counts[row.k][row.at] = row.n
    return counts


def matches(words: Words, index: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Window numbers and first words of all occurrences in a block of texts."""
    full, found_w, found_s = {}, [], []
    for k, (lookup, begin, many, window, place) in index.entries.items():
        at, mark = lookup.find(runs_hash(words.hashes, k))
        if not len(at):
            continue
        times = many[mark]
        entry = np.repeat(begin[mark] - np.cumsum(times) + times, times) + np.arange(times.sum())
        w = window[entry]
        start = np.repeat(at, times) - place[entry]
        owner = np.searchsorted(words.bounds, np.repeat(at, times), "right") - 1
        inside = (start >= words.bounds[owner]) & (start + index.sizes[w] <= words.bounds[owner + 1])
        w, start = w[inside], start[inside]
        same = np.zeros(len(w), bool)
        for n in np.unique(index.sizes[w]):
            if n not in full:
                full[n] = runs_hash(words.hashes, int(n))
            of = index.sizes[w] == n
            same[of] = full[n][start[of]] == index.full[w[of]]
        w, start = w[same], start[same]
        exact = np.fromiter((exactly(words, int(s), int(index.sizes[x]), index.texts[x]) for x, s in zip(w, start, strict=True)), bool, len(w))
        found_w.append(w[exact])
        found_s.append(start[exact])
    if not found_w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_w), np.concatenate(found_s)


def exactly(words: Words, s: int, n: int, text: bytes) -> bool:
    raw = words.data[words.starts[s] : words.ends[s + n - 1]].tobytes()
    return raw == text or words.text(s, s + n) == text


def scan(docs: DataFrame, index: Windows) -> DataFrame:
    """docs with _words, and this block's hits added to _spans (pairs of word numbers) and _items."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    again = "_spans" in docs.columns
    kept = [c for c in docs.columns if c not in ("_words", "_spans", "_items")]
    body = docs.select(*[f"`{c}`" for c in kept]).schema
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in body] + ["_words long, _spans binary, _items array<string>"])
    text_at = kept.index("text")

    def each(batch):
        index = shared.value
        data, offsets = utf8(batch.column(text_at))
        counts, spans, items = [], [], []
        for i, j in cut_blocks(offsets):
            words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
            counts.append(np.diff(words.bounds))
            own = [([], set()) for _ in range(j - i)]
            window, start = matches(words, index)
            owner = np.searchsorted(words.bounds, start, "right") - 1
            for w, s, o in zip(window.tolist(), (start - words.bounds[owner]).tolist(), owner.tolist(), strict=True):
                own[o][0].append((s, s + int(index.sizes[w])))
                own[o][1].update(index.items[w])
            spans += [merged(x) for x, _ in own]
            items += [sorted({index.ids[y] for y in x}) for _, x in own]
        if again:
            spans = [merged([tuple(x) for x in np.frombuffer(old + new, np.int64).reshape(-1, 2).tolist()]) if old and new else old or new for old, new in zip(batch.column("_spans").to_pylist(), spans, strict=True)]
            items = [sorted({*old, *new}) for old, new in zip(batch.column("_items").to_pylist(), items, strict=True)]
        yield {c: batch.column(n) for n, c in enumerate(kept)} | {"_words": np.concatenate(counts) if counts else [], "_spans": spans, "_items": items}

    return map_batches(docs, each, schema)


def merged(spans: list[tuple[int, int]]) -> bytes:
    """Sorted disjoint spans as packed integers."""
    out: list[list[int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out, np.int64).tobytes()


def mark(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """docs (with a text column) with _words, _spans and _items for items (item_id, text)."""
    docs, made = docs.drop("_words", "_spans", "_items"), None
    for index in item_blocks(items, width):
        index.order(shingle_counts(docs, index))
        made = scan(docs if made is None else cut(made), index)
    if made is None:  # no item has a word
        index = Windows([], [], width)
        index.order({})
        made = scan(docs, index)
    return made


def clean(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The documents that contain no window of any item, with their own columns."""
    own = docs.toDF(*[f"c{i}" if c != "text" else c for i, c in enumerate(docs.columns)])
    kept = mark(own, items, width).where(F.length("_spans") == 0)
    return kept.select(*[F.col(a).alias(b) for a, b in zip(own.columns, docs.columns, strict=True)])


def report(marked: DataFrame) -> DataFrame:
    """The counts of each row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def each(batch):
        spans = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in batch.column("_spans").to_pylist()]
        items = batch.column("_items").to_pylist()
        hit = [int((x[:, 1] - x[:, 0]).sum()) for x in spans]
        return {"doc_id": batch.column("doc_id"), "n_words": batch.column("_words"), "n_hit": hit, "n_items": [len(x) for x in items], "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], "contaminated": [x > 0 for x in hit]}

    return map_batches(marked, each, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def op2_prefix_filtered_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of all documents, for windows of ten words.

    Null and word-less texts have no words and no hits; repeated rows give repeated rows; an empty
    table gives no rows, and an empty benchmark no hits.
    """
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return report(mark(docs, spark.read.parquet(f"{folder}/benchmark.parquet")))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_aggregate(list_slice(w, i, i + least(10, len(w)) - 1), 'string_agg', ' ') AS t
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ') AS t
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""
