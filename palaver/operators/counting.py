"""Words of texts counted by document and by recording, in one pass over the texts.

A task takes some megabytes of texts at once, as the bytes that Arrow hands it, and counts in arrays: what
leaves it is a row for each document and word, or for each recording and word (``counted``). Where few words are
asked for, one pass gives both (``surveyed``): a row for each document with its counts of those words, and the
vocabulary in bundles of some thousand words, which meet by bucket and are counted in arrays again (``tallied``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are counted at once, and rows that are handed on at once.
TEXT, ROWS = 1 << 25, 1 << 16
#: Buckets of the words of recordings, and how many groups they meet in for each partition of the texts (all BUCKETS at most).
BUCKETS, GROUPS = 1024, 8
#: Odd numbers by a byte's place in its word, from which the word's bucket follows.
PLACES = np.random.default_rng(7).integers(0, 1 << 63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of a word: those of a-z and 0-9. The three of a Tamil code point are found by the first two.
KIND = np.zeros(256, np.uint8)
KIND[ord("a") : ord("z") + 1] = KIND[ord("0") : ord("9") + 1] = 1


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-cased texts, those of functions.text.tokenize, and the number of the text that each is in."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    kind = KIND[data]
    lead = np.flatnonzero(data == 0xE0)
    lead = lead[(data[lead + 1] & 0xFE) == 0xAE]  # U+0B80 to U+0BFF
    for i in range(3):
        kind[lead + i] = 2
    new = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[at[:-1][at[:-1] < len(data)]] = True
    runs = np.flatnonzero(new)
    own = kind[runs] > 0
    size = np.diff(np.append(runs, len(data)))[own]
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data[kind > 0]))
    return words, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(runs[own], at)))


def pieces(batch: pa.RecordBatch, most: int):
    """A batch in parts of about ``most`` bytes of text, one text at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def owners_of(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's recording, nulls being values of keys, and the first row of each."""
    owner = np.zeros(len(columns[0]) if columns else 0, np.int64)
    for own in columns:
        own = own.dictionary_encode(null_encoding="encode")
        owner = np.unique(owner * (len(own.dictionary) + 1) + own.indices.to_numpy(), return_inverse=True)[1]
    return owner, np.unique(owner, return_index=True)[1]


def counted(docs: DataFrame, keys: list[str], postings: bool = True, terms: list[str] | None = None) -> DataFrame:
    """Rows keys, term, doc_id, tf, dl and df of documents (keys, doc_id, text; an id is given once in a recording).

    Postings have a term, doc_id, tf and the document's length dl: of all terms, or of these. Without
    ``postings`` a term's row has df instead: the number of its documents in a part of the recording. A row
    without a term has the number of documents in a part of the recording as df, of those that have a text as
    tf, and their length in all as dl. Rows of parts are to be summed.
    """
    wanted = None if terms is None else pa.array(terms, pa.string())
    source = docs.select(*keys, "doc_id", F.lower("text").alias("text"))
    typed = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keys, F.col("text").alias("term"), "doc_id").schema] + ["tf long, dl long, df long"])

    def rows(part, at, term, ids, *numbers):
        named = part.select(keys).take(pa.array(at))
        own = part.column("doc_id").take(pa.array(at)) if ids else pa.nulls(len(at), part.schema.field("doc_id").type)
        numbers = [pa.nulls(len(at), pa.int64()) if n is None else pa.array(n.astype(np.int64)) for n in numbers]
        whole = pa.RecordBatch.from_arrays([*named.columns, pa.nulls(len(at), pa.string()) if term is None else term, own, *numbers], [*keys, "term", "doc_id", "tf", "dl", "df"])
        for i in range(0, len(at), ROWS):
            yield whole.slice(i, ROWS)

    def count(batches):
        for part in (p for b in batches for p in pieces(b, TEXT)):
            words, doc = words_of(part.column("text"))
            length = np.bincount(doc, minlength=part.num_rows)
            coded = words.dictionary_encode()
            vocabulary, code, size = coded.dictionary, coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
            if wanted is not None:
                asked = pc.is_in(vocabulary, value_set=wanted).to_numpy(zero_copy_only=False)[code]
                doc, code = doc[asked], code[asked]
            owner, head = owners_of([part.column(c) for c in keys])
            if postings:
                pairs, tf = np.unique(doc * size + code, return_counts=True)
                at, code = np.divmod(pairs, size)
                yield from rows(part, at, vocabulary.take(pa.array(code)), True, tf, length[at], None)
            else:
                pairs = np.sort(doc * size + code)  # np.unique without counts hashes, which takes twenty times as long
                at, code = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], size)
                group, df = np.unique(owner[at] * size + code, return_counts=True)
                yield from rows(part, head[group // size], vocabulary.take(pa.array(group % size)), False, None, None, df)
            valid = part.column("text").is_valid().to_numpy(zero_copy_only=False)
            yield from rows(part, head, None, False, np.bincount(owner[valid], minlength=len(head)), np.bincount(owner, length), np.bincount(owner))

    return source.mapInArrow(count, typed)


def buckets_of(words: pa.StringArray) -> np.ndarray:
    """A number of 64 bits for each word, none of them empty; the same in every task."""
    words = pa.concat_arrays([words])  # offsets from 0
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    place = np.arange(len(data)) - np.repeat(at[:-1] - at[0], np.diff(at))
    return np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * PLACES[place % len(PLACES)], at[:-1] - at[0]) if len(words) else np.zeros(0, np.uint64)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def surveyed(docs: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """Rows of documents (keys, doc_id, text; an id is given once in a recording), and rows of bundles, which have a bucket.

    A document's row has its length dl, null without a text, and of those ``terms`` that it has the numbers
    (places in ``terms``) and tf. A bundle has words of a part of the texts, joined by spaces, with the df of each; they stand by
    recording, of whose keys (owners) each has sizes many. A word of a recording has one bucket, the same in all parts.
    """
    wanted = pa.array(terms, pa.string())
    source = docs.select(*keys, "doc_id", F.lower("text").alias("text"), F.xxhash64(*keys).alias("dealt"))
    named = {f.name: f.dataType.simpleString() for f in source.schema}
    own = ", ".join(f"`{c}` {named[c]}" for c in [*keys, "doc_id"])
    typed = f"{own}, dl long, numbers array<int>, tf array<int>, bucket int, owners array<struct<{', '.join(f'`{c}`: {named[c]}' for c in keys)}>>, sizes array<int>, words string, df array<int>"
    layout = [*keys, "doc_id", "dl", "numbers", "tf", "bucket", "owners", "sizes", "words", "df"]
    ints = pa.list_(pa.int32())

    def survey(batches):
        for part in (p for b in batches for p in pieces(b, TEXT)):
            owner, head = owners_of([part.column(c) for c in keys])
            whose = pa.StructArray.from_arrays([part.column(c).take(pa.array(head)) for c in keys], keys)
            words, doc = words_of(part.column("text"))
            coded = words.dictionary_encode()
            vocabulary, code, size = coded.dictionary, coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
            # the documents, in the order of ``terms`` by each
            number = pc.fill_null(pc.index_in(vocabulary, value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
            found, tf = np.unique(doc[number >= 0] * max(len(wanted), 1) + number[number >= 0], return_counts=True)
            at, number = np.divmod(found, max(len(wanted), 1))
            ends = np.searchsorted(at, np.arange(part.num_rows + 1))
            length = pa.array(np.bincount(doc, minlength=part.num_rows), mask=part.column("text").is_null().to_numpy(zero_copy_only=False))
            n = part.num_rows
            rows = pa.RecordBatch.from_arrays([*[part.column(c) for c in [*keys, "doc_id"]], length, lists(number, ends), lists(tf, ends), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(whose.type)), pa.nulls(n, ints), pa.nulls(n, pa.string()), pa.nulls(n, ints)], layout)
            yield from (rows.slice(i, ROWS) for i in range(0, n, ROWS))
            if not len(words):
                continue
            # the vocabulary: every document's words once, then every recording's, by bucket and recording
            pairs = np.sort(doc * size + code)
            at, code = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], size)
            pairs, df = np.unique(owner[at] * size + code, return_counts=True)
            group, code = np.divmod(pairs, size)
            spread = buckets_of(vocabulary)[code] + part.column("dealt").to_numpy().view(np.uint64)[head][group]
            bucket = ((spread * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % BUCKETS
            run = bucket * len(head) + group
            order = np.argsort(run, kind="stable")
            runs, first, sizes = np.unique(run[order], return_index=True, return_counts=True)
            used, start = np.unique(runs // len(head), return_index=True)
            start = np.append(start, len(runs))
            ends, n = np.append(first, len(order))[start], len(used)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), vocabulary.take(pa.array(code[order]))), " ")
            owners = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), whose.take(pa.array(runs % len(head))))
            none = [pa.nulls(n, part.schema.field(c).type) for c in [*keys, "doc_id"]]
            rows = pa.RecordBatch.from_arrays([*none, pa.nulls(n, pa.int64()), pa.nulls(n, ints), pa.nulls(n, ints), pa.array(used.astype(np.int32)), owners, lists(sizes, start), joined, lists(df[order], ends)], layout)
            yield from (rows.slice(i, ROWS) for i in range(0, n, ROWS))

    return source.mapInArrow(survey, typed)


def tallied(bundles: DataFrame, keys: list[str], terms: list[str], groups: int) -> DataFrame:
    """keys, term, df and times from bundles (of ``surveyed``): of the words among ``terms`` the number as term, with its df; of the others how many have the same df, by group.

    BUCKETS are joined to ``groups`` of about equal size.
    """
    wanted = pa.array(terms, pa.string())
    fields = {f.name: f.dataType.simpleString() for f in bundles.select(*keys).schema}

    def tally(table):
        flat = lambda c: pa.concat_arrays(table.column(c).chunks).flatten()
        owners, sizes, df = flat("owners"), flat("sizes").to_numpy(), flat("df").to_numpy()
        owner, head = owners_of([owners.field(c) for c in keys])
        coded = pc.split_pattern(pa.concat_arrays(table.column("words").chunks), " ").flatten().dictionary_encode()
        size = len(coded.dictionary)
        pairs, which = np.unique(np.repeat(owner, sizes) * size + coded.indices.to_numpy(), return_inverse=True)
        n = np.bincount(which, df).astype(np.int64)
        group, code = np.divmod(pairs, size)
        number = pc.fill_null(pc.index_in(coded.dictionary, value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
        asked, span = number >= 0, n.max() + 1
        same, times = np.unique(group[~asked] * span + n[~asked], return_counts=True)
        of = head[np.concatenate([group[asked], same // span])]
        term = np.concatenate([number[asked], np.full(len(same), -1)])
        columns = [owners.field(c).take(pa.array(of)) for c in keys]
        counts = [np.concatenate([n[asked], same % span]), np.concatenate([np.ones(asked.sum(), np.int64), times])]
        return pa.Table.from_arrays([*columns, pa.array(term.astype(np.int32), mask=term < 0), *map(pa.array, counts)], [*keys, "term", "df", "times"])

    own = ", ".join(f"`{c}` {t}" for c, t in fields.items())
    met = bundles.select((F.col("bucket") % groups).alias("met"), "owners", "sizes", "words", "df").groupBy("met")
    return met.applyInArrow(tally, f"{own}, term int, df long, times long")
