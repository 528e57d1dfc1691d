"""Exact-substring dedup over a sparse suffix array, sorted deep-shallow.

A byte goes if a string of ``length`` bytes that covers it also starts somewhere else, in the same
text or another, judged on the input. Strings never cross texts. What follows says bytes, and holds
for the symbols of any Scale.

Which suffixes are sorted. In every window of length - core + 1 consecutive places one anchor is
chosen, the place whose ``core``-byte hash is smallest (the last of equals). The choice depends on
content alone, so every string of ``length`` bytes holds an anchor, and two equal strings hold it at
the same offset. Occurrences of a string therefore meet wherever the suffixes at anchors are
grouped by their core. About one place in a hundred is an anchor; anchors whose core occurs once
cannot be part of a repeat and go first, by a count over hashes.

How repeats are found. An anchor's string of interest reaches length - core bytes to its left and
right. Anchors whose whole neighbourhood recurs (found by hash) are repeats as far as it reaches and
need no sort. The other members of a group are ordered twice by deep-shallow sorting: the suffixes
that begin at the anchors, and the reversed texts before them. Common prefixes of neighbours in both
orders tell which members share o bytes before the core and length - core - o after it: a repeat
that begins o bytes before the anchor.

Groups of unbounded size. Anchors that agree in the whole neighbourhood stand as one from the
start, by counts that are made on the map side. A core that very many different neighbourhoods share
is split: strings that begin at most half-way before the anchor share more bytes after it, the others
more before it, so the group is dealt anew by those bytes, members that then agree in all that is
looked at stand as one again, and so on until a group is small. At a single offset members agree in
the whole string and are counted, not sorted. So no group above GROUP_ROWS is sorted in one task and
no repeat is lost. Equal neighbourhoods are told by two 64-bit hashes, texts by two of them.

Words. The same job over words in place of bytes, each word a symbol of 32 bits of its hash, finds the
passages of over 50 words that occur again. As these symbols are hashes already, members of a group are told apart by
64-bit hashes of their runs at each of the 26 offsets, and are not sorted. They are counted, not removed: a passage of short words has
fewer bytes than a string that goes.

Null texts are empty and lose nothing. Repeated rows and equal texts are repeats of each other. An
empty table gives an empty result. Other columns of the input are not looked at, whatever their names
are. A very long text is read in pieces of PIECE bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.llm.blocks import BASE, NOT_SPACE, Words, _codes, cut_blocks, map_batches, marked_rows, mix, powers, row_map, salts, utf8
from palaver.llm.sorting import deep_shallow
from palaver.session import cut



@dataclass(frozen=True)
class Scale:
    """What strings are made of: ``length`` symbols of ``step`` bytes make a repeat, ``core`` of them are compared by hash."""

    length: int
    core: int
    step: int = 1
    #: whether members of a group are sorted by their symbols; symbols that are hashes themselves are told apart by hashes of their runs
    in_order: bool = True

    @property
    def reach(self) -> int:
        return self.length - self.core


BYTES = Scale(400, 200)
#: Passages of over 50 words, a word being four bytes of its hash.
WORDS = Scale(51, 26, 4, in_order=False)
#: Symbols whose anchors are chosen at once, so that they stay in a cache, and anchors that are hashed at once.
PIECE, HASH_ROWS = 1 << 16, 1 << 10
#: Members of a group that are sorted in one task at most; a larger group is split by content.
GROUP_ROWS = 20_000
#: Members that are sorted together.
SORT_ROWS = 30_000
#: Members of a group that are held against each other.
NEAR = 8
#: Anchors that are looked at together for hot cores, and those of one core that are left together.
FLUSH, HOT = 100_000, 1

_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_inverse_powers = np.ones(1, np.uint64)
_LOW = np.uint64((1 << 24) - 1)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse_powers
    if len(_inverse_powers) < n:
        grown = np.full(max(n, 2 * len(_inverse_powers)), _INVERSE, np.uint64)
        grown[0] = 1
        _inverse_powers = np.cumprod(grown, dtype=np.uint64)
    return _inverse_powers[:n]


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Piece:
    """Prefix sums of a run of symbols: the hash of any part of it in a few operations."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        codes = _codes[data] if data.dtype == np.uint8 else mix(data.astype(np.uint64)) | np.uint64(1)
        np.cumsum(codes * powers(len(data)), out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * inverse_powers(len(self.sums))[start]


def symbols(data: np.ndarray, offsets: np.ndarray, scale: Scale):
    """Blocks of texts of a batch: the first text's number, the symbols (bytes, or 32-bit hashes of words) and the bounds of the texts in them."""
    for i, j in cut_blocks(offsets):
        own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if scale.step == 1:
            yield i, *own
        else:
            words = Words(*own, NOT_SPACE, lower=False)
            yield i, (words.hashes >> np.uint64(32)).astype(np.uint32), words.bounds


def chosen_places(data: np.ndarray, bounds: np.ndarray, wanted: np.ndarray, scale: Scale) -> np.ndarray:
    """The anchors of the wanted texts of a block, in order.

    In each window of a text's places the one whose core has the smallest hash is chosen. The windows of a piece are
    looked at together, and those that are not within a wanted text are left out.
    """
    begins = np.zeros(len(data) + 1, np.int8)  # 1 where a text's windows begin, -1 where they have ended
    own = np.flatnonzero(wanted & (np.diff(bounds) >= scale.length))
    begins[bounds[own]] = 1
    begins[bounds[own + 1] - scale.length + 1] = -1
    windows, found = np.cumsum(begins, dtype=np.int8).view(bool), [np.zeros(0, np.int64)]
    for a in range(0, len(data) - scale.length + 1, PIECE):
        b = min(len(data), a + PIECE + scale.length - 1)
        n = b - a - scale.core + 1
        piece = Piece(data[a:b])
        keys = piece.sums[scale.core :] - piece.sums[: -scale.core]
        keys *= inverse_powers(len(piece.sums))[:n]
        keys &= ~_LOW
        keys |= np.arange(n - 1, -1, -1, dtype=np.int64).view(np.uint64)  # of equals the last is the smallest
        low = lowest(keys, scale.reach + 1)
        low = low[windows[a : a + len(low)]]
        low = low[np.concatenate([[True], low[1:] != low[:-1]])[: len(low)]]
        found.append(a + n - 1 - (low & _LOW).astype(np.int64))
    place = np.concatenate(found)
    return place[np.concatenate([[True], place[1:] != place[:-1]])[: len(place)]]


def anchors(data: np.ndarray, bounds: np.ndarray, wanted: np.ndarray, scale: Scale) -> tuple[np.ndarray, ...]:
    """Text, place, core hash, neighbourhood hash, and symbols to the left and right of each anchor of the wanted texts of a block."""
    wide, reach = scale.core, scale.reach
    at = chosen_places(data, bounds, wanted, scale)
    text = np.searchsorted(bounds, at, "right") - 1
    left, right = np.minimum(at - bounds[text], reach), np.minimum(bounds[text + 1] - at - wide, reach)
    core, whole = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
    for k in range(0, len(at), HASH_ROWS):
        of = slice(k, k + HASH_ROWS)
        a, b = int((at[of] - left[of]).min()), int((at[of] + wide + right[of]).max())
        piece = Piece(data[a:b])
        core[of] = mix(piece.hashes(at[of] - a, at[of] + wide - a))
        whole[of] = mix(mix(piece.hashes(at[of] - left[of] - a, at[of] + wide + right[of] - a)) + (left[of] * 1000 + right[of]).astype(np.uint64))
    return text, at - bounds[text], core, whole, left, right


def anchor_rows(docs: DataFrame, scale: Scale) -> DataFrame:
    """The anchors of every text: core, whole, ta, tb, place, left, right, times and salt.

    Copies of a text within a batch are one with so many times. Of a core that more than HOT anchors
    of a batch have, the first has salt 1 and stays with other batches' anchors, the rest are dealt out.
    """

    def each(batch):
        data, offsets = utf8(batch.column("text"))
        a, b = (np.asarray(batch.column(c), np.int64) for c in ("ta", "tb"))
        times = np.zeros(len(a), np.int64)  # of a text's first copy
        if len(a):
            _, first, many = np.unique(np.stack([a, b]), axis=1, return_index=True, return_counts=True)
            times[first] = many
        out, size = [], 0
        for i, block, bounds in symbols(data, offsets, scale):
            j = i + len(bounds) - 1
            text, place, core, whole, left, right = anchors(block, bounds, times[i:j] > 0, scale)
            out.append((core, whole, a[i + text], b[i + text], place, left, right, times[i + text]))
            size += len(place)
            if size > FLUSH or j == len(a):
                columns = dict(zip(("core", "whole", "ta", "tb", "place", "left", "right", "times"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True))
                yield columns | {"salt": salts(columns["core"], columns["whole"] ^ columns["place"].astype(np.uint64), HOT)}
                out, size = [], 0

    return map_batches(docs.select("ta", "tb", "text"), each, "core long, whole long, ta long, tb long, place long, left int, right int, times long, salt int")


def shared_anchors(docs: DataFrame, scale: Scale) -> DataFrame:
    """The anchors whose core occurs more than once."""
    same = Window.partitionBy("core", F.when(F.col("salt") < 2, 0).otherwise(F.col("salt")))
    rows = anchor_rows(docs, scale).withColumn("m", F.sum("times").over(same))
    return rows.where("m > 1 or salt > 0").drop("m", "salt")


def distinct_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """ta, tb and text of the texts of ids, each once; a row map keeps nearly all others where they are."""
    return marked_rows(docs.select("ta", "tb", "text"), row_map(ids, "ta", "tb"), "ta", "tb").join(ids.select("ta", "tb"), ["ta", "tb"], "left_semi").dropDuplicates(["ta", "tb"])


def neighbourhoods(docs: DataFrame, needed: DataFrame, scale: Scale) -> DataFrame:
    """The bytes around the needed anchors: before (reversed) and from the core on."""
    wanted = cut(needed.groupBy("ta", "tb").agg(F.collect_list(F.struct("core", "place", "left", "right", "copies")).alias("anchors")))

    def each(batch):
        data, offsets = utf8(batch.column("text"))
        a, b = (batch.column(c).to_pylist() for c in ("ta", "tb"))
        step, wide = scale.step, scale.core
        texts = (block[x:y] for _, block, bounds in symbols(data, offsets, scale) for x, y in zip(bounds[:-1], bounds[1:], strict=True))
        for i, (own, text) in enumerate(zip(batch.column("anchors").to_pylist(), texts, strict=True)):
            text = text.tobytes()
            yield {"core": [r["core"] for r in own], "ta": [a[i]] * len(own), "tb": [b[i]] * len(own), "place": [r["place"] for r in own], "copies": [r["copies"] for r in own], "before": [text[step * (r["place"] - r["left"]) : step * r["place"]][::-1] for r in own], "after": [text[step * r["place"] : step * (r["place"] + wide + r["right"])] for r in own]}

    return map_batches(distinct_texts(docs, wanted).join(wanted, ["ta", "tb"]).select("ta", "tb", "text", "anchors"), each, "core long, ta long, tb long, place long, copies long, before binary, after binary")


def split_groups(rows: DataFrame, most: int, scale: Scale) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows with key, low and high, whose groups by key have ``most`` members or fewer; and spans found on the way.

    Offsets low to high of a group's strings are looked at under its key. In a larger group the
    members that agree in all that these offsets reach are repeats of each other and stand as one
    from then on; what is left is parted into halves of its offsets and grouped by the bytes that all
    strings of a half share. At one offset those bytes are the string, so no group is large there.
    """
    wide, reach, step = scale.core, scale.reach, scale.step
    size = lambda c: (F.octet_length(c) / step).cast("int")
    first = lambda c, n: F.substring(c, F.lit(1), (n * step).cast("int"))
    rows = rows.withColumn("key", F.xxhash64("core")).withColumn("low", F.lit(0)).withColumn("high", F.lit(reach))
    done = spans = None
    for _ in range(reach.bit_length() + 2):
        large = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key"))
        if large.isEmpty():
            break
        small = rows.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        before, after = F.least(size("before"), F.col("high")), F.least(size("after") - wide, reach - F.col("low"))
        big = rows.join(large, "key", "left_semi").withColumn("b", before).withColumn("a", after).where(F.col("b") + F.col("a") >= reach)
        seen = [first("before", F.col("b")), first("after", wide + F.col("a"))]
        big = cut(big.withColumn("w0", F.xxhash64("b", "a", *seen)).withColumn("w1", F.xxhash64(*seen, F.lit(1))))
        alike = ["key", "w0", "w1"]
        place = F.struct("ta", "tb", "place", "core", "copies", "low", "high", "before", "after")
        chiefs = cut(big.groupBy(*alike).agg(F.sum("copies").alias("all"), F.count("*").alias("n"), F.min(place).alias("chief")))
        found = big.join(chiefs.where("n > 1").select(*alike), alike, "left_semi").select("ta", "tb", (F.col("place") - F.col("b")).alias("start"), (F.col("place") + wide + F.col("a")).alias("end"))
        spans = found if spans is None else spans.unionByName(found)
        one = chiefs.select("key", "all", "chief.*").drop("copies").withColumnRenamed("all", "copies").where("low < high")
        half = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        parts = one.withColumn("part", F.explode(F.array(F.struct(F.col("low"), half.alias("high")), F.struct((half + 1).alias("low"), F.col("high")))))
        parts = parts.withColumn("low", F.col("part.low")).withColumn("high", F.col("part.high")).drop("part")
        # a string that begins low bytes or more before the core holds so many before and reach - high after it
        parts = parts.where((size("before") >= F.col("low")) & (size("after") - wide >= reach - F.col("high")))
        parts = parts.withColumn("key", F.xxhash64("core", "low", "high", first("before", F.col("low")), first("after", wide + reach - F.col("high"))))
        rows = cut(parts)
    done = rows if done is None else done.unionByName(rows)
    return done, spans if spans is not None else done.select("ta", "tb", F.col("place").alias("start"), F.col("place").alias("end")).limit(0)


def same_cores(group: np.ndarray, after, scale: Scale) -> bool:
    """Whether the members of each group have the bytes of their core in common, which only equal hashes of other bytes can deny."""
    data, offsets = utf8(after)
    cores = data[offsets[:-1, None] + np.arange(scale.core * scale.step)]
    return bool((cores[1:] == cores[:-1])[group[1:] == group[:-1]].all())


def ordered_classes(group: np.ndarray, before, after, scale: Scale):
    """Numbers of the members that agree in so many symbols after the core (r) or before it (l), from both deep-shallow orders."""
    tags, ranks, known = [int(k).to_bytes(8, "big") for k in group], {}, scale.core * scale.step * same_cores(group, after, scale)
    for side, strings, shared in (("r", [t + s[known:] for t, s in zip(tags, after.to_pylist(), strict=True)], 8 + scale.core * scale.step - known), ("l", [t + s for t, s in zip(tags, before.to_pylist(), strict=True)], 8)):
        order, lcp = deep_shallow(strings)
        ranks[side] = (order, np.where(lcp >= shared, (lcp - shared) // scale.step, -1))

    def classes(side: str, depth: int) -> np.ndarray:
        order, lcp = ranks[side]
        own = np.empty(len(order), np.int64)
        own[order] = np.cumsum(lcp < depth)
        return own

    return classes


def hashed_classes(before, after, scale: Scale):
    """Hashes of each member's first symbols after the core (r) or before it (l), for every depth up to the reach; from columns."""
    sums = {}
    for side, column, skip in (("r", after, scale.core), ("l", before, 0)):
        data, offsets = utf8(column)
        data, offsets = np.append(data.view(np.uint32), np.uint32(0)), offsets // scale.step
        at = offsets[:-1] + skip + np.arange(scale.reach)[:, None]  # a row for each depth
        rows = np.where(at < offsets[1:], data[np.minimum(at, len(data) - 1)], np.uint32(0))
        sums[side] = np.zeros((scale.reach + 1, len(column)), np.uint64)
        np.cumsum(mix(rows.astype(np.uint64) + np.uint64(1)) * powers(scale.reach)[:, None], axis=0, out=sums[side][1:])
    return lambda side, depth: sums[side][depth]


def group_repeats(keys: np.ndarray, low, high, copies, before, after, scale: Scale) -> tuple[np.ndarray, np.ndarray]:
    """For members of whole groups, in the order of their keys (before and after are columns): the largest and smallest offset of a repeat, or -1.

    Where members have hashes, each is held against the next ones in groups of NEAR members or fewer; others are told apart by a sort.
    """
    n, step, wide, reach = len(keys), scale.step, scale.core, scale.reach
    size = {"r": np.diff(utf8(after)[1]) // step - wide, "l": np.diff(utf8(before)[1]) // step}
    group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
    classes = ordered_classes(group, before, after, scale) if scale.in_order else hashed_classes(before, after, scale)
    few, bits = (np.bincount(group)[group] <= NEAR) & (not scale.in_order), n.bit_length()  # three numbers of a member fit in 63 bits
    pairs = []  # of members of a small group, for each distance
    for d in range(1, NEAR):
        first = np.flatnonzero(few[:-d] & (group[d:] == group[:-d]))
        if not len(first):
            break
        pairs.append((first, first + d))

    top, bottom = np.full(n, -1), np.full(n, -1)
    for o in range(int(low.min()), int(high.max()) + 1):
        able = (size["l"] >= o) & (size["r"] >= reach - o) & (low <= o) & (o <= high)
        if not able.any():
            continue
        right, left = classes("r", reach - o), classes("l", o) if o else group
        hit = able & (copies >= 2)
        for a, b in pairs:
            same = able[a] & able[b] & (right[a] == right[b]) & (left[a] == left[b])
            hit[a[same]] = hit[b[same]] = True
        many = np.flatnonzero(able & ~few)
        if len(many):
            if scale.in_order and 3 * bits < 63:
                own = np.sort((right[many] << bits | left[many]) << bits | many)
                same = np.flatnonzero(own[1:] >> bits == own[:-1] >> bits)
                for k in (same, same + 1):
                    hit[own[k] & ((1 << bits) - 1)] = True
            else:
                own = right[many] * (n + 1) + left[many] if scale.in_order else mix(mix(right[many].astype(np.uint64)) + left[many].astype(np.uint64)) + group[many].astype(np.uint64)
                _, inverse, times = np.unique(own, return_inverse=True, return_counts=True)
                hit[many] |= times[inverse] >= 2
        top[hit] = o
        bottom[hit & (bottom < 0)] = o
    return top, bottom


def sorted_repeats(rows: DataFrame, scale: Scale) -> DataFrame:
    """ta, tb, start and end of the repeats that the groups' members are part of."""
    schema = "ta long, tb long, start long, end long"
    dealt = rows.select("key", "low", "high", "copies", "ta", "tb", "place", "before", "after").repartition("key").sortWithinPartitions("key")

    def run(batches):
        import pyarrow as pa

        held: list = []

        def solve(table):
            keys = np.asarray(table.column("key"), np.int64)
            low, high, copies, place = (np.asarray(table.column(c), np.int64) for c in ("low", "high", "copies", "place"))
            top, bottom = group_repeats(keys, low, high, copies, table.column("before"), table.column("after"), scale)
            at = np.flatnonzero((top >= 0) & (copies < 2))
            ids = [np.asarray(table.column(c), np.int64)[at] for c in ("ta", "tb")]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*ids, place[at] - top[at], place[at] - bottom[at] + scale.length)], names=["ta", "tb", "start", "end"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= SORT_ROWS:
                table = pa.Table.from_batches(held)
                keys = np.asarray(table.column("key"), np.int64)
                whole = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
                if whole:
                    yield solve(table.slice(0, whole))
                    held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, scale: Scale = BYTES, most: int | None = None) -> DataFrame:
    """ta, tb (two hashes of a text) and the spans of it, in symbols, that are covered by repeats."""
    wide, reach = scale.core, scale.reach
    rows = cut(shared_anchors(docs, scale))
    alike = cut(rows.groupBy("core", "whole").agg(F.sum("times").alias("copies"), F.min(F.struct("ta", "tb", "place", "left", "right")).alias("chief")))
    full = rows.where(F.col("left") + F.col("right") >= reach).join(alike.where("copies > 1").select("core", "whole"), ["core", "whole"], "left_semi")
    full = full.select("ta", "tb", (F.col("place") - F.col("left")).alias("start"), (F.col("place") + wide + F.col("right")).alias("end"))
    mixed = alike.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("core")
    needed = alike.join(mixed, "core").select("core", "copies", "chief.*")
    members, found = split_groups(cut(neighbourhoods(docs, needed, scale)), most or GROUP_ROWS, scale)
    spans = full.union(found).union(sorted_repeats(members, scale)).distinct()
    return spans.groupBy("ta", "tb").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def keyed_texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("ta"), F.xxhash64(text, F.lit(1)).alias("tb"))


def without(text: bytes, pairs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """text without its spans, given in order, and the number of maximal runs that go."""
    kept, at, runs, end = [], 0, 0, -1
    for a, b in pairs:
        if a > end:
            kept.append(text[at:a])
            runs += 1
        at = end = max(end, b)
    kept.append(text[at:])
    return b"".join(kept), runs


def passages(texts: DataFrame) -> DataFrame:
    """ta, tb and n_passage_words, the words in passages of over 50 words that occur again, whatever their bytes."""
    one = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda t, s: F.struct((t["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], t["end"]))).alias("n"), F.greatest(t["end"], s["end"]).alias("end"))
    return repeated_spans(texts, WORDS).select("ta", "tb", F.aggregate("spans", one, step, lambda t: t["n"]).alias("n_passage_words"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that are left), n_removed, n_spans and n_passage_words for every row of docs (doc_id, text).

    What goes is decided by bytes alone; n_passage_words counts the words in repeated passages of over
    50 words, some of which have fewer bytes than a repeat and stay.

    Texts without a repeat are never shuffled, but for those that a row map can't tell from the others.
    """
    texts = keyed_texts(docs)
    spans = cut(repeated_spans(texts).join(passages(texts), ["ta", "tb"], "full").withColumn("n_passage_words", F.coalesce("n_passage_words", F.lit(0).cast("long"))))
    known = row_map(spans, "ta", "tb")
    untouched = marked_rows(texts.select("doc_id", "text", "ta", "tb"), known, "ta", "tb", wanted=False).select("doc_id", "text", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.lit(0).cast("long").alias("n_passage_words"))
    others = marked_rows(texts, known, "ta", "tb").join(spans, ["ta", "tb"], "left").select("doc_id", "text", "spans", F.coalesce("n_passage_words", F.lit(0).cast("long")).alias("n_passage_words"))

    def each(batch):
        data, offsets = utf8(batch.column("text"))
        out = {"doc_id": batch.column("doc_id"), "n_bytes": np.diff(offsets), "kept": [], "n_removed": [], "n_spans": [], "n_passage_words": batch.column("n_passage_words")}
        for i, own in enumerate(batch.column("spans")):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            pairs = list(zip(own.values.field("start").to_pylist(), own.values.field("end").to_pylist(), strict=True)) if own.is_valid else []
            kept, runs = without(text, pairs)
            out["kept"].append(kept)
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(runs)
        return out

    schema = "doc_id long, n_bytes long, kept binary, n_removed long, n_spans long, n_passage_words long"
    return map_batches(untouched, each, schema).union(map_batches(others, each, schema))


def op9_deep_shallow_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passage_words of all documents, for strings of 400 bytes.

    Null and empty texts have no bytes and lose none; repeated rows and equal texts of 400 bytes or
    more lose all; an empty table gives no rows.
    """
    done = remove_repeats(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")
