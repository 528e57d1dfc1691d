"""N-gram Jaccard join by parity sketches, and the components of its links.

Every distinct shingle of a text toggles one bit of a wide sketch, so the Hamming distance of two
sketches never exceeds the symmetric difference of the two sets. Two sets of sizes a and b with a
Jaccard similarity of p / q or more differ in at most (q - p) * (a + b) / (q + p) shingles. Each
size band cuts its sketch into more blocks than that bound, so by the pigeonhole principle linked
sets agree in some blocks that are not empty, and it is known in how many: a set with f such blocks
that may differ in d shingles from a partner shares f - d of them or more with each partner.

Shape of the job:

* equal sets are collapsed first and stand as one, known by a 64-bit print; a set's blocks are shipped
  as (64-bit fingerprint, print). A fingerprint that very many sets of one batch have is dealt out
  (salted) at once, so no task gets all rows of a hot block;
* a set that shares fewer of its blocks with any other set than it has to share with a partner is
  out, before a pair is made. Unrelated texts go here, whatever lines they have in common;
* within a bucket of equal blocks the members are paired with one hub, not with each other. Pairs
  whose sketches, sized by their own bound, differ in too many bits are dropped, the rest is verified
  and the links are merged into components;
* buckets that still span components are compared twice more: what a set shares with other
  components is counted anew, of the blocks left only a prefix (the rarest first, by the same
  bound) is looked at, and pairs within a component are never made. The first time a set is the
  second of one pair in a bucket at most, which joins what has a common neighbour; the second time
  all pairs that the sketches leave open are verified. So no link between different components is
  lost and no group of near copies is expanded into all pairs;
* for verification the text of a pair's second set goes once to the pair, the first one's once for
  up to GROUP partners, and one pass over sorted rows compares the shingles.

Empty, null and word-less texts have an empty set and link with nothing. A null id takes no part in
links and keeps a null component. Repeated rows give repeated rows; rows of one id with different
texts are different sets. An empty table gives an empty result. Other columns of the input are not
looked at, whatever their names are. A text of any length is one set.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.llm.blocks import BASE, NOT_SPACE, Words, cut_blocks, map_batches, marked_rows, mix, row_map, runs_hash, salts, utf8
from palaver.session import cut

#: Growth of the set sizes from one band to the next.
BAND_RATIO = 1.5
#: Blocks of a sketch beyond the bound: one for each SPARE of the bound, and EXTRA.
SPARE, EXTRA = 7, 4
#: Bits of a set's sketch for each shingle in which it may differ, and their least number.
BITS_EACH, LEAST_BITS = 16, 64
#: Bits of the sketch that goes with each member of a bucket, at most.
SMALL_BITS = 2048
#: Members of a bucket that are held in memory against as many others.
CHUNK = 1024
#: Links that are merged in one task at most.
FEW_LINKS = 20_000
#: Partners of one text that are verified in a row.
GROUP = 256
#: Rows of a table that is broadcast at most (17 bytes each).
BROADCAST_ROWS = 500_000
#: Keys that are looked at together for hot ones, and rows of one key that are left together.
FLUSH, HOT = 400_000, 1


def bands(top: int = 1 << 40) -> list[int]:
    """Lower bounds of the size bands."""
    found = [1]
    while found[-1] < top:
        found.append(max(found[-1] + 1, ceil(found[-1] * BAND_RATIO)))
    return found


BANDS = np.array(bands())


def places(n: int, p: int, q: int) -> list[tuple[int, int, int]]:
    """(band, blocks, most) of the bands where a set of n shingles meets its partners.

    They are its own and, where a partner can be so large, the next; most is the largest symmetric
    difference from a partner there.
    """
    band, found = int(np.searchsorted(BANDS, n, "right")) - 1, []
    for g in (band, band + 1):
        if g == band or q * n >= p * int(BANDS[g]):
            top = int(BANDS[g + 1]) - 1
            bound = (q - p) * 2 * top // (q + p)
            found.append((g, bound + bound // SPARE + EXTRA, (q - p) * (n + min(top, q * n // p)) // (q + p)))
    return found


def block_numbers(own: np.ndarray, k: int) -> np.ndarray:
    """The block of each shingle of a sorted set: ascending, as they follow the high bits."""
    return ((own >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)


def filled_blocks(block: np.ndarray) -> np.ndarray:
    """Where each block that isn't empty begins."""
    return np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))


def needs(own: np.ndarray, p: int, q: int) -> list[int]:
    """For each of places(): blocks that the set shares with any partner there, at least."""
    found = []
    for _, k, most in places(len(own), p, q):
        f = len(filled_blocks(block_numbers(own, k)))
        found.append(f - most if f > most else 1)
    return found


def signatures(own: np.ndarray, p: int, q: int) -> np.ndarray:
    """The keys of all blocks that a set ships."""
    return np.concatenate(place_keys(own, p, q))


def place_keys(own: np.ndarray, p: int, q: int) -> list[np.ndarray]:
    """For each of places(): the keys of the set's blocks, which hash band, block and fingerprint together.

    Empty blocks are left out but where the bound leaves no other block that is surely shared.
    """
    wide, found = mix(own + np.uint64(0x51ED270B)), []
    for g, k, most in places(len(own), p, q):
        block = block_numbers(own, k)
        begin = filled_blocks(block)
        at, prints = block[begin], np.bitwise_xor.reduceat(wide, begin)
        if len(begin) <= most:
            every = np.zeros(k, np.uint64)
            every[at.astype(np.int64)] = prints
            at, prints = np.arange(k, dtype=np.uint64), every
        found.append(mix(prints ^ mix(at + np.uint64(g << 40))))
    return found


def shingle_sets(data, offsets, width: int):
    """Per row: the sorted distinct shingle hashes of the text."""
    words = Words(data, offsets, NOT_SPACE)
    runs = runs_hash(words.hashes, width)
    for i in range(len(offsets) - 1):
        a, b = words.bounds[i], words.bounds[i + 1]
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield runs_hash(words.hashes[a:b], int(b - a)) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def column_sets(column, width: int):
    """shingle_sets() of a whole column, a block at a time."""
    data, offsets = utf8(column)
    for i, j in cut_blocks(offsets):
        yield from shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)


def sketch_bits(n: int, p: int, q: int) -> int:
    return max(LEAST_BITS, 1 << (BITS_EACH * ((q - p) * 2 * n // (q + p))).bit_length())


def sketch(own: np.ndarray, bits: int) -> np.ndarray:
    """The parity of the shingles at each of ``bits`` (a power of two) places, packed."""
    return np.packbits((np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def fold(rows: np.ndarray, size: int) -> np.ndarray:
    """Packed sketches folded to ``size`` bytes: the sketches of as many bits."""
    while rows.shape[-1] > size:
        rows = rows[..., : rows.shape[-1] // 2] ^ rows[..., rows.shape[-1] // 2 :]
    return rows


def set_print(own: np.ndarray) -> int:
    return int(np.add.reduce(own * BASE, dtype=np.uint64).view(np.int64))


def text_print():
    return F.xxhash64("text")


def describe(docs: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """For every row: doc_id, th (a hash of the text), n_shingles, a 128-bit print of the set (hi, sid), what it needs and its sketch."""

    def each(batch):
        out = {c: [] for c in ("n_shingles", "hi", "sid", "need0", "need1", "bits")}
        for own in column_sets(batch.column("text"), width):
            need = [*needs(own, p, q), None][:2] if len(own) else [None, None]
            row = (len(own), int(np.bitwise_xor.reduce(mix(own), initial=np.uint64(0)).view(np.int64)), set_print(own), *need, sketch(own, sketch_bits(len(own), p, q)).tobytes())
            for c, v in zip(out, row, strict=True):
                out[c].append(v)
        return {"doc_id": batch.column("doc_id"), "th": batch.column("th")} | out

    return map_batches(docs.select("doc_id", text_print().alias("th"), "text"), each, "doc_id long, th long, n_shingles long, hi long, sid long, need0 int, need1 int, bits binary")


def block_rows(docs: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """(key, sid, tag) of the shipped blocks of every set; copies within a batch ship theirs once.

    tag is the number of the place plus 2 * salt. Of a key that more than HOT sets looked at together
    have, the first has salt 1 and stays with other batches' rows, the others are dealt out.
    """

    def dealt(keys, sids, slots):
        keys, sids, slots = (np.concatenate(x) for x in (keys, sids, slots))
        return {"key": keys, "sid": sids, "tag": slots + 2 * salts(keys, sids, HOT)}

    def each(batch):
        seen: set[int] = set()
        keys, sids, slots, size = [], [], [], 0
        for own in column_sets(batch.column("text"), width):
            sid = set_print(own)
            if not len(own) or sid in seen:
                continue
            seen.add(sid)
            for slot, found in enumerate(place_keys(own, p, q)):
                keys.append(found)
                sids.append(np.full(len(found), sid, np.int64).view(np.uint64))
                slots.append(np.full(len(found), slot, np.int64))
                size += len(found)
            if size > FLUSH:
                yield dealt(keys, sids, slots)
                keys, sids, slots, size = [], [], [], 0
        if keys:
            yield dealt(keys, sids, slots)

    return map_batches(docs.where("doc_id is not null").select("text"), each, "key long, sid long, tag int")


def live_rows(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, sid, slot, n, need, has) of the blocks that sets share, for the sets that share enough (has) of them."""
    salt = F.shiftright("tag", 1)
    same = Window.partitionBy("key", "salt").orderBy("sid")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("key", "sid", (F.col("tag") % 2).alias("slot"), F.when(salt < 2, 0).otherwise(salt).alias("salt"), (salt > 0).alias("known"))
    rows = rows.select("*", F.first("sid").over(whole).alias("first"), F.last("sid").over(whole).alias("last"), F.lag("sid").over(same).alias("before"))
    shared = rows.where("known or first <> last").where("before is null or before <> sid").select("key", "sid", "slot")
    own = Window.partitionBy("sid")
    counted = shared.select("*", *[F.sum(F.when(F.col("slot") == s, 1).otherwise(0)).over(own).alias(f"has{s}") for s in (0, 1)])
    named = counted.join(sets.select("sid", F.col("n_shingles").alias("n"), "need0", "need1"), "sid")
    pick = lambda a: F.when(F.col("slot") == 0, F.col(f"{a}0")).otherwise(F.col(f"{a}1"))
    return named.select("key", "sid", "slot", "n", pick("need").alias("need"), pick("has").alias("has")).where("has >= need")


def hub_pairs(live: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b): every set with the hub of each of its buckets, the set that shares most blocks with others."""
    hubs = live.groupBy("key").agg(F.max(F.struct("has", "sid", "n")).alias("hub"), F.min("sid").alias("least"), F.max("sid").alias("most")).where("least <> most").select("key", "hub")
    return live.join(hubs, "key").where("sid <> hub.sid").where(alike(F.col("n"), F.col("hub.n"), p, q)).select(F.col("hub.sid").alias("a"), F.col("sid").alias("b")).distinct()


def alike(m, n, p: int, q: int):
    """Whether the sizes of two sets allow a link."""
    return q * F.least(m, n) >= p * F.greatest(m, n)


def near(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Of pairs (a, b), those that size and Hamming distance leave open."""

    def each(batch):
        na, nb = (np.asarray(batch.column(c), np.int64) for c in ("na", "nb"))
        x, y = (batch.column(c).to_pylist() for c in ("bits_a", "bits_b"))
        wide = np.array([(len(s), len(t)) for s, t in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
        apart = np.zeros(len(na), np.int64)
        for i, j in np.unique(wide, axis=0).tolist():
            at = np.flatnonzero((wide[:, 0] == i) & (wide[:, 1] == j))
            s = fold(np.frombuffer(b"".join(x[k] for k in at), np.uint8).reshape(len(at), i), min(i, j))
            t = fold(np.frombuffer(b"".join(y[k] for k in at), np.uint8).reshape(len(at), j), min(i, j))
            apart[at] = np.bitwise_count(s ^ t).sum(axis=1, dtype=np.int64)
        open_ = ((q + p) * apart <= (q - p) * (na + nb)) & (q * np.minimum(na, nb) >= p * np.maximum(na, nb))
        return {c: np.asarray(batch.column(c), np.int64)[open_] for c in ("a", "b")}

    own = sets.select("sid", F.col("n_shingles").alias("n"), "bits")
    wide = pairs.join(own.toDF("a", "na", "bits_a"), "a").join(own.toDF("b", "nb", "bits_b"), "b")
    return map_batches(wide.select("na", "nb", "bits_a", "bits_b", "a", "b"), each, "a long, b long")


def open_pairs(live: DataFrame, roots: DataFrame, sets: DataFrame, p: int, q: int, every: bool) -> DataFrame:
    """Pairs (a, b) of one bucket and different components that counts, sizes and small sketches leave open.

    Without ``every``, a set is in one pair only as the second of it in each bucket: the pairs are no
    more than the members, none if nothing is open, and join what a common neighbour joins.

    A bucket of more than CHUNK sets is dealt out in chunks by the members' hash, one task row for each pair of chunks.
    """
    of = live.drop("has").join(roots.withColumnRenamed("id", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    spans = lambda df: df.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key", "m")
    # linked sets share ``need`` blocks of those that span components, so one is among each one's rarest has - need + 1
    ranked = Window.partitionBy("sid", "slot").orderBy("m", "key")
    whole = Window.partitionBy("sid", "slot")
    of = of.join(spans(of), "key").withColumn("rank", F.dense_rank().over(ranked)).withColumn("has", F.max("rank").over(whole))
    of = cut(of.where("has >= need and rank <= has - need + 1").select("key", "sid", "n", "root"))
    of = of.join(spans(of), "key")
    many = of.withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int"))
    many = many.withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int")).join(small_sketches(sets), "sid")
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cell = [F.col("key"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")]
    cells = many.groupBy(*cell).agg(F.collect_list(F.struct("sid", "root", "n", "bits", "mine")).alias("rows")).select("i", "j", "rows")

    def each(batch):
        found = [np.zeros((2, 0), np.int64)]
        for i, j, rows in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("rows"), strict=True):
            flat = rows.values
            ids, root, n, mine = (np.asarray(flat.field(c), np.int64) for c in ("sid", "root", "n", "mine"))
            bits = flat.field("bits").to_pylist()
            left, right, claimed = np.flatnonzero(mine == i), np.flatnonzero(mine == j), np.zeros(len(ids), bool)
            size = min(map(len, bits))
            packed = np.stack([fold(np.frombuffer(x, np.uint8), size) for x in bits])
            for x in left:
                y = right[(root[right] != root[x]) & (q * np.minimum(n[right], n[x]) >= p * np.maximum(n[right], n[x]))]
                y = y[ids[y] > ids[x]] if i == j else y
                apart = np.bitwise_count(packed[y] ^ packed[x]).sum(axis=1, dtype=np.int64)
                y = y[(q + p) * apart <= (q - p) * (n[y] + n[x])]
                if not every:
                    y = y[~claimed[y]]
                    claimed[y] = True
                if len(y):
                    found.append(np.stack([np.minimum(ids[y], ids[x]), np.maximum(ids[y], ids[x])]))
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)  # one pair is in many buckets
        return {"a": a, "b": b}

    return map_batches(cells, each, "a long, b long").distinct()


def small_sketches(sets: DataFrame) -> DataFrame:
    """sid and its sketch, folded to SMALL_BITS where it has more."""

    def each(batch):
        bits = [fold(np.frombuffer(x, np.uint8), SMALL_BITS // 8).tobytes() for x in batch.column("bits").to_pylist()]
        return {"sid": batch.column("sid"), "bits": bits}

    return map_batches(sets.select("sid", "bits"), each, "sid long, bits binary")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """sid and text of the rows (sid, doc_id, th) of ids.

    A row map goes to the scan of the texts, so nearly all others stay where they are; the join after
    it is exact.
    """
    rows = docs.where("doc_id is not null").select("doc_id", text_print().alias("th"), "text")
    likely = marked_rows(rows, row_map(ids, "doc_id", "th"), "doc_id", "th")
    return likely.join(ids, ["doc_id", "th"]).select("sid", "text").dropDuplicates(["sid"])


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """Of pairs (a, b), those whose shingle sets are similar enough."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    dealt = pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("part"))
    second = dealt.select(F.col("b").alias("sid"), "a", "part", F.lit(1).alias("kind"))
    aims = cut(second.union(dealt.select(F.col("a").alias("sid"), "a", "part", F.lit(0).alias("kind")).distinct()))
    texts = texts_of(docs, cut(aims.select("sid").distinct().join(sets.select("sid", "doc_id", "th"), "sid")))
    sent = aims.join(texts, "sid").repartition("a", "part").sortWithinPartitions("a", "part", "kind").select("a", "sid", "kind", "text")

    def run(batches):
        first = np.zeros(0, np.uint64)  # the set of the last row of kind 0: of the rows that follow it, too
        for batch in batches:
            a, sid, kind = (np.asarray(batch.column(c), np.int64) for c in ("a", "sid", "kind"))
            linked = np.zeros(batch.num_rows, bool)
            for k, own in enumerate(column_sets(batch.column("text"), width)):
                if kind[k] == 0:
                    first = own
                else:
                    both = len(first) + len(own) - len(np.union1d(first, own))
                    linked[k] = q * both >= p * (len(first) + len(own) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(sid[linked])], names=["a", "b"])

    return sent.mapInArrow(run, "a long, b long")


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(id, root) of every id in links (a, b): root is the smallest id that links reach.

    Alternates large-star and small-star steps on the edge list, each a grouped minimum and a join,
    until no edge changes; the number of edges never grows. FEW_LINKS links or fewer, which are counted,
    are merged in one task on an executor instead: the steps' jobs would take longer than the links.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = fingerprint(edges)
    if before[0] <= FEW_LINKS:
        return cut(edges.repartition(1).mapInArrow(merged_links, "id long, root long"))
    for _ in range(limit):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = cut(small.where("a <> b").distinct())
        after = fingerprint(edges)
        if after == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = after
    raise RuntimeError("components did not settle")


def merged_links(batches):
    """(id, root) of all links of a task: roots sink to the smallest place that a link or a root's root has."""
    rows = [np.stack([np.asarray(batch.column(c), np.int64) for c in ("a", "b")]) for batch in batches]
    links = np.concatenate([np.zeros((2, 0), np.int64), *rows], axis=1)
    ids, place = np.unique(links, return_inverse=True)
    (a, b), root, before = place.reshape(2, -1), np.arange(len(ids)), None
    while before is None or (root != before).any():
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
    away = np.flatnonzero(root != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[away]), pa.array(ids[root[away]])], names=["id", "root"])


def fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def linked_rows(docs: DataFrame, width: int = 4, p: int = 85, q: int = 100) -> DataFrame:
    """doc_id, th, n_shingles, root and component_id for every row of docs (doc_id, text).

    root names the component; it is null where a row has no id or no shingle.
    Two rows link when q * intersection >= p * union of their shingle sets; p / q is 2 / 3 or more.
    """
    if 3 * p < 2 * q or p > q:
        raise ValueError("the similarity must lie between 2/3 and 1")
    docs = docs.select("doc_id", "text")
    rows = cut(describe(docs, width, p, q))
    known = rows.where("n_shingles > 0 and doc_id is not null")
    sets = cut(known.groupBy("hi", "sid", "n_shingles", "need0", "need1", "bits").agg(F.min(F.struct("doc_id", "th")).alias("row")).select("hi", "sid", "n_shingles", "need0", "need1", "bits", "row.*"))
    live = cut(live_rows(block_rows(docs, width, p, q), sets))
    pairs = cut(near(hub_pairs(live, p, q), sets, p, q))
    roots = components(verified(pairs, docs, sets, width, p, q))
    for every in (False, True):  # most of what is open joins by few pairs; then all that is left is compared
        pairs = cut(near(open_pairs(live, roots, sets, p, q, every), sets, p, q))
        if pairs.isEmpty():
            break
        roots = components(verified(pairs, docs, sets, width, p, q).union(roots.toDF("a", "b")))
    named = sets.select("hi", "sid", "doc_id").join(roots.withColumnRenamed("id", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    labels = named.join(named.groupBy("root").agg(F.min("doc_id").alias("label")), "root").select("hi", "sid", "root", "label")
    out = rows.select("doc_id", "th", "n_shingles", "hi", "sid").join(labels, ["hi", "sid"], "left")
    alone = F.col("label").isNull() | F.col("doc_id").isNull()
    return out.select("doc_id", "th", "n_shingles", F.when(~alone, F.col("root")).alias("root"), F.when(alone, F.col("doc_id")).otherwise(F.col("label")).alias("component_id"))


def link_components(spark: SparkSession, docs: DataFrame, width: int = 4, p: int = 85, q: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of linked_rows()."""
    return linked_rows(docs, width, p, q).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, width: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """docs (doc_id, text, ...) with one row of each component: that of the smallest id, then of the smallest hash of the text.

    Rows without an id and texts without a word are in no component and stay. Repeated rows are one component.
    """
    rows = cut(linked_rows(docs, width, p, q).where("root is not null").select("doc_id", "th", "root"))
    kept = rows.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("kept"))
    judged = rows.groupBy("root", "doc_id", "th").agg(F.count("*").alias("copies")).join(kept, "root")
    stays = F.col("kept") == F.struct("doc_id", "th")
    gone = cut(judged.where(~stays | (F.col("copies") > 1)).select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th"), stays.alias("_repeated")))
    table = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone.hint("merge")
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    same = (at["doc_id"].cast("long") == F.col("_gone_id")) & (F.xxhash64(at["text"]) == F.col("_gone_th"))
    joined = own.join(table, same, "left")
    left = joined.where("_repeated is null").select(*own.columns)
    if not gone.where("_repeated").isEmpty():
        left = left.union(joined.where("_repeated").dropDuplicates(["_gone_id", "_gone_th"]).select(*own.columns))
    return left.select(*[at[c].alias(c) for c in docs.columns])


def op6_parity_sketch_join(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_shingles and component_id of all documents, for 4-word shingles and a Jaccard similarity of 0.85.

    Null, empty and word-less texts have n_shingles 0 and their own id as component; repeated rows
    give repeated rows; an empty table gives no rows.
    """
    return link_components(spark, spark.read.parquet(f"{folder}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(list_aggregate(list_slice(w, i, i + least(4, len(w)) - 1), 'string_agg', ' ')) AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM w WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_n >= 85 * (a.n + b.n - both_n)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, x AS y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce((SELECT min(r.y) FROM r WHERE r.x = d.doc_id), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id
"""
