"""Whole texts as byte blocks: vectorised tokens, hashes and row transfer for the operators.

Arrow hands each batch of texts to Python as one UTF-8 buffer with offsets. The helpers here work
on that buffer with numpy, a bounded block of rows at a time, so that no Python object is made per
word. A null text counts as an empty one throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

#: Bytes of text that are handled at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Odd multiplier of the polynomial word hash.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that are runs of anything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words that are runs of digits, lower-case letters and anything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_codes = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 ... BASE ** (n - 1), modulo 2 ** 64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n + 1 offsets, without a copy where there are no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column) or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut_blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of a block of texts: hash, first byte and end of each; row i has words bounds[i]:bounds[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray, lower: bool = True):
        self.data = data = LOWER[data] if lower else data
        inside = member[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]  # of the texts that are not empty
        first[begins] = inside[begins]
        closes = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[closes] = inside[closes]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        lengths = self.ends - self.starts
        self.hashes = np.zeros(0, np.uint64)
        if len(lengths):
            heads = np.cumsum(lengths) - lengths
            place = np.arange(heads[-1] + lengths[-1]) - np.repeat(heads, lengths)
            coded = _codes[data[inside]] * powers(int(lengths.max()))[place]
            self.hashes = mix(np.add.reduceat(coded, heads) + lengths.astype(np.uint64))

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1 of the block, joined by single spaces."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[i:j], self.ends[i:j], strict=True))


def runs_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` consecutive words that begin at each word but the last width - 1."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * BASE + hashes[k : k + n]
    return mix(total)


def salts(keys: np.ndarray, of: np.ndarray, hot: int, spread: int = 61) -> np.ndarray:
    """0 for rows of keys that at most ``hot`` of them have; else 1 for the first row and 2 or more, by a hash of ``of``, for the others."""
    _, inverse, many = np.unique(keys, return_inverse=True, return_counts=True)
    salt = np.zeros(len(keys), np.int64)
    at = np.flatnonzero(many[inverse] > hot)
    salt[at] = 2 + (mix(of[at]) % np.uint64(spread)).astype(np.int64)
    _, first = np.unique(inverse[at], return_index=True)
    salt[at[first]] = 1
    return salt


#: Bits of a row map; a full map tells nothing and loses nothing.
MAP_BITS = 1 << 23


def map_place(*names: str) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(MAP_BITS)).cast("int")


def row_map(rows: DataFrame, *names: str) -> np.ndarray:
    """A map of MAP_BITS bits, marked by the hashes of the named long columns of all rows."""
    words = rows.select(map_place(*names).alias("h")).selectExpr("shiftright(h, 6) as w", "shiftleft(1L, h & 63) as bit")
    bitmap = np.zeros(MAP_BITS // 64, np.int64)
    for r in words.groupBy("w").agg(F.bit_or("bit").alias("bits")).collect():  # MAP_BITS / 64 rows at most
        bitmap[r.w] = r.bits
    return bitmap


def marked_rows(df: DataFrame, bitmap: np.ndarray, *names: str, wanted: bool = True) -> DataFrame:
    """The rows of df that the map marks, or those that it doesn't: a filter on the scan, with no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    def each(batch):
        h = np.asarray(batch.column("_h"), np.int64)
        kept = batch.filter(pa.array(((shared.value[h >> 6] >> (h & 63)) & 1).astype(bool) == wanted))
        return {c: kept.column(c) for c in columns}

    columns = df.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return map_batches(df.withColumn("_h", map_place(*names)), each, schema)


def keyed(df: DataFrame, *names: str) -> list[Column]:
    """The named columns, addressed so that names with dots or other case do not clash."""
    return [F.col(f"`{n}`") for n in names]


#: Bytes of an Arrow batch at most, one longer row excepted.
BATCH_BYTES = 8 << 20


def small_batches(spark) -> None:
    """Lowers the session's bound of an Arrow batch to BATCH_BYTES: what an executor and its Python workers hold at once."""
    name, given = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not given.rstrip("b").isdigit() or int(given.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str) -> DataFrame:
    """``each`` over Arrow batches; it returns or yields column dictionaries in the schema's order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    target = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            made = each(batch)
            for columns in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays([as_array(columns[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def with_computed(docs: DataFrame, compute: Callable[[pa.Array], dict], added: str) -> DataFrame:
    """docs with the columns that ``compute`` makes of its text column at their end.

    ``added`` is a schema. Columns of docs that have a name of ``added`` are replaced; all others are
    kept whatever they are called.
    """
    new = T._parse_datatype_string(added)
    kept = [i for i, c in enumerate(docs.columns) if c not in new.names]
    names = [docs.columns[i] for i in kept]
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select(*[f"c{i}" for i in kept])
    text_at = names.index("text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*own.schema, *new])

    def each(batch):
        return {c: batch.column(n) for n, c in enumerate(own_names)} | compute(batch.column(text_at))

    own_names = own.columns
    made = map_batches(own, each, schema)
    return made.select(*[F.col(c).alias(n) for c, n in zip(own_names, names, strict=True)], *new.names)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    if isinstance(values, np.ndarray) and values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.array(values, type=kind)


def crc_remainder(doc_id: Column | str, divisor: int) -> Column:
    """crc32 of the id's decimal text modulo ``divisor``: the folds of the learned operators."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def bounded_sample(df: DataFrame, rows: int, key: Column, seed: int = 7) -> DataFrame:
    """The ``rows`` rows with the smallest seeded hashes of ``key``: reruns give the same rows for one input.

    Equal rows count once, so a text with very many copies does not fill the sample. A filter on the hash
    leaves a small surplus, of which a bounded top list takes the smallest.
    """
    total = df.count()
    share = min(1.0, 2 * rows / max(total, 1) + 1e-9)  # as many again, for equal rows
    draw = F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(1 << 30))
    chosen = df.withColumn("_draw", draw)
    chosen = (chosen.where(draw < int(share * (1 << 30))) if share < 1 else chosen).distinct()
    return chosen.orderBy("_draw", key).limit(rows).drop("_draw")
