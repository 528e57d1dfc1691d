"""A manifest of a dataset: a Merkle tree over all rows, with an authentication path for each.

A row's leaf is the digest of its fields. The leaves of a group (lang) stand in order of their ids;
every ARITY consecutive nodes become their digest until one is left, the group's root, and the roots
of the groups, in order of the group's name, likewise become the root of the whole.

Paths come from traversal scheduling. Leaves are cut into aligned blocks of ARITY ** BLOCK_LEVELS.
Within a block the path is advanced leaf by leaf: for each level there is the run of nodes that the
path needs now and a treehash stack that makes the next run, fed with one leaf a step, so that it is
done in the very step in which the path enters it. So a block needs memory for a few runs a level,
the logarithm of its size, beside its leaves. The part of the path above a block is the same for all
of its leaves; blocks are the leaves of the next round, handled in the same way, and that shared
upper path is appended. The rounds are few: each divides the number of nodes by 4,096.

A group of any size is dealt out: its places are ranks by ranges (palaver.operators.ranks), and a
task gets whole blocks, never a whole group. Nothing is collected but the size of the largest group.

Nulls: a null field is ``-`` in the leaf; a null group is a group of its own, the first; a null id
stands first in its group. Rows with one id are ordered by leaf; repeated rows are leaves of their
own. An empty text has a leaf as any other; a very long one is read once, by the JVM's digest. An
empty table gives no rows. Only the named fields are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators.ranks import ranked_rows
from palaver.session import bounded, cut

ARITY, BLOCK_LEVELS = 8, 4
#: Characters of a digest.
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PATH = "array<struct<place:int,siblings:string>>"


def digest(nodes: str) -> str:
    return hashlib.sha256(nodes.encode()).hexdigest()


def levels_of(n: int, most: int) -> int:
    """Levels above the nodes of a round within their block, of n nodes in all."""
    height = 0
    while height < most and ARITY**height < n:
        height += 1
    return height


class Treehash:
    """The nodes of one level over leaves that come one by one: a stack with an open run for each level below."""

    def __init__(self, level: int):
        self.runs: list[list[str]] = [[] for _ in range(level + 1)]

    def push(self, leaf: str) -> None:
        self.runs[0].append(leaf)
        for level in range(len(self.runs) - 1):
            if len(self.runs[level]) < ARITY:
                return
            self.close_run(level)

    def close_run(self, level: int) -> None:
        self.runs[level + 1].append(digest("".join(self.runs[level])))
        self.runs[level] = []

    def nodes(self) -> list[str]:
        """All nodes of the level; the last leaves' short runs are closed."""
        for level in range(len(self.runs) - 1):
            if self.runs[level]:
                self.close_run(level)
        return self.runs[-1]


def block_root(leaves: list[str], height: int) -> str:
    tree = Treehash(height)
    for leaf in leaves:
        tree.push(leaf)
    return tree.nodes()[0]


def traverse(leaves: list[str], height: int) -> Iterator[list[tuple[int, str]]]:
    """The path of each leaf of a block in turn: the leaf's place in its run and its siblings, level by level."""
    sizes = [ARITY ** (level + 1) for level in range(height)]  # leaves below a run of each level
    now, coming, path = [], [Treehash(level) for level in range(height)], [(0, "")] * height
    for level, size in enumerate(sizes):
        first = Treehash(level)
        for leaf in leaves[:size]:
            first.push(leaf)
        now.append(first.nodes())
    for i in range(len(leaves)):
        for level, size in enumerate(sizes):
            if i and i % size == 0:
                now[level], coming[level] = coming[level].nodes(), Treehash(level)
            if i % (size // ARITY) == 0:
                place = i // (size // ARITY) % ARITY
                path[level] = (place, "".join(now[level][:place] + now[level][place + 1 :]))
            if i + size < len(leaves):
                coming[level].push(leaves[i + size])
        yield list(path)


def blocks_of(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"`at` div {ARITY**levels}"))


def climb(nodes: DataFrame, sizes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of nodes (grp, at, node, n) from the given ones upwards, and the root of each group (grp, root)."""

    def roots(key, table):
        order = np.argsort(table.column("at").to_numpy())
        leaves = table.column("node").take(pa.array(order)).to_pylist()
        n = table.column("n")[0].as_py()
        return pa.table({"grp": [key[0].as_py()], "at": [key[1].as_py()], "node": [block_root(leaves, levels_of(n, levels))], "n": [-(-n // size)]}, schema=schema)

    schema = pa.schema([("grp", pa.string()), ("at", pa.int64()), ("node", pa.string()), ("n", pa.int64())])
    size = ARITY**levels
    most, rounds = sizes.agg(F.max("n")).first()[0] or 0, [nodes]
    while True:
        up = cut(blocks_of(rounds[-1], levels).select("grp", "block", "at", "node", "n").groupBy("grp", "block").applyInArrow(roots, "grp string, at long, node string, n long"))
        if most <= size:
            return rounds, up.select("grp", F.col("node").alias("root"))
        rounds.append(up)
        most = -(-most // size)


def descend(nodes: DataFrame, upper: DataFrame, levels: int, carried: str = "") -> DataFrame:
    """grp, at, path and carried columns of a round's nodes; upper (grp, at, path) is of the round above.

    Levels within the block are made by traversal, and the path of the block is appended.
    """
    own = [c.split()[0] for c in carried.split(", ") if c]
    schema = ", ".join(["grp string", "at long", "node string", *([carried] if carried else []), f"path {PATH}"])
    kind = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))

    def paths(table, above):
        table = table.take(pa.array(np.argsort(table.column("at").to_numpy())))
        rest = above.column("path")[0].as_py() if above.num_rows else []
        leaves = table.column("node").to_pylist()
        height = levels_of(table.column("n")[0].as_py(), levels) if leaves else 0
        made = [[{"place": p, "siblings": s} for p, s in path] + rest for path in traverse(leaves, height)]
        found = {c: table.column(c) for c in ["grp", "at", "node", *own]} | {"path": pa.array(made, kind)}
        return pa.table(found)

    below = blocks_of(nodes, levels).select("grp", "block", "at", "node", "n", *own)
    above = upper.select("grp", F.col("at").alias("block"), "path")
    return below.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(paths, schema)


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(fields: dict[str, Column]) -> Column:
    """The digest of a row's fields, in their order."""
    return F.sha2(F.concat(*[field(c) for c in fields.values()]), 256)


def prove(leaves: DataFrame, carried: str = "", levels: int = BLOCK_LEVELS) -> DataFrame:
    """leaves (grp, id, leaf, carried columns) with at, node (the leaf), path, subroot and root.

    grp is not null. ``carried`` is the schema of further columns that are kept;
    blocks have ``levels`` levels.
    """
    own = [c.split()[0] for c in carried.split(", ") if c]
    placed = ranked_rows(cut(leaves), ["grp"], [F.col("id").asc_nulls_first(), F.col("leaf").asc()], "at")
    sizes = cut(placed.groupBy("grp").agg(F.max("at").alias("n")))
    nodes = cut(placed.join(sizes, "grp").select("grp", (F.col("at") - 1).alias("at"), F.col("leaf").alias("node"), "n", "id", *own))
    rounds, subroots = climb(nodes.select("grp", "at", "node", "n"), sizes, levels)
    groups = subroots.count()
    top = ranked_rows(subroots, [], [F.col("grp").asc()], "at").select(F.lit("").alias("grp"), (F.col("at") - 1).alias("at"), F.col("root").alias("node"), F.lit(groups).cast("long").alias("n"), F.col("grp").alias("of"))
    top_rounds, root = climb(top.select("grp", "at", "node", "n"), top.select("n"), levels)
    upper = leaves.sparkSession.createDataFrame([], f"grp string, at long, path {PATH}")
    for above in reversed(top_rounds[1:]):
        upper = descend(above, upper, levels).select("grp", "at", "path")
    upper = cut(descend(top, upper, levels, "of string").select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("at"), "path"))
    for above in reversed(rounds[1:]):
        upper = descend(above, upper, levels).select("grp", "at", "path")
    made = descend(nodes, upper, levels, ", ".join(filter(None, ["id long", carried])))
    ends = subroots.withColumnRenamed("root", "subroot").crossJoin(F.broadcast(root.select("root")))  # one row
    return made.join(bounded(ends), "grp")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""

    def up(node, step):
        before = step["place"] * WIDTH
        return F.sha2(F.concat(F.substring(step["siblings"], F.lit(1), before), node, F.substring(step["siblings"], before + 1, F.length(step["siblings"]))), 256)

    return F.aggregate(path, leaf, up)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, path, subroot and root of each row of docs, and changed: the leaf after tampering, null where there was none.

    Tampering lower-cases A-Z of the texts whose id's CRC 3 divides.
    """
    fields = {c: F.col(f"`{c}`") for c in FIELDS}
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate("text", CAPITALS, CAPITALS.lower())
    changed = F.when(touched & F.col("text").rlike("[A-Z]"), leaf_of(fields | {"text": lower}))
    group = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))  # null comes first and is no lang
    leaves = docs.select(*FIELDS).select(group.alias("grp"), F.col("doc_id").alias("id"), leaf_of(fields).alias("leaf"), changed.alias("changed"))
    made = prove(leaves, "changed string")
    return made.select(F.col("id").alias("doc_id"), F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).alias("lang"), F.col("node").alias("leaf"), "changed", "path", "subroot", "root")


def op11_merkle_traversal_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of all documents.

    Null fields are ``-``; null and empty texts, repeated rows and rows of one id have leaves of their
    own; a null id stands first and is never tampered with; an empty table gives no rows.
    """
    made = manifest(spark.read.parquet(f"{folder}/documents.parquet"))
    proof = F.sha2(F.array_join(F.transform("path", lambda p: p["siblings"]), ""), 256)
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    made = made.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int = 8, top_levels: int = 3) -> str:
    """SQL for groups of up to 8 ** levels rows and up to 8 ** top_levels groups: one table of runs for each level."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join([*[field(c) for c in FIELDS[:-1]], field(text)]) + ")"
    byte = "lambda c, b: list_reduce(list_prepend(xor(c, b), range(1, 9)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)), {byte}))"
    lower = f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')"
    parts = [f"""l AS (SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN coalesce({crc} % 3 = 0, false) THEN {leaf(lower)} ELSE {leaf("text")} END AS given FROM documents)""", "n0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS node FROM l)"]

    def rise(base: str, count: int, group: str) -> None:
        for k in range(count):
            parts.append(f"{base}r{k} AS (SELECT {group} AS g, pos // 8 AS up, list(node ORDER BY pos) AS run, max(max(pos)) OVER (PARTITION BY {group}) AS last FROM {base}{k} GROUP BY {group}, pos // 8)")
            parts.append(f"{base}{k + 1} AS (SELECT g AS {group}, up AS pos, CASE WHEN last = 0 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS node FROM {base}r{k})")

    def follow(base: str, count: int, group: str, at: str, before: str) -> str:
        for k in range(count):
            place = f"(({at} // {8**k}) % 8)"
            rest = f"list_concat(run[1:{place}], run[{place} + 2:])"
            run = f"list_concat(list_append(run[1:{place}], f), run[{place} + 2:])"
            parts.append(f"{before}{base}{k} AS (SELECT p.* REPLACE (p.proof || array_to_string({rest}, '') AS proof, CASE WHEN last = 0 THEN f ELSE sha256(array_to_string({run}, '')) END AS f) FROM {before} p JOIN {base}r{k} r ON p.{group} IS NOT DISTINCT FROM r.g AND p.{at} // {8 ** (k + 1)} = r.up)")
            before = f"{before}{base}{k}"
        return before

    rise("n", levels, "lang")
    parts.append(f"t0 AS (SELECT 1 AS one, lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM n{levels})")
    rise("t", top_levels, "one")
    parts.append("p AS (SELECT n0.*, given AS f, '' AS proof, 1 AS one, t0.pos AS top, t0.node AS subroot FROM n0 JOIN t0 ON n0.lang IS NOT DISTINCT FROM t0.lang)")
    end = follow("t", top_levels, "one", "top", follow("n", levels, "lang", "pos", "p"))
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, (SELECT node FROM t{top_levels}) AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = (SELECT node FROM t{top_levels}) AS verified FROM {end}"


ORACLE = _oracle()
