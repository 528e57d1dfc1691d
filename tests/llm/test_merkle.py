"""The manifest against a tree built plainly, over several rounds of blocks."""

import hashlib
import zlib

import pytest
from helpers import DOCS, odd_rows, with_clashes

from palaver.llm import merkle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(nodes):
    """Root, and the path (place, siblings) of each node."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
            paths[i].append((k % 8, "".join(run[: k % 8] + run[k % 8 + 1 :])))
            at[i] = k // 8
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain(rows):
    """Rows of the query, by trees built in memory. rows (doc_id, text, lang, source, n_chars)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(field, (r[0], r[3], r[2], r[4], t))))
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for r in rows:
        touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, low(r[1]) if touched else r[1]), r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: tree([x[2] for x in sorted(groups[g])]) for g in order}
    root, tops = tree([made[g][0] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for x, path in zip(sorted(groups[g]), made[g][1], strict=True):
            folded = x[3]
            for place, siblings in path + top:
                folded = sha(siblings[: 64 * place] + folded + siblings[64 * place :])
            out.append((x[4], x[2], made[g][0], root, sha("".join(s for _, s in path + top)), folded, folded == root))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def query(spark, docs, levels=merkle.BLOCK_LEVELS, monkeypatch=None):
    from pyspark.sql import functions as F

    if monkeypatch:
        whole = merkle.prove
        monkeypatch.setattr(merkle, "prove", lambda leaves, carried="": whole(leaves, carried, levels))
    made = merkle.manifest(docs)
    folded = merkle.fold(F.coalesce("changed", "leaf"), F.col("path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda p: p["siblings"]), ""), 256)
    return made.select("doc_id", "leaf", "subroot", "root", proof, folded, folded == F.col("root"))


@pytest.mark.parametrize("levels", [1, 2])
def test_many_rounds_equal_a_plain_tree(spark, monkeypatch, levels):
    rows = [(i, f"Text {i % 50} {'x' * (i % 7)}", "en" if i % 3 else "de", f"s{i % 4}", i) for i in range(700)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert found(query(spark, docs, levels, monkeypatch)) == plain(rows)


def test_odd_rows_and_many_groups(spark):
    rows = odd_rows() + [(100 + i, f"A {i}", f"l{i}", None, i) for i in range(9)] + [(2, "Other", "en", "b", 60)]
    assert found(query(spark, with_clashes(spark.createDataFrame(rows, DOCS)))) == plain(rows)


def test_empty_table_and_lone_row(spark):
    assert query(spark, spark.createDataFrame([], DOCS)).count() == 0
    one = [(1, "Aa", None, None, None)]
    assert found(query(spark, spark.createDataFrame(one, DOCS))) == plain(one)


def test_traversal_keeps_the_logarithm_of_a_block():
    """The stacks of a block never hold more nodes than two runs and an open run below, for each pair of levels."""
    leaves = [sha(str(i)) for i in range(600)]
    held, made = [], []

    class Watched(merkle.Treehash):
        def __init__(self, level):
            super().__init__(level)
            made.append(self)

    plain_class, merkle.Treehash = merkle.Treehash, Watched
    try:
        for _ in merkle.traverse(leaves, 4):
            held.append(max(sum(map(len, t.runs)) for t in made))
    finally:
        merkle.Treehash = plain_class
    assert max(held) <= 8 * 4
