"""Line dedup by distinct-site spread: boilerplate is what many sites share.

A line is known by two 64-bit hashes of its trimmed text, its site is the document's source. Lines are
counted first, by hash alone; of those that occur often enough to be of so many sites, HLL sketches of
the sites are built on the map side, straight from their occurrences, and merged by aggregation. So a
line costs one small row for each task however often it occurs, and no table of lines and sites is
ever made. Lines whose estimate is clearly at or
above ``min_sites`` are boilerplate, lines clearly below it are not, and the ones in between get an
exact distinct count of sites.

Of a boilerplate line one copy stays, in the document of the smallest id (then the smallest text
hash, then the first place in the text), so the corpus loses no line altogether; all others are
removed from their documents. Blank lines are neither counted nor removed.

The boilerplate table, and the table of the texts that lose a line, are counted before they are used:
up to BROADCAST_ROWS rows are broadcast, so texts are not shuffled, and a larger table is joined by
shuffle, where adaptive execution splits the partitions of common keys.
Everything is DataFrame functions: no Python runs on the executors.

Null texts have no lines and stay null. A null source is a site of its own. Repeated rows (same id
and text) are treated alike: the copy of a line that stays, stays in each of them. Ties between documents
that hold a line go by id, then text hash, then place, so none is left open. A very long text is one row of the
scans, split into its lines there. Columns of the input whose names clash with the operator's own are kept
as they are. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.session import cut

MIN_SITES = 8
#: log2 of the sketch's buckets; the estimate's relative standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 8
#: Estimates within so many standard errors of the threshold are counted exactly.
SIGMAS = 4.0
#: Rows of a table that is broadcast at most (some 40 bytes each, and 4 for each place of a line that goes).
BROADCAST_ROWS = 200_000


def line_hashes(line: Column) -> list[Column]:
    """Two hashes of a line without its outer spaces, tabs and carriage returns; both null for a blank one."""
    trimmed = F.trim(line, F.lit(" \t\r"))
    kept = F.when(trimmed != "", trimmed)
    return [F.when(kept.isNotNull(), F.xxhash64(kept)), F.when(kept.isNotNull(), F.xxhash64(kept, F.lit(1)))]


def exploded(docs: DataFrame) -> DataFrame:
    """One row for each line that isn't blank: _id, _th (text hash), _site, _pos, _a, _b."""
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("_site"), F.posexplode(F.split("text", "\n")).alias("_pos", "_line"))
    a, b = line_hashes(F.col("_line"))
    return rows.select("_id", "_th", "_site", "_pos", a.alias("_a"), b.alias("_b")).where("_a is not null")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines of at least min_sites sites: _a, _b and the place that keeps the line (_kid, _kth, _kpos)."""
    lines = exploded(docs)
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_th").alias("th"), F.col("_pos").alias("pos"))
    # a line that occurs less often than that has fewer sites, so it needs no sketch
    often = cut(lines.groupBy("_a", "_b").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_sites).select("_a", "_b"))
    spread = with_size(lines, often, "left_semi").groupBy("_a", "_b").agg(F.hll_sketch_agg("_site", F.lit(LG_K)).alias("_sketch"), F.min(place).alias("_keep"))
    margin = SIGMAS * 1.04 / 2 ** (LG_K / 2)
    rated = cut(spread.select("_a", "_b", "_keep", F.hll_sketch_estimate("_sketch").alias("_sites")).where(F.col("_sites") >= min_sites * (1 - margin) - 1))
    sure = rated.where(F.col("_sites") > min_sites * (1 + margin) + 1)
    near = rated.where(F.col("_sites") <= min_sites * (1 + margin) + 1)
    exact = exact_spread(lines, near.select("_a", "_b"), min_sites)
    passed = sure.unionByName(near.join(exact.select("_a", "_b"), ["_a", "_b"]))
    return cut(passed.select("_a", "_b", F.col("_keep.id").alias("_kid"), F.col("_keep.th").alias("_kth"), F.col("_keep.pos").alias("_kpos")))


def exact_spread(lines: DataFrame, near: DataFrame, min_sites: int) -> DataFrame:
    """_a, _b of those of the lines near the threshold that have min_sites sites, counted exactly."""
    sites = with_size(lines, near, "left_semi").select("_a", "_b", "_site").distinct()
    return sites.groupBy("_a", "_b").count().where(F.col("count") >= min_sites)


def with_size(lines: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """lines joined with a table on the line hashes; the table is broadcast only if its count allows it."""
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return lines.join(F.broadcast(table) if small else table.hint("merge"), ["_a", "_b"], how)


def removals(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """_id, _th and _drop: the places of the lines that go, for every text that loses any."""
    hits = with_size(exploded(docs), boilerplate(docs, min_sites), "inner")
    stays = F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_th") == F.col("_kth")) & (F.col("_pos") == F.col("_kpos"))
    return hits.where(~stays).groupBy("_id", "_th").agg(F.collect_set("_pos").alias("_drop"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs (doc_id, text, source, ...) with boilerplate lines taken out of text, with line_count and lines_removed at their end.

    Texts that lose nothing are unchanged to the byte.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names, strict=True))
    gone = removals(docs.select("doc_id", "text", "source"), min_sites).toDF("_gid", "_gth", "_drop")
    work = docs.toDF(*names).withColumn("_th", F.xxhash64(own["text"]))
    gone = cut(gone)
    gone = F.broadcast(gone) if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else gone.hint("merge")
    joined = work.join(gone, F.col(own["doc_id"]).eqNullSafe(F.col("_gid")) & (F.col("_th") == F.col("_gth")), "left")
    # explode keeps the split lines a column of their own: an array that a lambda reads is not split again for each line
    joined = joined.withColumn("_parts", F.explode(F.array(F.split(own["text"], "\n"))))
    parts = F.col("_parts")
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_drop"), lambda i: parts[i]), "\n")
    text = F.when(F.col("_drop").isNull(), F.col(own["text"])).otherwise(kept)
    return joined.select(
        *[(text if c == "text" else F.col(n)).alias(c) for c, n in own.items()],
        F.when(parts.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("line_count"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("lines_removed"),
    )


def op4_site_spread_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the text that is left, for every document.

    A null text has no lines and the hash of the empty text; repeated rows are treated alike; a null source is a
    site; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    return dedup_lines(docs).select("doc_id", F.col("line_count").alias("n_lines"), F.col("lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS t
           FROM (SELECT doc_id, source, unnest(range(1, len(p) + 1)) AS pos, unnest(p) AS line
                 FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))),
b AS (SELECT t, min(doc_id) AS kid FROM l WHERE t <> '' GROUP BY t HAVING count(DISTINCT coalesce(source, chr(1))) >= {MIN_SITES}),
k AS (SELECT b.t, b.kid, min(l.pos) AS kpos FROM b JOIN l ON l.t = b.t AND l.doc_id = b.kid GROUP BY b.t, b.kid),
f AS (SELECT l.doc_id, l.pos, l.line, (k.t IS NOT NULL AND NOT (l.doc_id = k.kid AND l.pos = k.kpos)) AS gone FROM l LEFT JOIN k ON l.t = k.t),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_removed, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""
