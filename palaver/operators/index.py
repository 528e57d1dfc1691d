"""A stored inverted index: postings of all terms by recording, in folders by a hash of the term.

An index is a folder of two tables. ``recordings`` has a row for each build of a recording: its
number of documents, their mean length, the mean idf of its vocabulary. ``postings`` has the postings of every
build, in folders by bucket, and rows without a term that have the documents of a recording (palaver.operators.counting). Both are only appended to, postings first, so a job that dies leaves no
half-built recording: what counts is the last build that ``recordings`` names. To update recordings is to
append a build of them; ``compact`` drops what no build refers to.

A question reads the buckets of its terms and no others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from palaver.operators import retrieval as rt
from palaver.operators.counting import counted, owners_of
from palaver.session import bounded, cut, exists

#: Folders of postings, and files of a folder that a build writes at most.
BUCKETS, PARTS = 64, 8


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """keys, build, n, avgdl and mean_idf of each recording's last build."""
    rows = spark.read.parquet(f"{path}/recordings")
    return rows.groupBy(*keys).agg(F.max(F.struct("build", "n", "avgdl", "mean_idf")).alias("r")).select(*keys, "r.*")


def append(docs: DataFrame, keys: list[str], path: str) -> int:
    """Appends a build of the recordings of docs (keys, doc_id, text) to the index at path; returns its number."""
    spark = docs.sparkSession
    build = (spark.read.parquet(f"{path}/recordings").agg(F.max("build")).first()[0] or 0) + 1 if exists(spark, f"{path}/recordings") else 1
    rows = counted(docs, keys).withColumn("build", F.lit(build)).withColumn("bucket", bucket_of(F.col("term")))
    # a hot term is dealt out too; the writer sorts by bucket, in which each task's postings stand as it made them
    rows.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).write.partitionBy("bucket").mode("append").parquet(f"{path}/postings")
    written = spark.read.parquet(f"{path}/postings").where(F.col("build") == build)
    count = F.when(F.col("term").isNotNull(), 1).otherwise(F.col("df"))  # the texts are not read again for what their postings say
    terms = written.groupBy(*keys, "term").agg(F.sum(count).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("tf"))).alias("tf"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("dl"))
    headed = rt.headers(cut(rt.summary(terms, keys)), keys).withColumn("build", F.lit(build))
    headed.write.mode("append").parquet(f"{path}/recordings")
    return build


def postings(spark: SparkSession, path: str, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The current postings of the wanted terms (keys, term): of their buckets only, at most BUCKETS numbers of which are looked up first."""
    buckets = sorted(r.bucket for r in wanted.select(bucket_of(F.col("term")).alias("bucket")).distinct().collect())
    rows = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets))
    return rows.join(bounded(current(spark, path, keys).select(*keys, "build")), [*keys, "build"]).join(bounded(wanted.select(*keys, "term").distinct()), [*keys, "term"], "left_semi")


def search(spark: SparkSession, path: str, queries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, query_id, doc_id and BM25 score of questions (keys, query_id, text), from the index alone."""
    wanted = cut(rt.wanted_terms(queries, keys))
    found = cut(postings(spark, path, keys, wanted).select(*keys, "doc_id", "term", "tf", "dl"))
    frequencies = found.groupBy(*keys, "term").agg(F.count("*").alias("df"))
    return rt.scored(found, frequencies, current(spark, path, keys).drop("build"), wanted, keys)


#: Postings of a group of documents whose scores are made at once.
POSTINGS = 1_000_000


def search_top(spark: SparkSession, path: str, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of ``search``, ranked: a posting moves once, to its document's, and only the best of a group of documents move on.

    The postings of the wanted terms are read twice, for the terms' frequencies first, and not kept. Where
    questions have more terms than are sent to the tasks, the postings meet them in joins.
    """
    wanted = cut(rt.wanted_terms(queries, keys))
    by = [*keys, "query_id"]
    terms = sorted(r.term for r in wanted.select("term").distinct().limit(rt.BROADCAST_ROWS + 1).collect())
    if len(terms) > rt.BROADCAST_ROWS:
        return rt.best(search(spark, path, queries, keys), by, rt.by_score(), k)
    buckets = sorted(r.bucket for r in wanted.select(bucket_of(F.col("term")).alias("bucket")).distinct().collect())
    rows = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets))
    now = current(spark, path, keys)
    found = rt.numbered(rows.join(bounded(now.select(*keys, "build")), [*keys, "build"]), terms)
    frequencies = cut(found.groupBy(*keys, "term").agg(F.count("*").alias("df")))
    asked = rt.Asked.of(rt.rated(rt.numbered(wanted, terms), frequencies, now.drop("build"), keys), keys)
    if asked is None:
        return rt.best(search(spark, path, queries, keys), by, rt.by_score(), k)
    groups = -(-(frequencies.agg(F.sum("df")).first()[0] or 1) // POSTINGS)
    schema = f"{rt.types_of(rows, keys)}, {rt.types_of(wanted, ['query_id'])}, {rt.types_of(rows, ['doc_id'])}, score double"

    typed = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def top(part):
        owner, _ = owners_of([part.column(c).combine_chunks() for c in keys])
        ids = part.column("doc_id").combine_chunks().dictionary_encode()
        _, first, doc = np.unique(owner * max(len(ids.dictionary), 1) + ids.indices.to_numpy(), return_index=True, return_inverse=True)
        order = np.argsort(doc, kind="stable")
        docs = part.select([*keys, "doc_id", "dl"]).take(pa.array(first)).combine_chunks().to_batches()[0]
        term, tf = (part.column(c).combine_chunks().take(pa.array(order)) for c in ("term", "tf"))
        return pa.Table.from_batches(asked.best(docs, term, tf, doc[order], k), typed)

    met = found.select(*keys, "doc_id", "term", "tf", "dl", F.pmod(F.xxhash64(*keys, "doc_id"), F.lit(groups)).alias("met")).groupBy("met")
    return rt.best(met.applyInArrow(top, schema), by, rt.by_score(), k)


def compact(spark: SparkSession, path: str, to: str, keys: list[str]) -> None:
    """Writes the current builds of an index to another folder."""
    now = current(spark, path, keys)
    rows = spark.read.parquet(f"{path}/postings").join(bounded(now.select(*keys, "build")), [*keys, "build"])
    rows.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).sortWithinPartitions("bucket", *keys, "term").write.partitionBy("bucket").parquet(f"{to}/postings")
    now.write.parquet(f"{to}/recordings")
