"""Retrieval queries: documents are the segments of 25 recordings, benchmark items the questions, asked of each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palaver.functions import text as tx
from palaver.operators import index as ix
from palaver.operators import retrieval as rt
from palaver.plans.base import query
from palaver.session import cut, remove_folder, shared_folder, spread, table

TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
#: Questions are the whole texts of all rows, or where vectors are asked too of those whose ids this divides; recordings, whose documents are numbered from 0 in each.
EVERY, RECORDINGS = 20, 25
KEYS = ["video_id"]
OWN = f"'V' || CAST(doc_id % {RECORDINGS} AS VARCHAR) AS video_id, doc_id // {RECORDINGS} AS doc_id"
ASKED = f"SELECT 'V' || CAST(i AS VARCHAR) AS video_id, item_id AS query_id, text FROM benchmark, (SELECT unnest(range({RECORDINGS})) AS i)"
SOME = f"{ASKED} WHERE item_id % {EVERY} = 0"


def sql_sparse(asked: str) -> str:
    return f"""docs AS (SELECT {OWN}, text FROM documents), q AS (SELECT video_id, query_id, unnest({TOKENS}) AS term FROM ({asked})),
wanted AS (SELECT video_id, query_id, term, count(*) AS qtf FROM q GROUP BY video_id, query_id, term),
tok AS (SELECT video_id, doc_id, {TOKENS} AS t FROM docs), tf AS (SELECT video_id, doc_id, dl, term, count(*) AS tf FROM (SELECT video_id, doc_id, len(t) AS dl, unnest(t) AS term FROM tok) x GROUP BY video_id, doc_id, dl, term),
tot AS (SELECT video_id, count(*) AS n, avg(len(t)) AS avgdl FROM tok GROUP BY video_id), raw AS (SELECT video_id, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf JOIN tot USING (video_id) GROUP BY video_id, term, n),
m AS (SELECT video_id, avg(idf) AS mean_idf FROM raw GROUP BY video_id), idf AS (SELECT video_id, term, CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END AS idf FROM raw JOIN m USING (video_id)),
bm AS (SELECT w.video_id, w.query_id, tf.doc_id, sum(w.qtf * idf.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * tf.dl / tot.avgdl))) AS score FROM wanted w JOIN tf ON w.term = tf.term AND w.video_id = tf.video_id JOIN idf ON idf.term = w.term AND idf.video_id = w.video_id JOIN tot ON tot.video_id = w.video_id GROUP BY w.video_id, w.query_id, tf.doc_id)"""


SPARSE = sql_sparse(SOME)
HYBRID = f"""nv AS (SELECT max(vec_id) + 1 AS n FROM embeddings), dv AS (SELECT 'V' || CAST(doc_id % {RECORDINGS} AS VARCHAR) AS video_id, doc_id // {RECORDINGS} AS doc_id, embedding FROM documents, nv JOIN embeddings ON vec_id = doc_id % n),
dot AS (SELECT dv.video_id, e.vec_id AS query_id, dv.doc_id, list_dot_product(CAST(dv.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings e, dv WHERE e.vec_id % {EVERY} = 0 AND e.vec_id IN (SELECT item_id FROM benchmark)),
dr AS (SELECT video_id, query_id, doc_id, row_number() OVER (PARTITION BY video_id, query_id ORDER BY round(score, 9) DESC, doc_id) AS dense_rank FROM dot),
sr AS (SELECT video_id, query_id, doc_id, row_number() OVER (PARTITION BY video_id, query_id ORDER BY round(coalesce(score, 0), 9) DESC, doc_id) AS sparse_rank FROM (SELECT dr.video_id, dr.query_id, dr.doc_id, bm.score FROM dr LEFT JOIN bm ON bm.video_id = dr.video_id AND bm.query_id = dr.query_id AND bm.doc_id = dr.doc_id) z),
fu AS (SELECT dr.video_id, dr.query_id, dr.doc_id, dense_rank, sparse_rank, 1.0 / (60 + dense_rank) + 1.0 / (60 + sparse_rank) AS rrf FROM dr JOIN sr ON dr.video_id = sr.video_id AND dr.query_id = sr.query_id AND dr.doc_id = sr.doc_id),
hit AS (SELECT *, row_number() OVER (PARTITION BY video_id, query_id ORDER BY round(rrf, 9) DESC, dense_rank) AS rank FROM fu)"""
TOP = "(SELECT video_id, query_id, doc_id, row_number() OVER (PARTITION BY video_id, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)"


def owned(df, key="doc_id"):
    """df with video_id and doc_id, the number in its recording, of a document or vector."""
    at = F.col(key)
    return df.withColumns({"video_id": F.concat(F.lit("V"), (at % RECORDINGS).cast("string")), "doc_id": F.floor(at / RECORDINGS).cast("long")})


def of_each(df):
    """Questions, asked of every recording."""
    return df.withColumn("video_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(RECORDINGS - 1)), lambda i: F.concat(F.lit("V"), i.cast("string")))))


def questions(spark, folder):
    """The questions of every recording: all of the table."""
    return of_each(table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def some_questions(spark, folder):
    """Those that are asked with a vector too."""
    return questions(spark, folder).where(F.col("query_id") % EVERY == 0)


def corpus(spark, folder):
    return owned(spread(table(spark, folder, "documents").select("doc_id", "text")))


def vectors(spark, folder):
    """Document vectors, and those of the questions: a question has the vector of its own id."""
    v = table(spark, folder, "embeddings")
    n = v.agg((F.max("vec_id") + 1).alias("n"))
    at = table(spark, folder, "documents").select("doc_id").crossJoin(F.broadcast(n)).select("doc_id", (F.col("doc_id") % F.col("n")).alias("vec_id"))
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).where(F.col("query_id") % EVERY == 0)
    asked = asked.join(table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id")), "query_id", "left_semi")
    return owned(at.join(v.select("vec_id", "embedding"), "vec_id").select("doc_id", "embedding")), of_each(asked)


def hits(spark, folder, k):
    docs, asked = corpus(spark, folder), some_questions(spark, folder)
    own, wanted = vectors(spark, folder)
    return rt.hybrid(docs, cut(own), rt.bm25(docs, asked, KEYS), wanted, KEYS, k)


@query("SELECT term, count(*) AS n FROM (SELECT unnest(" + TOKENS + ") AS term FROM documents) x GROUP BY term")
def tokenize_counts(spark, folder):
    return table(spark, folder, "documents").select(F.explode(tx.tokenize(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {sql_sparse(ASKED)} SELECT video_id, query_id, doc_id, rank FROM {TOP} WHERE rank <= 10")
def bm25_topk(spark, folder):
    return rt.bm25_top(corpus(spark, folder), questions(spark, folder), KEYS, 10).select("video_id", "query_id", "doc_id", "rank")


@query(f"WITH {sql_sparse(ASKED)} SELECT video_id, query_id, doc_id, rank FROM {TOP} WHERE rank <= 10")
def stored_index_topk(spark, folder):
    """The same from a stored index, of which a first build had other texts in three of the recordings."""
    import uuid

    docs, path = corpus(spark, folder), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    late = F.col("video_id").isin("V0", "V1", "V7")
    ix.append(docs.withColumn("text", F.when(late, F.reverse("text")).otherwise(F.col("text"))), KEYS, path)
    ix.append(docs.where(late), KEYS, path)
    found = ix.search_top(spark, path, questions(spark, folder), KEYS, 10)
    found = cut(found.select("video_id", "query_id", "doc_id", "rank"))
    remove_folder(spark, path)
    return found


@query(f"WITH v AS (SELECT 'V' || CAST(vec_id % {RECORDINGS} AS VARCHAR) AS video_id, vec_id // {RECORDINGS} AS doc_id, embedding FROM embeddings), d AS (SELECT v.video_id, q.vec_id AS query_id, doc_id, list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings q, v WHERE q.vec_id % {EVERY} = 0), r AS (SELECT *, row_number() OVER (PARTITION BY video_id, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM d) SELECT video_id, query_id, doc_id, rank FROM r WHERE rank <= 10")
def dense_topk(spark, folder):
    v = table(spark, folder, "embeddings")
    asked = of_each(v.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")))
    return rt.dense_top(owned(v.select(F.col("vec_id").alias("doc_id"), "embedding")), asked, KEYS, 10, "rank").select("video_id", "query_id", "doc_id", "rank")


@query(f"WITH {SPARSE}, {HYBRID} SELECT video_id, query_id, doc_id, rank FROM hit WHERE rank <= 6")
def rrf_search(spark, folder):
    return hits(spark, folder, 6).select("video_id", "query_id", "doc_id", "rank")


@query(f"""WITH {SPARSE}, {HYBRID}, c AS (SELECT video_id, query_id, doc_id, rank FROM hit WHERE rank <= 20), mo AS (SELECT video_id, query_id, doc_id, row_number() OVER (PARTITION BY video_id, query_id ORDER BY doc_id % 7, doc_id) AS mr FROM c WHERE doc_id % 2 = 0),
s AS (SELECT c.video_id, c.query_id, c.doc_id, row_number() OVER (PARTITION BY c.video_id, c.query_id ORDER BY coalesce(mr, 1000000), rank) AS final_rank FROM c LEFT JOIN mo ON c.video_id = mo.video_id AND c.query_id = mo.query_id AND c.doc_id = mo.doc_id) SELECT video_id, query_id, doc_id, final_rank FROM s WHERE final_rank <= 6""")
def rerank_splice(spark, folder):
    found = cut(hits(spark, folder, 20).select("video_id", "query_id", "doc_id", "rank"))
    w = Window.partitionBy("video_id", "query_id").orderBy(F.col("doc_id") % 7, "doc_id")
    model = found.where("doc_id % 2 = 0").select("video_id", "query_id", "doc_id", F.row_number().over(w).alias("model_rank"))
    return rt.rerank_splice(found, model, KEYS, 6).select("video_id", "query_id", "doc_id", "final_rank")


@query(f"""WITH {SPARSE}, {HYBRID}, h AS (SELECT video_id, query_id, doc_id, rank FROM hit WHERE rank <= 6), x AS (SELECT * FROM {TOP} WHERE rank <= 6),
u AS (SELECT video_id, query_id, doc_id, 0 AS tier, rank FROM h UNION ALL SELECT x.video_id, x.query_id, x.doc_id, 1, x.rank FROM x WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.video_id = x.video_id AND h.query_id = x.query_id AND h.doc_id = x.doc_id)),
p AS (SELECT video_id, query_id, doc_id, row_number() OVER (PARTITION BY video_id, query_id ORDER BY tier, rank, doc_id) AS place FROM u) SELECT video_id, query_id, doc_id, place FROM p WHERE place <= 8""")
def context_assembly(spark, folder):
    docs, asked = corpus(spark, folder), some_questions(spark, folder)
    own, wanted = vectors(spark, folder)
    scores = cut(rt.bm25(docs, asked, KEYS))  # for the hits and for the extras
    found = rt.hybrid(docs, cut(own), scores, wanted, KEYS, 6).select("video_id", "query_id", "doc_id", "rank")
    extras = rt.best(scores, [*KEYS, "query_id"], rt.by_score(), 6).select("video_id", "query_id", "doc_id", "rank")
    return rt.assemble_context(found, extras, KEYS, 8)


@query("SELECT doc_id, coalesce(source, 'Unknown speaker') || ': ' || coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END, ''), lang || ' ' || text) AS body FROM documents")
def retrieval_text(spark, folder):
    english = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", rt.retrieval_text(F.col("source"), english, F.concat_ws(" ", "lang", "text")).alias("body"))
