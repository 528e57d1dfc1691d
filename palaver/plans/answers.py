"""Answer checks, numeric guard, request cache, batches, job candidates and response parsing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palaver.functions import text as tx
from palaver.operators import answer as an
from palaver.plans.base import query
from palaver.session import table

def sql_id(n):
    return f"'S' || CASE WHEN {n} < 1000 THEN lpad(CAST({n} AS VARCHAR), 3, '0') ELSE CAST({n} AS VARCHAR) END"


#: Every document is an answer that cites itself and another document of the whole table.
ANSWERS = f"""a AS (SELECT doc_id AS answer_id, {sql_id('doc_id')} AS c1, {sql_id('((doc_id * 7) % n)')} AS c2 FROM documents, (SELECT max(doc_id) + 1 AS n FROM documents) x),
ctx AS (SELECT *, CASE WHEN answer_id % 3 = 0 THEN [c1] WHEN answer_id % 3 = 1 THEN [c1, c2] ELSE ['S999999999'] END AS context FROM a)"""


def sid(n):
    return F.concat(F.lit("S"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")))


def answers(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id")
    n = docs.agg((F.max("doc_id") + 1).alias("n"))  # one row
    named = docs.crossJoin(F.broadcast(n)).select("doc_id", sid(F.col("doc_id")).alias("one"), sid(F.col("doc_id") * 7 % F.col("n")).alias("two"))
    text = F.concat(F.lit("As said ["), "one", F.lit(", "), "two", F.lit("] and S001 ["), "one", F.lit("]"))
    context = F.when(F.col("doc_id") % 3 == 0, F.array("one")).when(F.col("doc_id") % 3 == 1, F.array("one", "two")).otherwise(F.array(F.lit("S999999999")))
    return named.select(F.col("doc_id").alias("answer_id"), text.alias("text"), context.alias("context"))


@query(f"WITH {ANSWERS} SELECT answer_id, c1 || ',' || c2 || ',' || c1 AS cited FROM a")
def citation_extract(spark, folder):
    return answers(spark, folder).select("answer_id", F.array_join(tx.citations(F.col("text")), ",").alias("cited"))


CHECKED = ANSWERS + ", good AS (SELECT answer_id, CASE WHEN answer_id % 3 = 2 THEN '' WHEN c1 = c2 OR answer_id % 3 = 0 THEN c1 ELSE c1 || ',' || c2 END AS good, CASE WHEN answer_id % 3 = 2 THEN CASE WHEN c1 = c2 THEN c1 ELSE c1 || ',' || c2 END WHEN answer_id % 3 = 0 AND c1 <> c2 THEN c2 ELSE '' END AS bad FROM ctx)"


@query(f"WITH {CHECKED} SELECT answer_id, good, bad, good = '' AS refused FROM good")
def citation_validate(spark, folder):
    return an.check_citations(answers(spark, folder)).select("answer_id", F.array_join("good", ",").alias("good"), F.array_join("bad", ",").alias("bad"), "refused")


@query(f"WITH {CHECKED}, c AS (SELECT answer_id, unnest(string_split(good, ',')) AS segment_id FROM good WHERE good <> ''), s AS (SELECT {sql_id('doc_id')} AS segment_id, source, lang FROM documents) SELECT c.answer_id, c.segment_id, s.source AS speaker, s.lang FROM c LEFT JOIN s ON c.segment_id = s.segment_id")
def evidence_cards(spark, folder):
    segments = table(spark, folder, "documents").select(sid(F.col("doc_id")).alias("segment_id"), F.col("source").alias("speaker"), "lang")
    return an.evidence_cards(an.check_citations(answers(spark, folder)), segments).select("answer_id", "segment_id", "speaker", "lang")


STRIPPED = """b AS (SELECT answer_id, c1, c2, answer_id % 3 = 2 AS b1, answer_id % 3 = 2 OR answer_id % 3 = 0 AND c1 <> c2 AS b2 FROM ctx)
SELECT answer_id, 'As said ' || CASE WHEN b1 AND b2 AND c2 < c1 THEN 'and ' WHEN b1 AND b2 THEN ' and ' WHEN b2 THEN '[' || c1 || ',  and ' ELSE '[' || c1 || ', ' || c2 || '] and ' END || CASE WHEN b1 AND c1 = 'S001' OR b2 AND c2 = 'S001' THEN '' ELSE 'S001 ' END || CASE WHEN b1 THEN '' ELSE '[' || c1 || ']' END AS body FROM b"""


@query(f"WITH {ANSWERS}, {STRIPPED}")
def citation_strip(spark, folder):
    checked = an.check_citations(answers(spark, folder))
    return checked.select("answer_id", an.strip_citations(F.col("text"), F.col("bad")).alias("body"))


GUARD = r"""g AS (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' 1,000 crore' WHEN 1 THEN ' 12.5 lakhs' ELSE '' END AS a, lead(text || CASE turn % 3 WHEN 0 THEN ' 1000 crores' WHEN 1 THEN ' 12.5 thousand' ELSE '' END) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
w AS (SELECT * FROM (VALUES ('hundred', 100), ('thousand', 1000), ('lakh', 100000), ('crore', 10000000), ('million', 1000000), ('billion', 1000000000)) v(word, worth)),
dig AS (SELECT conv_id, turn, list_sort(list_transform(regexp_extract_all(a, '[0-9][0-9,.]*'), lambda x: rtrim(replace(x, ',', ''), '.'))) AS da, list_sort(list_transform(regexp_extract_all(b, '[0-9][0-9,.]*'), lambda x: rtrim(replace(x, ',', ''), '.'))) AS db,
 list_sort(regexp_extract_all(lower(a), '\b(hundred|thousand|lakh|crore|million|billion)s?\b', 1)) AS sa, list_sort(regexp_extract_all(lower(b), '\b(hundred|thousand|lakh|crore|million|billion)s?\b', 1)) AS sb FROM g WHERE b IS NOT NULL),
p AS (SELECT conv_id, turn, CASE WHEN da <> db THEN 'digits' END AS d, CASE WHEN len(sa) > 0 AND sa <> sb THEN 'scale' END AS s FROM dig)"""


def guarded(spark, folder):
    number = lambda x, y: F.when(F.col("turn") % 3 == 0, x).when(F.col("turn") % 3 == 1, y).otherwise("")
    conv = table(spark, folder, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = conv.select("conv_id", "turn", F.concat("text", number(" 1,000 crore", " 12.5 lakhs")).alias("a"), F.lead(F.concat("text", number(" 1000 crores", " 12.5 thousand"))).over(w).alias("b"))
    return pairs.where("b is not null").select("conv_id", "turn", tx.numeric_guard(F.col("a"), F.col("b"), tx.ENGLISH_NUMBER_WORDS, tx.ENGLISH_NUMBER_WORDS).alias("problems"))


@query(f"WITH {GUARD} SELECT conv_id, turn, concat_ws(',', d, s) AS problems FROM p")
def numeric_guard(spark, folder):
    return guarded(spark, folder).withColumn("problems", F.array_join("problems", ","))


@query(f"WITH {GUARD} SELECT conv_id, count(*) FILTER (WHERE d IS NOT NULL OR s IS NOT NULL) AS n_flagged, count(d) AS n_digits, count(s) AS n_scale FROM p GROUP BY conv_id")
def numeric_flag_counts(spark, folder):
    has = lambda kind: F.count_if(F.array_contains("problems", kind))
    return guarded(spark, folder).groupBy("conv_id").agg(F.count_if(F.size("problems") > 0).alias("n_flagged"), has("digits").alias("n_digits"), has("scale").alias("n_scale"))


def keys(spark, folder):
    body = F.regexp_replace("text", r"[^a-z ]", "")
    return table(spark, folder, "documents").select("doc_id", tx.request_key(model=F.lit("m"), body=body).alias("request"))


KEYS = """k AS (SELECT doc_id, sha256('{"body":"' || CASE WHEN length(b) > 4096 THEN 'sha256:' || sha256(b) ELSE b END || '","model":"m"}') AS request FROM (SELECT doc_id, regexp_replace(text, '[^a-z ]', '', 'g') AS b FROM documents) x)"""


@query(f"WITH {KEYS} SELECT doc_id, request FROM k")
def cache_keys(spark, folder):
    return keys(spark, folder)


@query(f"WITH {KEYS} SELECT request, min(doc_id) AS doc_id FROM k WHERE request NOT IN (SELECT request FROM k WHERE doc_id % 5 = 0) GROUP BY request")
def cache_antijoin(spark, folder):
    k = keys(spark, folder)
    return k.join(k.where("doc_id % 5 = 0").select("request"), "request", "left_anti").groupBy("request").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT source, batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 15 AS batch FROM documents) x GROUP BY source, batch")
def batch_membership(spark, folder):
    from palaver.operators.ranks import ranked_rows

    placed = ranked_rows(table(spark, folder, "documents").select("doc_id", "source"), ["source"], [F.col("doc_id").asc()])
    rows = placed.select("doc_id", "source", F.expr("(rank - 1) div 15").alias("batch"))
    return rows.groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("SELECT o.o_orderkey, coalesce(l.n, 0) AS n_kinds, CASE WHEN l.n IS NULL THEN 'new' WHEN l.n >= 4 THEN 'complete' ELSE 'partial' END AS state FROM orders o LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey")
def candidate_state(spark, folder):
    have = table(spark, folder, "lineitem").where("l_shipdate is not null").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_linenumber").alias("n"))
    state = F.when(F.col("n").isNull(), "new").when(F.col("n") >= 4, "complete").otherwise("partial")
    return table(spark, folder, "orders").select("o_orderkey").join(have, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_kinds"), state.alias("state"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 10 = 3 THEN 'parse' ELSE 'ok' END AS outcome FROM events")
def json_response_parse(spark, folder):
    fenced = F.when(F.col("event_id") % 10 == 3, F.lit("```json\n{broken\n```")).when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    parsed = F.from_json(tx.strip_fence(fenced), "k long")
    rows = table(spark, folder, "events").select("event_id", parsed["k"].alias("k"))
    return rows.withColumn("outcome", F.when(F.col("k").isNull(), "parse").otherwise("ok"))
