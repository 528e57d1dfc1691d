"""Graph queries: orders are segments of forty recordings; customers, suppliers, nations and parts are entities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palaver.functions import text as tx
from palaver.operators import graph as gr
from palaver.operators import provenance as pv
from palaver.plans.base import query
from palaver.session import cut, sized, table

#: Recordings that orders are dealt to; the segments of each are numbered from 1, so their ids overlap.
RECORDINGS = 40
KEYS = ["video_id"]


def sql_video(key: str) -> str:
    return f"'V' || CAST({key} % {RECORDINGS} AS VARCHAR)"


def sql_ordinal(key: str) -> str:
    return f"({key} // {RECORDINGS} + 1)"


def sql_segment(n: str) -> str:
    return f"'S' || CASE WHEN {n} < 1000 THEN lpad(CAST({n} AS VARCHAR), 3, '0') ELSE CAST({n} AS VARCHAR) END"


def placed(df, key):
    """df with video_id and ordinal of an order."""
    at = F.col(key)
    return df.withColumn("video_id", F.concat(F.lit("V"), (at % RECORDINGS).cast("string"))).withColumn("ordinal", F.floor(at / RECORDINGS).cast("long") + 1)


MENTIONS = f"""mention AS (SELECT 'PERSON' AS kind, c_name AS name, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'PARTY', n_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'TOPIC', p_name, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey),
node AS (SELECT {sql_video('k')} AS video_id, kind || ':' || lower(trim(name)) AS key, min(kind) AS kind, min(name) AS label, count(DISTINCT k) AS n_provenance, min({sql_ordinal('k')}) AS first_ordinal FROM mention GROUP BY 1, 2)"""
EDGES = f"""talk AS (SELECT 'PERSON:' || lower(c_name) AS source, 'TOPIC:' || lower(trim(p_name)) AS target, o_orderkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
member AS (SELECT 'PERSON:' || lower(c_name) AS source, 'PARTY:' || lower(n_name) AS target, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
edge AS (SELECT {sql_video('k')} AS video_id, predicate, source, target, min({sql_ordinal('k')}) AS first_ordinal, count(DISTINCT k) AS n_provenance FROM (SELECT 'discussed' AS predicate, * FROM talk UNION ALL SELECT 'member of', * FROM member) GROUP BY 1, 2, 3, 4)"""


def people(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))


def mentions(spark, folder):
    who = people(spark, folder)
    persons = who.select(F.lit("PERSON").alias("kind"), F.col("c_name").alias("name"), F.col("o_orderkey").alias("k"))
    parties = who.join(F.broadcast(table(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("PARTY").alias("kind"), F.col("n_name").alias("name"), F.col("o_orderkey").alias("k"))
    topics = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, folder, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select(F.lit("TOPIC").alias("kind"), F.col("p_name").alias("name"), F.col("l_orderkey").alias("k"))
    return placed(persons.unionAll(parties).unionAll(topics), "k").withColumn("ord", F.lit(0))  # the smallest spelling stands


def edges(spark, folder):
    """Edges of both predicates. Joins and sets are made in partitions by the rows of lineitem and orders, which the files' footers have."""
    lineitem, orders = (table(spark, folder, t) for t in ("lineitem", "orders"))
    n_lines, n_orders = lineitem.count(), orders.count()
    customer, part = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey"), table(spark, folder, "part").select("p_partkey", "p_name")
    who = sized(orders.select("o_orderkey", "o_custkey"), n_orders, "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    person = tx.node_key(F.lit("PERSON"), F.col("c_name"))
    lines = sized(lineitem.select("l_orderkey", "l_partkey"), n_lines, "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    talk = sized(lines.select("l_orderkey", "p_name"), n_lines, "l_orderkey").join(who, F.col("l_orderkey") == F.col("o_orderkey")).select(person.alias("source"), tx.node_key(F.lit("TOPIC"), F.col("p_name")).alias("target"), "o_orderkey")
    member = who.join(F.broadcast(table(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(person.alias("source"), tx.node_key(F.lit("PARTY"), F.col("n_name")).alias("target"), "o_orderkey")
    # dealt by the edge, which both groupings of its set keep: no second shuffle
    apart = [sized(placed(e, "o_orderkey"), n, *KEYS, "source", "target") for e, n in ((talk, n_lines), (member, n_orders))]
    named = [gr.first_edges(e, KEYS).withColumn("predicate", F.lit(p)) for p, e in zip(("discussed", "member of"), apart, strict=True)]
    return named[0].unionByName(named[1])


@query(f"WITH {MENTIONS} SELECT video_id, key, kind, label, n_provenance, first_ordinal FROM node")
def graph_nodes(spark, folder):
    nodes = gr.build_nodes(mentions(spark, folder), KEYS)
    return nodes.select("video_id", "key", "kind", "label", pv.size_of(F.col("words")).alias("n_provenance"), pv.first_of(F.col("words")).alias("first_ordinal"))


@query(f"WITH {EDGES} SELECT video_id, predicate, source, target, first_ordinal, n_provenance FROM edge")
def graph_edges(spark, folder):
    return edges(spark, folder).select("video_id", "predicate", "source", "target", pv.first_of(F.col("words")).alias("first_ordinal"), pv.size_of(F.col("words")).alias("n_provenance"))


@query(f"WITH {MENTIONS} SELECT video_id, kind, count(*) AS n FROM node GROUP BY video_id, kind")
def node_type_histogram(spark, folder):
    return gr.build_nodes(mentions(spark, folder), KEYS).groupBy("video_id", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES}, e AS (SELECT video_id, source AS key FROM edge UNION ALL SELECT video_id, target FROM edge), d AS (SELECT video_id, key, count(*) AS degree FROM e GROUP BY video_id, key) SELECT video_id, key, degree FROM d QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY degree DESC, key) <= 10")
def degree_topk(spark, folder):
    ranked = gr.degrees(edges(spark, folder), KEYS).withColumn("rn", F.row_number().over(Window.partitionBy("video_id").orderBy(F.col("degree").desc(), "key")))
    return ranked.where("rn <= 10").select("video_id", "key", "degree")


@query(f"WITH {MENTIONS}, t AS (SELECT {sql_video('o_orderkey')} AS video_id, {sql_ordinal('o_orderkey')} AS n, epoch_us(o_orderdate) // 1000 AS t FROM orders) SELECT node.video_id, key, coalesce(t, 0) AS first_seen FROM node LEFT JOIN t ON t.video_id = node.video_id AND t.n = first_ordinal")
def first_seen(spark, folder):
    """When the first segment of each node was: segments are in order of time, so it is the smallest ordinal's."""
    from palaver.plans.base import millis

    times = placed(table(spark, folder, "orders"), "o_orderkey").select("video_id", "ordinal", millis("o_orderdate").alias("t"))
    nodes = gr.build_nodes(mentions(spark, folder), KEYS).select("video_id", "key", pv.first_of(F.col("words")).alias("ordinal"))
    return nodes.join(times, ["video_id", "ordinal"], "left").select("video_id", "key", F.coalesce("t", F.lit(0).cast("long")).alias("first_seen"))


@query(f"""WITH r AS (SELECT DISTINCT {sql_video('l_orderkey')} AS video_id, l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_linenumber = 7 THEN [] WHEN l_linenumber % 3 = 0 THEN [{sql_ordinal('l_orderkey')}, {sql_ordinal('l_orderkey')} + 1] ELSE [{sql_ordinal('l_orderkey')}] END AS ids FROM lineitem),
k AS (SELECT {sql_video('o_orderkey')} AS video_id, {sql_ordinal('o_orderkey')} AS id FROM orders WHERE o_orderstatus <> 'P')
SELECT video_id, row_id FROM r WHERE len(ids) > 0 AND NOT EXISTS (SELECT 1 FROM (SELECT video_id, row_id, unnest(ids) AS id FROM r) x LEFT JOIN k ON k.video_id = x.video_id AND k.id = x.id WHERE x.video_id = r.video_id AND x.row_id = r.row_id AND k.id IS NULL)""")
def provenance_filter(spark, folder):
    rows = placed(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey")
    one, two = pv.segment_name(F.col("ordinal")), pv.segment_name(F.col("ordinal") + 1)
    ids = F.when(F.col("l_linenumber") == 7, F.array().cast("array<string>")).when(F.col("l_linenumber") % 3 == 0, F.array(one, two)).otherwise(F.array(one))
    rows = rows.select("video_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), ids.alias("ids"))
    known = placed(table(spark, folder, "orders").where("o_orderstatus <> 'P'"), "o_orderkey").select("video_id", pv.segment_name(F.col("ordinal")).alias("id"))
    return gr.provenance_filter(rows, known, KEYS).select("video_id", "row_id")


@query("SELECT p_partkey, CASE WHEN trim(regexp_replace(upper(trim(p_type || ' -> ' || p_name || '!')), '[^A-Za-z0-9]+', '_', 'g'), '_') = '' THEN 'RELATED_TO' ELSE trim(regexp_replace(upper(trim(p_type || ' -> ' || p_name || '!')), '[^A-Za-z0-9]+', '_', 'g'), '_') END AS rel FROM part")
def rel_type_sanitise(spark, folder):
    return table(spark, folder, "part").select("p_partkey", tx.relation_type(F.concat("p_type", F.lit(" -> "), "p_name", F.lit("!"))).alias("rel"))


ASSEMBLED = f"""ro AS (SELECT s_suppkey, 'M' || CAST(s_suppkey AS VARCHAR) AS member_id, s_name, CASE WHEN s_suppkey % 3 > 0 THEN 'த' || CAST(s_suppkey AS VARCHAR) END AS tamil, n_name AS party FROM supplier JOIN nation ON s_nationkey = n_nationkey),
me AS (SELECT {sql_video('l_orderkey')} AS video_id, 'PERSON:' || lower(trim(s_name)) AS key, 'PERSON' AS type, s_name AS label, tamil, party, member_id, {sql_ordinal('l_orderkey')} AS n, l_orderkey * 10 + l_linenumber AS ord FROM lineitem JOIN ro ON l_suppkey = s_suppkey
UNION ALL SELECT {sql_video('l_orderkey')}, 'TOPIC:' || lower(trim(p_name)), 'TOPIC', CASE WHEN l_orderkey % 2 = 0 THEN upper(p_name) ELSE p_name || ' ' END, CASE WHEN l_linenumber % 2 = 0 THEN 'ப' || CAST(p_partkey AS VARCHAR) END, NULL, NULL, {sql_ordinal('l_orderkey')}, l_orderkey * 10 + l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey),
fi AS (SELECT *, row_number() OVER (PARTITION BY video_id, key ORDER BY ord, label, type, tamil NULLS FIRST, party NULLS FIRST, member_id NULLS FIRST) AS rn FROM me), ids AS (SELECT video_id, key, string_agg({sql_segment('n')}, ',' ORDER BY n) AS ids FROM (SELECT DISTINCT video_id, key, n FROM me) GROUP BY video_id, key)"""


def roster(spark, folder):
    who = table(spark, folder, "supplier").join(F.broadcast(table(spark, folder, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    tamil = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("த"), F.col("s_suppkey").cast("string")))
    return who.select(F.concat(F.lit("M"), F.col("s_suppkey").cast("string")).alias("member_id"), F.col("s_name").alias("name"), tamil.alias("tamil_name"), F.col("n_name").alias("party_code"), F.array(F.lit("Member")).alias("roles"), F.lit(None).cast("string").alias("portrait"))


def assembled(spark, folder):
    """Nodes of members and topics of each recording, all lines of its orders being their mentions."""
    lines = placed(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"), "l_orderkey")
    lines = lines.withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    none = F.lit(None).cast("string")
    members = lines.select("video_id", F.lit("PERSON").alias("kind"), F.lit("").alias("name"), none.alias("tamil"), F.concat(F.lit("M"), F.col("l_suppkey").cast("string")).alias("member_id"), "ordinal", "ord")
    parts = lines.join(table(spark, folder, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    spelling = F.when(F.col("l_orderkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" ")))
    tamil = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("ப"), F.col("p_partkey").cast("string"))).otherwise("")
    topics = parts.select("video_id", F.lit("TOPIC").alias("kind"), spelling.alias("name"), tamil.alias("tamil"), none.alias("member_id"), "ordinal", "ord")
    return gr.assemble_nodes(members.unionAll(topics), roster(spark, folder), KEYS)


@query(f"WITH {ASSEMBLED} SELECT fi.video_id, fi.key, type, label, tamil, party, member_id, ids FROM fi JOIN ids ON fi.video_id = ids.video_id AND fi.key = ids.key WHERE rn = 1")
def graph_assembly(spark, folder):
    return assembled(spark, folder).select("video_id", "key", "type", "label", "tamil", "party", "member_id", F.array_join(pv.segment_names(F.col("words")), ",").alias("ids"))


@query(f"WITH {ASSEMBLED} SELECT DISTINCT video_id, key AS source, 'PARTY:' || lower(party) AS target, 'member of' AS predicate FROM me WHERE member_id IS NOT NULL")
def roster_edges(spark, folder):
    return gr.roster_edges(assembled(spark, folder), KEYS).select("video_id", "source", "target", "predicate")


TALK = ASSEMBLED + f""", sg AS (SELECT {sql_video('o_orderkey')} AS video_id, {sql_ordinal('o_orderkey')} AS n, 'M' || CAST(o_custkey % (SELECT max(s_suppkey) + 1 FROM supplier) AS VARCHAR) AS member_id FROM orders),
di AS (SELECT DISTINCT t.video_id, p.key AS source, t.key AS target, t.n FROM (SELECT DISTINCT video_id, key, n FROM me WHERE type = 'TOPIC') t JOIN sg ON sg.video_id = t.video_id AND sg.n = t.n JOIN (SELECT DISTINCT video_id, key, member_id FROM me WHERE type = 'PERSON') p ON p.video_id = t.video_id AND p.member_id = sg.member_id)"""


def spoken(spark, folder):
    """Every order is a segment, spoken by a member or by someone who is none."""
    n = table(spark, folder, "supplier").agg((F.max("s_suppkey") + 1).alias("n"))
    rows = placed(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").crossJoin(F.broadcast(n))  # one row
    return rows.select("video_id", "ordinal", F.concat(F.lit("M"), (F.col("o_custkey") % F.col("n")).cast("string")).alias("member_id"))


def discussed(spark, folder):
    nodes = cut(assembled(spark, folder).select(*KEYS, "key", "type", "member_id", "words"))  # read for topics and for people
    return gr.discussed_edges(nodes, spoken(spark, folder), KEYS)


@query(f"WITH {TALK} SELECT video_id, source, target, {sql_segment('min(n)')} AS first_id, string_agg({sql_segment('n')}, ',' ORDER BY n) AS ids FROM di GROUP BY video_id, source, target")
def discussed_edges(spark, folder):
    words = F.col("words")
    return discussed(spark, folder).select("video_id", "source", "target", pv.segment_name(pv.first_of(words)).alias("first_id"), F.array_join(pv.segment_names(words), ",").alias("ids"))


#: Every twentieth part asks, in each recording, for its own name, a Tamil name and a supplier.
EVERY = 20


@query(f"""WITH {TALK}, v AS (SELECT DISTINCT video_id FROM me), nd AS (SELECT video_id, key, trim(label) AS bare, label, tamil, ord FROM fi WHERE rn = 1),
q AS (SELECT video_id, p_partkey AS query_id, 'What of ' || p_name || ' , ப' || CAST(p_partkey + 1 AS VARCHAR) || ' and ' || coalesce(s_name, '?') || '?' AS text FROM part LEFT JOIN supplier ON s_suppkey = p_partkey, v WHERE p_partkey % {EVERY} = 0),
nm AS (SELECT DISTINCT q.video_id, q.query_id, nd.key, nd.ord FROM q JOIN nd ON q.video_id = nd.video_id AND (length(nd.label) > 2 AND contains(lower(q.text), lower(nd.label)) OR nd.tamil <> '' AND contains(q.text, nd.tamil))),
ed AS (SELECT video_id, source, target, min(n) AS ord FROM di GROUP BY video_id, source, target),
bo AS (SELECT video_id, source AS key, target AS other, ord, 0 AS side FROM ed UNION ALL SELECT video_id, target, source, ord, 1 FROM ed), nb AS (SELECT *, row_number() OVER (PARTITION BY video_id, key ORDER BY ord, side, other) AS rn FROM bo),
pr AS (SELECT video_id, key, n, row_number() OVER (PARTITION BY video_id, key ORDER BY n) - 1 AS pos FROM (SELECT DISTINCT video_id, key, n FROM me)),
h AS (SELECT nm.video_id, nm.query_id, nm.ord, nm.key, 0 AS rn, pos, n FROM nm JOIN pr ON pr.video_id = nm.video_id AND pr.key = nm.key
UNION ALL SELECT nm.video_id, nm.query_id, nm.ord, nm.key, nb.rn, pos, n FROM nm JOIN nb ON nb.video_id = nm.video_id AND nb.key = nm.key AND nb.rn <= 4 JOIN pr ON pr.video_id = nm.video_id AND pr.key = nb.other AND pos < 2),
f AS (SELECT *, row_number() OVER (PARTITION BY video_id, query_id, n ORDER BY ord, key, rn, pos) AS k FROM h), z AS (SELECT *, row_number() OVER (PARTITION BY video_id, query_id ORDER BY ord, key, rn, pos, n) AS rank FROM f WHERE k = 1)
SELECT video_id, query_id, {sql_segment('n')} AS id, rank FROM z WHERE rank <= 6""")
def graph_expand(spark, folder):
    nodes = cut(assembled(spark, folder).drop("party", "roles", "portrait"))  # read for names, links and provenance
    recordings = nodes.select("video_id").distinct()
    part = table(spark, folder, "part").where(F.col("p_partkey") % EVERY == 0).select("p_partkey", "p_name")
    named = part.join(table(spark, folder, "supplier").select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("p_partkey"), "left")
    text = F.concat(F.lit("What of "), "p_name", F.lit(" , ப"), (F.col("p_partkey") + 1).cast("string"), F.lit(" and "), F.coalesce("s_name", F.lit("?")), F.lit("?"))
    asked = named.select(F.col("p_partkey").alias("query_id"), text.alias("text")).crossJoin(F.broadcast(recordings))  # the questions of every recording
    return gr.expand(asked, nodes, gr.discussed_first(nodes, spoken(spark, folder), KEYS), KEYS)


ENDS = f"""nd AS (SELECT CASE WHEN s_suppkey % 2 = 1 THEN 'PERSON:' ELSE 'AMOUNT:' END || lower(s_name) AS key, s_suppkey AS k FROM supplier UNION ALL SELECT CASE p_partkey % 3 WHEN 0 THEN 'TOPIC:' WHEN 1 THEN 'SCHEME:' ELSE 'LAW:' END || lower(p_name), p_partkey FROM part UNION ALL SELECT 'PLACE:' || lower(n_name), n_nationkey FROM nation UNION ALL SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'PARTY:' ELSE 'DATE:' END || lower(n_name), n_nationkey FROM nation),
vd AS (SELECT DISTINCT 'V' || CAST(i AS VARCHAR) AS video_id, key FROM nd, (SELECT unnest(range({RECORDINGS})) AS i) WHERE (k + i) % 3 > 0),
re AS (SELECT DISTINCT {sql_video('l_orderkey')} AS video_id, {sql_ordinal('l_orderkey')} || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS id, CASE WHEN l_linenumber = 4 THEN 'nobody' ELSE s_name END AS subject, CASE l_linenumber % 3 WHEN 0 THEN p_name WHEN 1 THEN n_name ELSE s_name END AS object FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN nation ON n_nationkey = (l_orderkey + s_nationkey) % 25),
nm AS (SELECT video_id, subject AS name FROM re UNION SELECT video_id, object FROM re), ty AS (SELECT * FROM (VALUES ('PARTY', 1), ('SCHEME', 2), ('PLACE', 3), ('AMOUNT', 4), ('LAW', 5), ('DATE', 6), ('TOPIC', 7), ('PERSON_EXTERNAL', 8)) v(type, rank)),
tr AS (SELECT video_id, name, 'PERSON:' || lower(trim(name)) AS key, 0 AS rank FROM nm WHERE name IN (SELECT s_name FROM supplier) UNION ALL SELECT video_id, name, type || ':' || lower(trim(name)), rank FROM nm, ty WHERE name NOT IN (SELECT s_name FROM supplier)),
fo AS (SELECT tr.video_id, name, arg_min(tr.key, rank) AS key FROM tr JOIN vd ON tr.key = vd.key AND tr.video_id = vd.video_id GROUP BY tr.video_id, name)"""


@query(f"WITH {ENDS} SELECT re.video_id, re.id AS relation_id, a.key AS source, b.key AS target FROM re JOIN fo a ON re.subject = a.name AND re.video_id = a.video_id JOIN fo b ON re.object = b.name AND re.video_id = b.video_id WHERE a.key <> b.key")
def edge_endpoints(spark, folder):
    supplier, part, nation = (table(spark, folder, t) for t in ("supplier", "part", "nation"))
    typed = lambda df, kind, name, k: df.select(tx.node_key(kind, F.col(name)).alias("key"), F.col(k).alias("k"))
    nodes = typed(supplier, F.when(F.col("s_suppkey") % 2 == 1, "PERSON").otherwise("AMOUNT"), "s_name", "s_suppkey")
    nodes = nodes.union(typed(part, F.when(F.col("p_partkey") % 3 == 0, "TOPIC").when(F.col("p_partkey") % 3 == 1, "SCHEME").otherwise("LAW"), "p_name", "p_partkey"))
    nodes = nodes.union(typed(nation, F.lit("PLACE"), "n_name", "n_nationkey")).union(typed(nation, F.when(F.col("n_nationkey") % 5 == 0, "PARTY").otherwise("DATE"), "n_name", "n_nationkey"))
    every = nodes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(RECORDINGS - 1)))).where((F.col("k") + F.col("i")) % 3 > 0)  # two in three recordings have a node
    every = every.select(F.concat(F.lit("V"), F.col("i").cast("string")).alias("video_id"), "key").distinct()
    lines = table(spark, folder, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    lines = placed(lines.join(F.broadcast(nation), F.col("n_nationkey") == (F.col("l_orderkey") + F.col("s_nationkey")) % 25), "l_orderkey")
    subject = F.when(F.col("l_linenumber") == 4, "nobody").otherwise(F.col("s_name"))
    object_ = F.when(F.col("l_linenumber") % 3 == 0, F.col("p_name")).when(F.col("l_linenumber") % 3 == 1, F.col("n_name")).otherwise(F.col("s_name"))
    relations = lines.select("video_id", F.concat_ws("-", "ordinal", "l_linenumber", "l_partkey", "l_suppkey").alias("relation_id"), subject.alias("subject"), F.lit("names").alias("predicate"), object_.alias("object"), F.array(pv.segment_name(F.col("ordinal"))).alias("segment_ids")).distinct()
    members = supplier.select(F.col("s_name").alias("alias"), F.col("s_name").alias("name"))
    return gr.resolve_endpoints(relations, every, members, KEYS).select("video_id", "relation_id", "source", "target")
