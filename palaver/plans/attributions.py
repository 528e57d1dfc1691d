"""Attribution queries: events are evidence, suppliers and customers the roster, labels the votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import text as tx
from palaver.operators import attribution as at
from palaver.operators import roster as rs
from palaver.plans.base import EVENTS, events, query
from palaver.session import table

HOUR = 3_600_000
VOTES = f"""WITH {EVENTS}, e AS (SELECT user_id, t // {24 * HOUR} AS day, event_id AS ord, 'M' || CAST(event_id % 3 AS VARCHAR) AS member, CASE event_type WHEN 'error' THEN 'chyron' ELSE 'introduction' END AS kind FROM ev),
p AS (SELECT user_id, day, member, count(*) AS votes, min(ord) AS f, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM e GROUP BY user_id, day, member),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY votes DESC, f) AS rn, count(*) OVER (PARTITION BY user_id, day) AS members, count(*) FILTER (WHERE kinds LIKE '%chyron%') OVER (PARTITION BY user_id, day) AS shown FROM p),
b AS (SELECT user_id, day, member, votes, kinds, members > 1 AS conflict FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY CASE WHEN members > 1 AND shown = 1 AND kinds LIKE '%chyron%' THEN 0 ELSE rn END) AS pick FROM r) x WHERE pick = 1)"""
LADDER = VOTES + ", c AS (SELECT *, least(CASE WHEN kinds LIKE '%,%' THEN 0.95 WHEN kinds LIKE '%chyron%' THEN 0.85 ELSE 0.75 END, CASE WHEN conflict THEN 0.6 ELSE 1 END) AS confidence FROM b)"


def voted(spark, folder):
    e = events(spark, folder)
    evidence = e.select("user_id", F.floor(F.col("t") / (24 * HOUR)).alias("day"), F.col("event_id").alias("ord"), F.concat(F.lit("M"), (F.col("event_id") % 3).cast("string")).alias("member"), F.when(F.col("event_type") == "error", "chyron").otherwise("introduction").alias("kind"))
    return at.evidence_vote(evidence, ["user_id", "day"])


@query(VOTES + " SELECT user_id, day, member, votes, kinds, conflict FROM b")
def evidence_vote(spark, folder):
    return voted(spark, folder).withColumn("kinds", F.array_join("kinds", ","))


@query(LADDER + " SELECT user_id, day, member, CAST(confidence AS DOUBLE) AS confidence FROM c")
def confidence_ladder(spark, folder):
    return voted(spark, folder).select("user_id", "day", "member", at.confidence_of(F.col("kinds"), F.col("conflict")).alias("confidence"))


PICKS = "g AS (SELECT d.source || '-' || CAST(d.doc_id % 12 AS VARCHAR) AS turn, 'M1' AS expected, CASE l.quality + 2 * l.toxic WHEN 1 THEN 'M1' WHEN 3 THEN 'M2' WHEN 2 THEN 'M9' END AS picked, l.quality + 2 * l.toxic IN (1, 3) AS on_lineup FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
PAIRS = PICKS.replace("d.source || '-' || CAST(d.doc_id % 12 AS VARCHAR)", "CAST(d.doc_id // 2 AS VARCHAR)")
VERDICT = "WITH " + PICKS + ", f AS (SELECT turn, CASE WHEN bool_and(coalesce(picked = expected, false)) THEN 'confirmed' WHEN bool_or(coalesce(picked = expected, false)) THEN 'partial' WHEN bool_or(coalesce(picked <> expected AND on_lineup, false)) THEN 'contradicted' ELSE 'unrecognised' END AS verdict, count(*) AS n_votes FROM g GROUP BY turn)"


def picks(spark, folder, turn=None):
    """All labels as votes on a lineup: M1 is expected, M2 stands beside it, M9 is on no lineup."""
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    code = F.col("quality") + 2 * F.col("toxic")
    picked = F.when(code == 1, "M1").when(code == 3, "M2").when(code == 2, "M9")
    turn = F.concat_ws("-", "source", (F.col("doc_id") % 12).cast("string")) if turn is None else turn
    return rows.select(turn.alias("turn"), F.lit("M1").alias("expected"), picked.alias("picked"), code.isin(1, 3).alias("on_lineup"))


@query(VERDICT + " SELECT turn, verdict, n_votes FROM f")
def face_verdict(spark, folder):
    return at.face_verdict(picks(spark, folder), ["turn"])


@query(VERDICT + " SELECT verdict, count(*) AS n FROM f GROUP BY verdict")
def verdict_histogram(spark, folder):
    return face_verdict(spark, folder).groupBy("verdict").agg(F.count("*").alias("n"))


@query(VERDICT + " SELECT turn, verdict, round(CASE verdict WHEN 'confirmed' THEN least(0.98, c + 0.15) WHEN 'partial' THEN least(0.95, c + 0.05) WHEN 'contradicted' THEN greatest(0.3, c - 0.3) ELSE c END, 2) AS confidence FROM (SELECT turn, verdict, CASE WHEN n_votes % 2 = 0 THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END AS c FROM f) x")
def confidence_overlay(spark, folder):
    before = F.when(F.col("n_votes") % 2 == 0, F.lit(0.85)).otherwise(F.lit(0.75))
    return face_verdict(spark, folder).select("turn", "verdict", at.overlay_confidence(before, F.col("verdict")).alias("confidence"))


@query(f"""WITH {PAIRS}, v AS (SELECT turn, expected, coalesce(picked, 'NONE') AS vote, on_lineup FROM g)
SELECT DISTINCT turn, vote AS picked FROM v WHERE vote <> expected AND vote <> 'NONE' AND on_lineup AND NOT EXISTS (SELECT 1 FROM v w WHERE w.turn = v.turn AND w.vote <> v.vote)""")
def convergent_pick(spark, folder):
    """Turns of two votes at most: among them pairs of M2 and none, of M2 twice, and of M9, who is on no lineup."""
    return at.convergent_pick(picks(spark, folder, F.floor(F.col("doc_id") / 2).cast("string")), ["turn"])


@query("SELECT s.s_suppkey, s.s_name, n.n_name AS party FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R') l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey")
def cast_list(spark, folder):
    speaking = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    members = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return members.join(speaking, "s_suppkey", "left_semi").select("s_suppkey", "s_name", F.col("n_name").alias("party"))


@query("SELECT alias, min(p_partkey) AS member_id FROM (SELECT p_partkey, upper(trim(p_name)) || ' ' || CAST(p_size AS VARCHAR) || ' ' || p_type AS alias FROM part) a GROUP BY alias HAVING count(DISTINCT p_partkey) = 1")
def alias_index(spark, folder):
    alias = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), "p_type")
    return rs.alias_index(table(spark, folder, "part").select(F.col("p_partkey").alias("member_id"), alias.alias("alias")))


@query(r"SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(upper(CASE c_custkey % 4 WHEN 0 THEN 'Dr. ' WHEN 1 THEN 'thiru ' WHEN 2 THEN 'Mrs.' ELSE 'Amr ' END || c_name), '\b(DR|THIRU|TMT|SELVI|MR|MRS|MS)\b\.?', ' ', 'g'), '\.', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM customer")
def name_normalise(spark, folder):
    title = F.when(F.col("c_custkey") % 4 == 0, "Dr. ").when(F.col("c_custkey") % 4 == 1, "thiru ").when(F.col("c_custkey") % 4 == 2, "Mrs.").otherwise("Amr ")
    return table(spark, folder, "customer").select("c_custkey", tx.normalise_name(F.concat(title, "c_name")).alias("name"))


@query()
def fuzzy_resolve(spark, folder):
    index = rs.alias_index(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("member_id"), F.col("s_name").alias("alias")))
    typed = table(spark, folder, "supplier").select(F.concat(F.lit("Dr. "), F.when(F.col("s_suppkey") % 2 == 0, F.replace("s_name", F.lit("pp"), F.lit("p"))).otherwise(F.col("s_name"))).alias("name"))
    return rs.resolve(typed, index).select("name", "member_id")


@query("SELECT n_name AS party, count(*) AS n_members, count(*) FILTER (WHERE s_suppkey % 3 > 0) AS n_tamil, count(*) FILTER (WHERE s_acctbal > 0) AS n_portrait FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def roster_coverage(spark, folder):
    from palaver.sources.artifacts import roster_coverage as coverage

    who = table(spark, folder, "supplier").join(F.broadcast(table(spark, folder, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    members = who.select(F.col("n_name").alias("party"), F.when(F.col("s_suppkey") % 3 > 0, "த").alias("tamil_name"), F.when(F.col("s_acctbal") > 0, "p.jpg").otherwise("").alias("portrait"))
    return coverage(members, ["party"])


@query("SELECT row_number() OVER (ORDER BY s_acctbal <= 0, s_suppkey) AS place, '- ' || CASE WHEN s_suppkey % 3 > 0 THEN 'த' ELSE '' END || ' (' || s_name || ', P, ' || CASE WHEN s_acctbal > 0 THEN 'Minister' ELSE 'MLA' END || ')' AS line FROM supplier QUALIFY place <= 60")
def names_hint(spark, folder):
    """The prompt's list of names is at most 60 long: the limit is the feature."""
    from pyspark.sql import Window

    from palaver.operators.segments import names_hint as hint

    key = F.col("s_suppkey")
    members = table(spark, folder, "supplier").select(key.alias("ord"), F.col("s_name").alias("name"), F.when(key % 3 > 0, "த").alias("tamil_name"), F.lit("P").alias("party_code"), F.when(F.col("s_acctbal") > 0, F.array(F.lit("Minister"))).otherwise(F.array(F.lit("MLA"))).alias("current_roles"))
    return hint(members).select(F.row_number().over(Window.orderBy(F.col("office").desc(), "ord")).cast("long").alias("place"), "line")


#: Desks of a nation that suppliers are dealt to by their keys.
DESKS = 11


@query(f"""WITH o AS (SELECT n_nationkey, k, n_name || ' desk ' || CAST(k AS VARCHAR) AS office FROM nation, (SELECT unnest(range({DESKS})) AS k) x),
m AS (SELECT s_suppkey AS id, office || CASE s_suppkey % 7 WHEN 0 THEN ' — north' WHEN 1 THEN ' deputy' WHEN 2 THEN '' ELSE ', south' END AS role FROM supplier JOIN o ON s_nationkey = n_nationkey AND k = (s_suppkey * 5) % {DESKS}),
w AS (SELECT office FROM o UNION ALL SELECT office || ' deputy' FROM o)
SELECT office, min(id) AS member_id FROM m, w WHERE lower(role) = lower(office) OR starts_with(lower(role), lower(office) || ' —') OR starts_with(lower(role), lower(office) || ' -') OR starts_with(lower(role), lower(office) || ',') GROUP BY office HAVING count(DISTINCT id) = 1""")
def role_unique_holder(spark, folder):
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name", F.explode(F.sequence(F.lit(0), F.lit(DESKS - 1))).alias("k"))
    desks = nation.select("n_nationkey", "k", F.concat("n_name", F.lit(" desk "), F.col("k").cast("string")).alias("office"))
    held = table(spark, folder, "supplier").join(desks, (F.col("s_nationkey") == F.col("n_nationkey")) & (F.col("k") == F.col("s_suppkey") * 5 % DESKS))
    kind = F.col("s_suppkey") % 7
    tail = F.when(kind == 0, " — north").when(kind == 1, " deputy").when(kind == 2, "").otherwise(", south")
    offices = desks.select("office").union(desks.select(F.concat("office", F.lit(" deputy"))))
    return rs.unique_holders(held.select(F.col("s_suppkey").alias("member_id"), F.concat("office", tail).alias("role")), offices)


@query("""WITH r AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256(CAST(s_suppkey AS VARCHAR)), s_suppkey) - 1 AS at, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT a.s_suppkey AS member_id, p.place, b.s_suppkey AS decoy FROM r a JOIN (SELECT unnest(range(1, 5)) AS place) p ON p.place < a.n JOIN r b ON b.s_nationkey = a.s_nationkey AND b.at = (a.at + p.place) % a.n""")
def lineup_sample(spark, folder):
    return at.decoys(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("member_id"), "s_nationkey"), ["s_nationkey"])


@query("SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'A' WHEN 'system' THEN 'M0' END AS member, CAST(CASE role WHEN 'assistant' THEN 0.85 WHEN 'system' THEN 0.7 END AS DOUBLE) AS confidence, role = 'system' AS procedure FROM conversations")
def presiding_turns(spark, folder):
    """Turns that announce are the presiding member's, where no one else is named."""
    named = F.col("role") == "assistant"
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.when(named, "A").alias("member"), (F.col("role") == "system").alias("announced"), F.when(named, F.lit(0.85)).alias("confidence"))
    return at.presiding(turns, "M0").select("conv_id", "turn", "member", "confidence", F.col("kinds_procedure").alias("procedure"))


@query("""WITH k AS (SELECT * FROM (VALUES (0, 'Finance', 'நிதி'), (1, 'Health', 'சுகாதார'), (2, 'Law', 'சட்டத்துறை'), (3, 'Industries', 'தொழில்')) v(i, word, term)),
m AS (SELECT i, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS member_id FROM k LEFT JOIN supplier ON s_suppkey IN (3, 4, 7) AND s_suppkey % 4 = i GROUP BY i)
SELECT doc_id, CASE WHEN m.n = 1 THEN m.member_id END AS member_id FROM documents JOIN k ON k.i = doc_id % 4 JOIN m ON m.i = k.i""")
def office_named(spark, folder):
    """Announcements of portfolios in Tamil: suppliers 3, 4 and 7 are ministers, 3 and 7 of one portfolio, which is then no one's."""
    number = lambda c: F.when(F.col(c) % 4 == 0, "Finance").when(F.col(c) % 4 == 1, "Health").when(F.col(c) % 4 == 2, "Law").otherwise("Industries")
    held = table(spark, folder, "supplier").where(F.col("s_suppkey").isin(3, 4, 7)).select(F.col("s_suppkey").alias("member_id"), F.concat(F.lit("Minister — "), number("s_suppkey")).alias("role"))
    place = F.col("doc_id") % 4
    term = F.when(place == 0, "நிதி").when(place == 1, "சுகாதார").when(place == 2, "சட்டத்துறை").otherwise("தொழில்")
    texts = table(spark, folder, "documents").select("doc_id", F.concat(term, F.lit(" அமைச்சர்")).alias("text"))
    found = rs.resolve_office(texts.select("text").distinct(), held, word_start=True)
    return texts.join(found, "text").select("doc_id", "member_id")
