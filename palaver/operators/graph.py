"""A property multigraph with row-level provenance, as node and edge tables.

Every operator takes the keys of a recording first: nodes, edges, names and segments of one recording
never meet those of another. Provenance is a set of segment ordinals in words of bits
(palaver.operators.provenance); lists of ids are made where rows leave the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.text import node_key
from palaver.operators import provenance as pv
from palaver.operators.automaton import occurrences
from palaver.session import BROADCAST_ROWS, bounded, cut

#: Members that are sent to the tasks: a roster has few columns.
ROSTER = 500_000
# The types that a name is looked for under, in order.
NAME_TYPES = ("PARTY", "SCHEME", "PLACE", "AMOUNT", "LAW", "DATE", "TOPIC", "PERSON_EXTERNAL")


def provenance_filter(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, row_id, ids) whose ids are there and all among their recording's known (keys, id).

    A set of ids is a subset of the known ones if no word of it has a bit that theirs lacks.
    """
    by = [*keys, "row_id"]
    wanted = pv.merged(rows.select(*by, F.explode("ids").alias("id")).withColumn("ordinal", F.coalesce(pv.ordinal_of(F.col("id")), F.lit(-1))), by)
    there = pv.merged(known.select(*keys, pv.ordinal_of(F.col("id")).alias("ordinal")).where("ordinal is not null"), keys).withColumnRenamed("bits", "_known")
    lacking = wanted.join(there, [*keys, "word"], "left").where(F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_known", F.lit(0).cast("long")))) != 0)
    return rows.where(F.size("ids") > 0).join(lacking.select(*by).distinct(), by, "left_anti")


def build_nodes(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes from mentions (keys, kind, name, ordinal, ord): the first spelling, and the words of distinct provenance."""
    by = [*keys, "key"]
    keyed = mentions.withColumn("key", node_key(F.col("kind"), F.col("name")))
    order = F.struct("ord", "name", "kind")
    parts = pv.merged(keyed, by, F.min(F.struct(order.alias("order"), "name", "kind")).alias("first"))
    return parts.groupBy(*by).agg(F.min("first").alias("first"), pv.packed().alias("words")).select(*by, F.col("first.name").alias("label"), "first.kind", "words")


def assemble_nodes(mentions: DataFrame, roster: DataFrame, keys: list[str]) -> DataFrame:
    """Whole nodes from mentions (keys, kind, name, tamil, member_id, ordinal, ord): keys, key, type, label,
    tamil, party, roles, portrait, member_id, first (the order of the first mention) and words.

    A mention of a member (member_id) is the roster's PERSON, with the roster's attributes; any other
    keeps the attributes of the mention that came first: the smallest by ord and then by all attributes, so
    that mentions of one ord have one outcome. A mention without provenance (null) makes a node only.
    roster (member_id, name, tamil_name, party_code, roles, portrait).
    """
    attributes = ("label", "type", "tamil", "party", "roles", "portrait", "member_id")
    known = roster.select(F.col("name").alias("label"), F.lit("PERSON").alias("type"), F.col("tamil_name").alias("tamil"), F.col("party_code").alias("party"), "roles", "portrait", "member_id").where("label is not null")
    known = known.withColumn("_key", node_key(F.lit("PERSON"), F.col("label"))).withColumn("place", F.row_number().over(Window.partitionBy("_key").orderBy(*attributes)))
    # mentions of no member stay out of the join: in a shuffle all of them would meet in one partition
    alone = mentions.where("member_id is null").select("*", F.lit(None).cast("string").alias("_key"), F.lit(None).cast("int").alias("place"))
    rows = mentions.where("member_id is not null").join(bounded(known.select("member_id", "_key", "place"), ROSTER), "member_id", "left").unionByName(alone)
    member = F.col("_key").isNotNull()
    rows = rows.withColumn("key", F.coalesce("_key", node_key(F.col("kind"), F.col("name"))))
    # a member's mention takes its place among the members of one key along, and the roster's attributes come to whole nodes only
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema if f.name in attributes}
    other = F.struct("ord", F.col("name").alias("label"), F.col("kind").alias("type"), F.nullif(F.col("tamil"), F.lit("")).alias("tamil"), *[none[c] for c in attributes[3:]])
    by = [*keys, "key"]
    parts = pv.merged(rows, by, F.min(F.when(member, F.struct("ord", "place"))).alias("m"), F.min(F.when(~member, other)).alias("o"))
    whole = parts.groupBy(*by).agg(F.min("m").alias("m"), F.min("o").alias("o"), pv.packed().alias("words")).withColumn("place", F.col("m.place"))
    whole = whole.join(bounded(known.withColumnRenamed("_key", "key"), ROSTER), ["key", "place"], "left")
    f = F.least(F.when(F.col("m").isNotNull(), F.struct(F.col("m.ord").alias("ord"), *attributes)), F.col("o"))
    return whole.select(*by, f.alias("f"), "words").select(*by, "f.type", "f.label", "f.tamil", "f.party", "f.roles", "f.portrait", "f.member_id", F.col("f.ord").alias("first"), "words")


def resolve_endpoints(relations: DataFrame, nodes: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of relations (keys, relation_id, subject, predicate, object, segment_ids): keys, relation_id, source, target, predicate, segment_ids, origin.

    A name that is a member's (alias, name: members, resolved beforehand) stands for its PERSON node
    and no other; any other name is looked for under NAME_TYPES, the first type that has a node in the
    recording. A relation without both ends, or from a node to itself, goes.
    """
    ends = relations.select(*keys, "relation_id", F.explode(F.create_map(F.lit("source"), F.col("subject"), F.lit("target"), F.col("object"))).alias("side", "name"))
    names = ends.select(*keys, "name").distinct().join(bounded(members.select(F.col("alias").alias("name"), F.col("name").alias("member"))), "name", "left")
    person = F.array(F.struct(F.lit(0).alias("rank"), node_key(F.lit("PERSON"), F.col("member")).alias("key")))
    others = F.array(*[F.struct(F.lit(i + 1).alias("rank"), node_key(F.lit(t), F.col("name")).alias("key")) for i, t in enumerate(NAME_TYPES)])
    tried = names.select(*keys, "name", F.explode(F.when(F.col("member").isNotNull(), person).otherwise(others)).alias("try")).select(*keys, "name", "try.*")
    found = tried.join(nodes.select(*keys, "key"), [*keys, "key"]).groupBy(*keys, "name").agg(F.min_by("key", "rank").alias("key"))
    placed = ends.join(found, [*keys, "name"]).groupBy(*keys, "relation_id").agg(F.max(F.when(F.col("side") == "source", F.col("key"))).alias("source"), F.max(F.when(F.col("side") == "target", F.col("key"))).alias("target"))
    both = placed.where("source is not null and target is not null and source <> target")
    return relations.join(both, [*keys, "relation_id"]).select(*keys, "relation_id", "source", "target", "predicate", "segment_ids", F.lit("extracted").alias("origin"))


def roster_edges(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """A "member of" edge from each member's node to its party's."""
    rows = nodes.where("member_id is not null and party is not null")
    return rows.select(*keys, F.col("key").alias("source"), node_key(F.lit("PARTY"), F.col("party")).alias("target"), F.lit("member of").alias("predicate"), F.array().cast("array<struct<word:bigint,bits:bigint>>").alias("words"), F.lit("roster").alias("origin"))


def discussions(nodes: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source, target, word and bits of the segments (keys, member_id, ordinal) of which a topic is named and a member the speaker.

    A speaker's and a topic's sets meet word by word: what both have is the bits' conjunction. Speakers
    get their nodes before that, while a segment is there once and not for each of its topics.
    """
    topics = nodes.where("type = 'TOPIC'").select(*keys, F.col("key").alias("target"), F.explode("words").alias("w")).select(*keys, "target", "w.word", F.col("w.bits").alias("_topic"))
    people = nodes.where("member_id is not null").select(*keys, F.col("key").alias("source"), "member_id")
    said = pv.merged(segments.where("member_id is not null").join(people, [*keys, "member_id"]).select(*keys, "source", "ordinal"), [*keys, "source"])
    shared = topics.join(said, [*keys, "word"]).withColumn("bits", F.col("bits").bitwiseAND(F.col("_topic")))
    return shared.where("bits <> 0").select(*keys, "source", "target", "word", "bits")


def discussed_edges(nodes: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """A "discussed" edge from each speaker to each topic of a segment (keys, member_id, ordinal), with the words of all such segments."""
    edges = discussions(nodes, segments, keys).groupBy(*keys, "source", "target").agg(pv.packed().alias("words"))
    return edges.select(*keys, "source", "target", F.lit("discussed").alias("predicate"), "words", F.lit("derived").alias("origin"))


def discussed_first(nodes: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source, target and ord, the first segment, of each "discussed" edge: no words are gathered for it."""
    return discussions(nodes, segments, keys).groupBy(*keys, "source", "target").agg(F.min(pv.lowest(F.col("word"), F.col("bits"))).alias("ord"))


def first_edges(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One edge for each (keys, source, target) of pairs (keys, source, target, ordinal), with the words of its provenance."""
    by = [*keys, "source", "target"]
    return pv.merged(pairs.where("source <> target"), by).groupBy(*by).agg(pv.packed().alias("words"))


def degrees(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Degree of each node over both ends of every edge."""
    ends = edges.select(*keys, F.col("source").alias("key")).unionAll(edges.select(*keys, F.col("target").alias("key")))
    return ends.groupBy(*keys, "key").agg(F.count("*").alias("degree"))


def expand(questions: DataFrame, nodes: DataFrame, edges: DataFrame, keys: list[str], own: int = 2, neighbours: int = 4, limit: int = 6, word_start: bool = False) -> DataFrame:
    """Provenance that is one hop from nodes named in a question (keys, query_id, text) of the same recording.

    A named node gives its provenance (ids in order) and the first ``own`` of each of its first
    ``neighbours`` neighbours; first seen counts, up to ``limit`` ids for a question, so no more of any set
    is read. That list of ``limit`` ids is made once for a node; a question joins those of its nodes and moves no row
    for each id. nodes, which are read for names, for hits and for neighbours, has keys, key, label, tamil, first (their order) and words; edges has keys, source,
    target and ord. Labels of three characters or more are looked for in the lower-cased question, Tamil names in
    the question as it is; with ``word_start`` only where a word begins.
    """
    shown = nodes.select(*keys, "key", "label", "tamil", F.col("first").alias("node_ord"), "words")
    label = F.when(F.length("label") > 2, F.lower("label"))
    in_english = occurrences(questions, shown, keys, F.lower("text"), label, word_start).join(shown.select(*keys, label.alias("name"), "key"), [*keys, "name"])
    in_tamil = occurrences(questions, shown, keys, F.col("text"), F.when(F.col("label") != "", F.col("tamil")), word_start).join(shown.where("label <> ''").select(*keys, F.col("tamil").alias("name"), "key"), [*keys, "name"])
    hit = cut(in_english.unionByName(in_tamil).select(*keys, "query_id", "key").distinct())
    wanted = hit.select(*keys, "key").distinct()
    # what hangs on few nodes is sent to the tasks without being counted, as that would make the edges again
    small = F.broadcast if wanted.limit(BROADCAST_ROWS // neighbours + 1).count() <= BROADCAST_ROWS // neighbours else lambda df: df
    end = lambda key, other, side: F.struct(F.col(key).alias("key"), F.col(other).alias("other"), "ord", F.lit(side).alias("side"))
    both = edges.select(*keys, F.explode(F.array(end("source", "target", 0), end("target", "source", 1))).alias("e")).select(*keys, "e.*")  # one pass over the edges
    near = both.join(small(wanted), [*keys, "key"], "left_semi")
    near = near.withColumn("rn", F.row_number().over(Window.partitionBy(*keys, "key").orderBy("ord", "side", "other"))).where(F.col("rn") <= neighbours)
    around = shown.select(*keys, F.col("key").alias("other"), pv.ordinals(F.col("words"), own).alias("ids")).join(small(near.select(*keys, "key", "other", "rn")), [*keys, "other"])
    around = around.groupBy(*keys, "key").agg(F.sort_array(F.collect_list(F.struct("rn", "ids"))).alias("near"))
    flat = lambda c: F.flatten(F.transform(c, lambda x: x["ids"]))
    some = lambda c: F.slice(F.array_distinct(c), 1, limit)
    # the limit ids that a node gives first are all that a question can take of it
    given = shown.join(small(wanted), [*keys, "key"], "left_semi").join(small(around), [*keys, "key"], "left")
    given = given.select(*keys, "key", "node_ord", some(F.concat(pv.ordinals(F.col("words"), limit), F.coalesce(flat(F.col("near")), F.array().cast("array<long>")))).alias("ids"))
    first = hit.join(small(given), [*keys, "key"]).groupBy(*keys, "query_id").agg(F.sort_array(F.collect_list(F.struct("node_ord", "key", "ids"))).alias("at"))
    ranked = first.select(*keys, "query_id", F.posexplode(some(flat(F.col("at")))).alias("pos", "ordinal"))
    return ranked.select(*keys, "query_id", pv.segment_name(F.col("ordinal")).alias("id"), (F.col("pos") + 1).cast("long").alias("rank"))
