"""Personal data by bootstrapped contextual extraction.

Seeds are what the base rules find and check: emails, addresses, cards and phones. Every seed, and
every other string with a digit or an at-sign that has an identifier's form, is an instance; where it
stands makes its lexical patterns:

* ``S`` its shape: letters as one ``a``, digits as ``9``, each for each (runs as one in an email)
* ``L`` and ``R`` the word before or after it, with the shape
* ``W`` and ``V`` the word before it, or the two words before it, whatever the shape

Spark scores the graph of patterns and distinct instances round by round. A pattern's confidence in a
kind is the sum of its instances' scores in that kind over the number of its instances: seeds count 1
for their kind; an instance that is not yet known counts UNKNOWN_WEIGHT against. A pattern with a shape is judged
by the instances whose form allows the kind (a number that fails a card's checksum says nothing of those that
pass it); one of words alone by all of them, so that what the rules found and refused, and what has no
identifier's form, count against it. A pattern is trusted from LEAST_SUPPORT and
LEAST_CONFIDENCE on. An unknown instance gets the confidence of its best trusted pattern whose kind
its form allows, and so takes part in the next round. After the last round each unknown string with a
trusted pattern is a span. So a phone that runs into the next number, which the base rule refuses as
a whole, is found by the shape it shares with other phones, and a local number behind words that
nearly always stand before phones is found by them.

Base spans always stay, and nothing is added that overlaps one; of added spans that overlap, the more
confident one stays, then the longer, then the first.

Texts are scanned once; what leaves the scan is spans, instances and patterns. Instances and patterns
meet by groupings and joins; the trusted patterns are broadcast only if there are few. Copies of a text
have the same instances, which are made distinct before they are counted, so no group of copies sways
a pattern. Nothing is collected.

Null and empty texts have no spans. A very long text is one row of the scan, in time linear in its
length. Repeated rows are rows of their own, with equal results. Only doc_id and text are read, whatever other
columns are called. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.blocks import small_batches
from palaver.session import bounded, cut

#: Fixed by the statement of the query, in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't begin within a run of digits, as each takes whole runs; saying so keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LEAST_SUPPORT, LEAST_CONFIDENCE, UNKNOWN_WEIGHT, ROUNDS = 5, 0.8, 0.25, 3
#: Marked words that an instance has at most, and characters: the longest address that mail allows.
WINDOW_WORDS, LONGEST = 5, 320
#: Kinds of instances beside those of KINDS.
UNKNOWN, REFUSED = -1, -2

_MARK = re.compile("[0-9@]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_QUAD = re.compile(r"[0-9]{1,3}(?:[.,:_-][0-9]{1,3}){3}")
_NUMBER = re.compile(r"[0-9+(][0-9 .()/+-]*[0-9]")
_RUNS = re.compile(r"([0-9]+)|([^\W\d_]+)|(\s+)")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * d - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(filter(str.isdigit, text))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Begins and ends of addresses: from each at-sign, the name before it and the host after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        if host := _DOMAIN.match(text, at + 1):
            begin = at
            while begin > done and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at:
                yield begin, host.end()
                done = host.end()
        at = text.find("@", max(at + 1, done))


def checked(kind: int, text: str) -> bool:
    if kind == 1:
        return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in text.split(".")))
    digits = digits_of(text)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base rules' spans (start, kind, end), in order, and the matches that they refuse."""
    spans, refused = [(a, 0, b) for a, b in emails(text)], []
    for kind, rule in ((1, _IP), (2, _CARD), (3, _PHONE)):
        for m in rule.finditer(text):
            if checked(kind, m[0]):
                spans.append((m.start(), kind, m.end()))
            else:
                refused.append((m.start(), kind, m.end()))
    return sorted(spans), refused


def marked_words(text: str) -> Iterator[tuple[int, int]]:
    """Words with a digit or an at-sign."""
    end = 0
    while m := _MARK.search(text, end):
        begin = m.start()
        while begin > end and not _SPACE.match(text, begin - 1):
            begin -= 1
        space = _SPACE.search(text, m.end())
        end = space.start() if space else len(text)
        yield begin, end


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without quotes, stops and brackets that are not its own."""
    while a < b and (text[a] in "\"'<[{" or text[a] == "(" and ")" not in text[a:b]):
        a += 1
    while a < b and (text[b - 1] in ".,;:!?\"'>]}" or text[b - 1] == ")" and "(" not in text[a:b]):
        b -= 1
    return a, b


def forms(value: str) -> list[int]:
    """The kinds whose form a string has, more widely than the base rules take it."""
    if "@" in value:
        name, _, host = value.partition("@")
        return [0] if name and host and "@" not in host and not _SPACE.search(value) else []
    found = []
    if _QUAD.fullmatch(value) and all(int(p) <= 255 for p in re.findall("[0-9]+", value)):
        found.append(1)
    if _NUMBER.fullmatch(value):
        digits = digits_of(value)
        if 12 <= len(digits) <= 19 and not set(value) & set("()+") and luhn(digits):
            found.append(2)
        if 7 <= len(digits) <= 15 and 1 not in found:
            found.append(3)
    return found


def shape(value: str) -> str:
    runs = "@" in value
    return _RUNS.sub(lambda m: ("9" if runs else "9" * len(m[0])) if m[1] else "a" if m[2] else " ", value)


def word(text: str) -> str:
    return text.lower() if len(text) <= 40 else f"#{hashlib.md5(text.encode()).hexdigest()}"


def patterns(text: str, a: int, b: int, formed: bool) -> list[str]:
    before = text[max(0, a - 200) : a].rpartition("\n")[2].split()[-2:]
    after = text[b : b + 100].partition("\n")[0].split()[:1]
    last, both = word(before[-1]) if before else "^", " ".join(map(word, before)) if before else "^"
    found = [f"W {last}", f"V {both}"]
    if formed:
        s = shape(text[a:b])
        found += [f"S {s}", f"L {last} {s}", f"R {word(after[0]) if after else '$'} {s}"]
    return found


def instances(text: str, spans: list[tuple[int, int, int]], refused: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str, int, list[int], list[str]]]:
    """start, end, value, kind, forms and patterns of all instances of a text."""
    for a, kind, b in spans:
        if b - a <= LONGEST:
            yield a, b, text[a:b], kind, [kind], patterns(text, a, b, True)
    taken, at, words = [(a, b) for a, _, b in spans], 0, [w for w in marked_words(text) if w[1] - w[0] <= LONGEST]
    whole: dict[tuple[int, int], list[int]] = {}
    for a, kind, b in refused:
        if b - a <= LONGEST:
            whole.setdefault((a, b), []).append(kind)
    for i, (a, b) in enumerate(words):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        for n in range(WINDOW_WORDS):
            if n and (i + n >= len(words) or words[i + n][0] != words[i + n - 1][1] + 1):
                break
            b = words[i + n][1]
            if b - a > LONGEST or at < len(taken) and taken[at][0] < b:
                break  # it would overlap a base span, as all longer ones do
            x, y = trimmed(text, a, b)
            if x >= y:
                continue
            fit = [k for k in forms(text[x:y]) if k not in whole.get((x, y), ())]
            if fit:
                yield x, y, text[x:y], UNKNOWN, fit, patterns(text, x, y, True)
            elif n == 0 or (x, y) in whole:
                yield x, y, text[x:y], REFUSED, [], patterns(text, x, y, (x, y) in whole)


SPAN = "struct<start:int,kind:int,end:int>"
INSTANCE = "struct<start:int,end:int,value:string,kind:int,forms:array<int>,patterns:array<string>>"


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, base (spans) and found (instances) of each row of docs (doc_id, text)."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    instance = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("kind", pa.int32()), ("forms", pa.list_(pa.int32())), ("patterns", pa.list_(pa.string()))]))
    names = ("start", "end", "value", "kind", "forms", "patterns")

    def run(batches):
        for batch in batches:
            base, found = [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                spans, own = [], []
                if _MARK.search(text):
                    spans, refused = base_spans(text)
                    own = [dict(zip(names, x, strict=True)) for x in instances(text, spans, refused)]
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                found.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, span), pa.array(found, instance)], names=["row", "doc_id", "base", "found"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"row long, doc_id long, base array<{SPAN}>, found array<{INSTANCE}>")


def pattern_scores(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """pattern, kind and confidence of the trusted patterns, from edges (pattern, value, known, forms) and scores (value, kind, score)."""
    rows = edges.join(scores, "value", "left")
    weight = F.when(F.col("known") | F.col("score").isNotNull(), 1.0).otherwise(UNKNOWN_WEIGHT)
    any_form = F.substring("pattern", 1, 1).isin("W", "V")
    kinds = range(len(KINDS))
    sums = [F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(f"s{k}") for k in kinds]
    counts = [F.sum(F.when(any_form | F.array_contains("forms", k), weight).otherwise(0.0)).alias(f"n{k}") for k in kinds]
    totals = rows.groupBy("pattern").agg(*sums, *counts)
    best = F.array_max(F.array(*[F.struct(F.col(f"s{k}").alias("s"), F.lit(k).alias("kind"), F.col(f"n{k}").alias("n")) for k in kinds]))
    scored = totals.select("pattern", best.alias("b")).select("pattern", "b.kind", F.col("b.s").alias("support"), (F.col("b.s") / F.col("b.n")).alias("confidence")).where("support > 0")
    return scored.where((F.col("support") >= LEAST_SUPPORT) & (F.col("confidence") >= LEAST_CONFIDENCE))


def trusted(found: DataFrame) -> DataFrame:
    """The trusted patterns (pattern, kind, support, confidence) after the last round, from instances (value, kind, forms, patterns)."""
    edges = found.select(F.explode("patterns").alias("pattern"), "value", "kind", "forms").distinct()
    # a string that is a seed anywhere is one everywhere
    values = edges.groupBy("value").agg(F.max("kind").alias("best"))
    edges = cut(edges.select("pattern", "value", "forms").distinct().join(values, "value").withColumn("known", F.col("best") != UNKNOWN))
    seeds = edges.where("best >= 0").select("value", F.col("best").alias("kind"), F.lit(1.0).alias("score")).distinct()
    scores, before = seeds, -1
    for _ in range(ROUNDS):
        good = cut(pattern_scores(edges.select("pattern", "value", "known", "forms"), scores))
        fits = edges.where("not known").join(bounded(good), "pattern").where(F.array_contains("forms", F.col("kind")))
        new = cut(fits.groupBy("value").agg(F.max(F.struct(F.col("confidence").alias("score"), "kind")).alias("b")).select("value", "b.kind", "b.score"))
        many = new.count()
        if many == before:
            break
        scores, before = seeds.unionByName(new), many
    return good


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans of every row of docs (doc_id, text): arrays of (start, kind, end), kind a place in KINDS."""
    scanned = cut(scan(docs))
    found = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    good = trusted(found.select("value", "kind", "forms", "patterns"))
    asked = found.where(F.col("kind") == UNKNOWN).select("row", "start", "end", "forms", F.explode("patterns").alias("pattern"))
    hits = asked.join(bounded(good.select("pattern", "kind", "confidence")), "pattern").where(F.array_contains("forms", F.col("kind")))
    best = hits.groupBy("row", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("b"))
    added = best.groupBy("row").agg(F.collect_list(F.struct("start", F.col("b.kind").alias("kind"), "end", F.col("b.confidence").alias("confidence"))).alias("added"))  # of one text
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def settle(batches):
        for batch in batches:
            spans = []
            for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ends: list[tuple[int, int]] = []  # of what is kept, in order
                kept = [*base]
                for x in sorted(more or [], key=lambda x: (-x["confidence"], x["start"] - x["end"], x["start"])):
                    at = bisect.bisect(ends, (x["start"], x["end"]))
                    if (at == 0 or ends[at - 1][1] <= x["start"]) and (at == len(ends) or ends[at][0] >= x["end"]):
                        ends.insert(at, (x["start"], x["end"]))
                        kept.append({k: x[k] for k in ("start", "kind", "end")})
                spans.append(sorted(kept, key=lambda x: (x["start"], x["kind"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, span)], names=["doc_id", "base", "spans"])

    joined = scanned.select("row", "doc_id", "base").join(added, "row", "left").select("doc_id", "base", "added")
    return joined.mapInArrow(settle, f"doc_id long, base array<{SPAN}>, spans array<{SPAN}>")


def listed(spans: str):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_bootstrapped_pii(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans of each kind), base_sha256 and spans of all documents.

    Null and empty texts have no spans; repeated rows have equal results; an empty table gives no rows.
    """
    made = find_spans(spark.read.parquet(f"{folder}/documents.parquet"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return made.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
