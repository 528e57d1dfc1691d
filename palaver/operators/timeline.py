"""Timeline operators over integer milliseconds; every one is partitioned by the caller's keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_offsets(df: DataFrame, keys: list[str], order: list[str], duration: str) -> DataFrame:
    """t_start and t_end of segments laid end to end by their durations."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("t_end", F.sum(duration).over(w)).withColumn("t_start", F.col("t_end") - F.col(duration))


def number_segments(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """segment_id S001, S002, ... in timeline order, and its ordinal seq."""
    seq = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    return df.withColumn("seq", seq).withColumn("segment_id", F.concat(F.lit("S"), F.when(seq < 1000, F.lpad(seq.cast("string"), 3, "0")).otherwise(seq.cast("string"))))


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """Numbers runs of rows: a new run begins where ``starts`` holds (null counts as a start)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_new", F.coalesce(starts, F.lit(True)).cast("long"))
    return marked.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def in_order(column: str, order: list[str]) -> Column:
    """The column's values of a group as an array, by the order columns."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(column).alias("_value")))), lambda x: x["_value"])


def build_turns(df: DataFrame, keys: list[str], order: list[str], voice: str, forced: Column | None = None, ids: str | None = None) -> DataFrame:
    """Turns: runs of one voice; ``forced`` rows begin a turn of their own. With ids, the turn's segment_ids in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.lag(voice).over(w).isNull() | (F.lag(voice).over(w) != F.col(voice))
    runs = islands(df, keys, order, changed if forced is None else changed | forced, "turn_index")
    return runs.groupBy(*keys, "turn_index").agg(
        F.min_by(voice, F.struct(*order)).alias(voice),
        F.min("t_start").alias("t_start"),
        F.max_by("t_end", F.struct(*order)).alias("t_end"),
        F.count("*").alias("n_segments"),
        *([] if ids is None else [in_order(ids, order).alias("segment_ids")]),
    )


def merge_runs(df: DataFrame, keys: list[str], order: list[str], member: str, most_gap: int, joined: tuple[str, ...] = ()) -> DataFrame:
    """Adjacent rows of one known member no more than most_gap apart become one.

    The array columns named in ``joined`` (segment ids, evidence) are joined in order; other attributes
    of the run are the first row's.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    same = (F.lag(member).over(w) == F.col(member)) & (F.col("t_start") - F.lag("t_end").over(w) <= most_gap)
    runs = islands(df, keys, order, ~F.coalesce(same, F.lit(False)), "run")
    return runs.groupBy(*keys, "run").agg(
        F.min_by(member, F.struct(*order)).alias(member),
        F.min("t_start").alias("t_start"),
        F.max_by("t_end", F.struct(*order)).alias("t_end"),
        F.max("confidence").alias("confidence"),
        F.count("*").alias("n_merged"),
        *[F.flatten(in_order(c, order)).alias(c) for c in joined],
    )


def gaps(df: DataFrame, keys: list[str], order: list[str], least: int, durations: DataFrame | None = None) -> DataFrame:
    """Silent stretches of at least ``least`` before segments and, with durations (keys, duration), at the end."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("gap_start", F.coalesce(F.max("t_end").over(w), F.lit(0).cast("long"))).select(*keys, "gap_start", F.col("t_start").alias("gap_end"))
    found = inner
    if durations is not None:
        tail = df.groupBy(*keys).agg(F.max("t_end").alias("gap_start")).join(durations, keys).select(*keys, F.greatest("gap_start", F.lit(0)).alias("gap_start"), F.col("duration").alias("gap_end"))
        found = inner.unionByName(tail)
    return found.where(F.col("gap_end") - F.col("gap_start") >= least)


def pair_events(df: DataFrame, keys: list[str], order: list[str], kind: str, duration: Column) -> DataFrame:
    """Intervals from start and end marks: the later of two starts counts, an end without a start
    does not, an open start ends with the recording; clamped to [0, duration], empty ones dropped."""
    w = Window.partitionBy(*keys).orderBy(*order)
    follows = F.lead(kind).over(w)
    opened = df.withColumn("_next", follows).withColumn("_t2", F.lead("t").over(w)).where((F.col(kind) == "start") & (F.col("_next").isNull() | (F.col("_next") == "end")))
    start, end = F.greatest(F.col("t"), F.lit(0).cast("long")), F.least(F.coalesce("_t2", duration), duration)
    return opened.select(*keys, start.alias("s_start"), end.alias("s_end")).where("s_end > s_start")


def nearest(points: DataFrame, boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """Points (keys, point_id, t, ...) with the nearest boundary (keys, t) of their keys; ties go to the earlier one.

    One union, one sort and two range frames: no pair is made.
    """
    kind = points.schema["t"].dataType
    tagged = points.withColumn("_b", F.lit(None).cast(kind)).unionByName(boundaries.select(*keys, "t", F.col("t").cast(kind).alias("_b")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("t")
    seen = tagged.withColumn("_before", F.max("_b").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_after", F.min("_b").over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing)))
    closer = F.col("_after").isNull() | (F.col("t") - F.col("_before") <= F.col("_after") - F.col("t"))
    rows = seen.where("point_id is not null").withColumn("nearest", F.when(closer, F.col("_before")).otherwise(F.col("_after")))
    return rows.drop("_b", "_before", "_after")


def snap_nearest(points: DataFrame, boundaries: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Each point (keys, point_id, t) moves to the nearest boundary (keys, t) within the window; ties go to the earlier one."""
    rows = nearest(points.select(*keys, "point_id", "t"), boundaries.select(*keys, "t"), keys)
    return rows.select(*keys, "point_id", "t", F.when(F.abs(F.col("nearest") - F.col("t")) <= window, F.col("nearest")).otherwise(F.col("t")).alias("snapped"))


def band_join(spans: DataFrame, points: DataFrame, keys: list[str], tolerance: int, cell: int) -> DataFrame:
    """Spans (keys, t_start, t_end, ...) with the points (keys, t, ...) in [t_start - tolerance, t_end + tolerance].

    Time is cut into cells and the join is on keys and cell, so it hashes however many points a key has.
    """
    low, high = F.col("t_start") - tolerance, F.col("t_end") + tolerance
    celled = spans.withColumn("_cell", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))
    joined = celled.join(points.withColumn("_cell", F.floor(F.col("t") / cell)), [*keys, "_cell"])
    return joined.where((F.col("t") >= low) & (F.col("t") <= high)).drop("_cell")


def stride_sample(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """Of a group's n rows every (n div limit)-th, at most limit of them; small groups are kept whole."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    n = F.count("*").over(Window.partitionBy(*keys))
    step = F.greatest(F.floor(n / limit), F.lit(1))
    kept = df.withColumn("_rn", rn).withColumn("_step", step)
    return kept.where(((F.col("_rn") - 1) % F.col("_step") == 0) & ((F.col("_rn") - 1) / F.col("_step") < limit)).drop("_rn", "_step")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], most_gap: int) -> DataFrame:
    """Unnamed turns that only a chunk boundary split off inherit the speaker before them, with
    confidence 0.1 lower each time and never under 0.5.

    df has member, kinds_procedure, announced, chunk, t_start, t_end and confidence. Eligibility
    does not depend on what is inherited, so a run of eligible turns takes from the turn before it.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    eligible = F.col("member").isNull() & ~F.col("announced") & (F.lag("chunk").over(w) != F.col("chunk")) & (F.col("t_start") - F.lag("t_end").over(w) <= most_gap)
    runs = islands(df.withColumn("_e", F.coalesce(eligible, F.lit(False))), keys, order, ~F.col("_e"), "_run")
    run = Window.partitionBy(*keys, "_run").orderBy(*order)
    steps = F.row_number().over(run) - 1
    source, procedure, confidence = (F.first(c).over(run) for c in ("member", "kinds_procedure", "confidence"))
    takes = F.col("_e") & source.isNotNull() & ~procedure
    lowered = F.greatest(F.lit(0.5), F.round(confidence - steps * 0.1, 2))
    out = runs.withColumn("_m", F.when(takes, source).otherwise(F.col("member"))).withColumn("_c", F.when(takes, lowered).otherwise(F.col("confidence")))
    return out.withColumn("carried", takes).drop("member", "confidence", "_e", "_run").withColumnRenamed("_m", "member").withColumnRenamed("_c", "confidence")


def min_spacing(times: Column, spacing: int) -> Column:
    """A greedy fold over an array of times: one is kept if it is spacing after the last one kept."""
    empty = F.array().cast("array<bigint>")
    return F.aggregate(F.array_sort(times), empty, lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) >= spacing), F.array_append(kept, t)).otherwise(kept))


def frame_plan(cuts: DataFrame, keys: list[str], offset: int, first: int, every: int, spacing: int) -> DataFrame:
    """Key-frame times of each key: cuts (keys, t, duration) plus an offset, united with a grid, thinned."""
    moved = cuts.where(F.col("t") + offset < F.col("duration"))
    per = cuts.groupBy(*keys).agg(F.max("duration").alias("duration")).join(moved.groupBy(*keys).agg(F.collect_set(F.col("t") + offset).alias("cuts")), keys, "left")
    grid = F.when(F.col("duration") > first, F.sequence(F.lit(first).cast("long"), F.col("duration") - 1, F.lit(every).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    both = F.array_union(F.coalesce("cuts", F.array().cast("array<bigint>")), grid)
    return per.select(*keys, F.explode(min_spacing(both, spacing)).alias("t"))


def plan_chunks(silences: DataFrame, key: str, target: int, search: int, least: int, tail: int) -> DataFrame:
    """Chunks of about ``target`` cut at the middle of pauses (key, mid, duration).

    Each cut depends on the one before, so a key's cuts are made by a fold over as many steps as fit
    into the recording: a step takes the pause of its window that is nearest the ideal cut, the
    earlier of two, or the ideal where there is none. A chunk's flag tells whether a pause ends it;
    the last one has the flag before it.
    """
    per = silences.groupBy(key).agg(F.max("duration").alias("duration"), F.collect_list("mid").alias("mids"))
    end, kind = F.col("duration"), "array<struct<start:bigint,end:bigint,flag:boolean>>"

    def step(s: Column) -> Column:
        ideal = s["start"] + target
        last = (end - s["start"] <= tail) | (ideal >= end)
        inside = F.filter("mids", lambda m: (m >= F.greatest(s["start"] + least, ideal - search)) & (m <= F.least(end - tail, ideal + search)))
        best = F.array_min(F.transform(inside, lambda m: F.struct(F.abs(m - ideal).alias("away"), m.alias("mid"))))["mid"]
        cut = F.when(last, end).otherwise(F.coalesce(best, F.least(ideal, end - tail)))
        flag = F.when(last, F.coalesce(F.try_element_at(s["cuts"], F.lit(-1))["flag"], F.lit(True))).otherwise(best.isNotNull())
        one = F.struct(s["start"].alias("start"), cut.alias("end"), flag.alias("flag"))
        # the cut is made once and read from its struct
        return F.get(F.transform(F.array(one), lambda c: F.struct(F.array_append(s["cuts"], c).alias("cuts"), c["end"].alias("start"))), 0)

    begin = F.struct(F.array().cast(kind).alias("cuts"), F.lit(0).cast("bigint").alias("start"))
    state = f"struct<cuts:{kind},start:bigint>"
    steps = F.sequence(F.lit(0), F.floor(end / least).cast("int") + 1)
    cuts = F.aggregate(steps, begin.cast(state), lambda s, _: F.when(s["start"] >= end, s).otherwise(step(s)).cast(state), lambda s: s["cuts"])
    rows = per.select(key, F.posexplode(cuts).alias("chunk_index", "c"))
    return rows.select(key, F.col("chunk_index").cast("long").alias("chunk_index"), F.col("c.start").alias("c_start"), F.col("c.end").alias("c_end"), F.col("c.flag").alias("at_silence"))


def span_faults(spans: DataFrame, keys: list[str], durations: DataFrame) -> DataFrame:
    """Per key: how many chunks are empty, leave a gap or overlap, and whether they span [0, duration]."""
    w = Window.partitionBy(*keys).orderBy("c_start", "c_end")
    checked = spans.withColumn("_after", F.lead("c_start").over(w))
    found = checked.groupBy(*keys).agg(F.count_if(F.col("c_end") <= F.col("c_start")).alias("n_empty"), F.count_if(F.col("_after") != F.col("c_end")).alias("n_broken"), F.min("c_start").alias("first"), F.max("c_end").alias("last"))
    return found.join(durations, keys).select(*keys, "n_empty", "n_broken", ((F.col("first") == 0) & (F.col("last") == F.col("duration"))).alias("spans_all"))
