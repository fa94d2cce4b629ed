"""Search predicates, scores, merges and ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scoring as S
from trackloom.functions import text as T
from trackloom.functions import vocabulary as V
from trackloom.plans.nlq import Constraints, Span

_ALIAS = {k: v for k, v in V.CLASS_ALIASES.items() if k != v}


def canonical_classes(classes: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in _ALIAS.items() for x in kv])
    return F.transform(classes, lambda c: F.coalesce(F.try_element_at(names, T.normalize(c)), T.normalize(c)))


def of_class(c: Constraints, classes: Column) -> Column | None:
    out = None
    mine = canonical_classes(classes)
    if c.classes:
        out = F.arrays_overlap(mine, F.array(*map(F.lit, c.classes)))
    if c.class_group == "vehicle":
        group = F.arrays_overlap(mine, F.array(*map(F.lit, V.VEHICLE_SEARCH)))
        out = group if out is None else out & group
    return out


def of_motion(state: str, text: Column, event_type: Column) -> Column:
    still = T.anywhere(text, ["stationary", "standing", "stopped"])
    moves = F.concat(F.lit(" "), text, F.lit(" ")).contains(" moved ") | T.anywhere(text, ["moving", "walking", "walked"])
    return (event_type != "relationship_event") & (still if state == "stationary" else moves & ~still)


def of_region(c: Constraints, text: Column) -> Column | None:
    tests = []
    if c.exact_regions:
        tests.append(T.anywhere(text, [r.replace("_", " ") for r in c.exact_regions]))
    for b in c.broad_regions:
        rooms = [f"{b} {v} region" for v in V.ROWS] if b in V.COLUMNS else [f"{h} {b} region" for h in V.COLUMNS]
        tests.append(T.anywhere(text, rooms))
    return reduce(lambda a, b: a & b, tests) if tests else None


def of_relationship(c: Constraints, text: Column, event_type: Column) -> Column | None:
    if not c.relationships:
        return None
    out = event_type == "relationship_event"
    for kind, sign in (("near", "near"), ("overlapping", "overlap")):
        if kind in c.relationships:
            out = out & text.contains(sign)
    return out


def in_time(span: Span, start: Column, end: Column) -> Column:
    """Closed intervals that meet the span; unknown times don't."""
    lo, hi = F.least(start, end), F.greatest(start, end)
    known = start.isNotNull() & end.isNotNull() & (start >= 0) & (end >= 0)
    if span.kind == "range" and span.start is not None and span.end is not None:
        return known & (hi >= min(span.start, span.end)) & (lo <= max(span.start, span.end))
    if span.kind == "after" and span.start is not None:
        return known & (hi >= span.start)
    if span.kind == "before" and span.end is not None:
        return known & (lo <= span.end)
    return known


def matching(index: DataFrame, c: Constraints, span: Span | None = None, text: str = "document") -> DataFrame:
    """The events that meet all constraints: filters on columns before any text is read."""
    words, kind = T.normalize(F.col(text)), F.col("event_type")
    tests = [
        in_time(span, F.col("start_time_seconds"), F.col("end_time_seconds")) if span else None,
        of_class(c, F.col("class_names")),
        T.word(words, c.colors) if c.colors else None,
        of_motion(c.motion_state, words, kind) if c.motion_state else None,
        words.contains(c.direction.replace("_", " ")) if c.direction else None,
        of_region(c, words),
        of_relationship(c, words, kind),
    ]
    return reduce(lambda df, t: df.where(t), [t for t in tests if t is not None], index)


def hybrid_score(similarity: Column, quality: Column, c: Constraints) -> Column:
    return F.round(similarity + 0.08 * S.clamp(F.coalesce(quality, F.lit(0.0))) + F.lit(c.bonus), 4)


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best with their rank; ties by distance, then id."""
    order = [F.col("hybrid_score").desc(), F.col("similarity").desc(), F.col("quality_score").desc(), F.col("distance"), F.col("event_id")]
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def by_intent(rows: DataFrame, intent: str) -> DataFrame:
    pair = F.coalesce(F.col("event_type"), F.lit("")).contains("relationship")
    return rows.where(pair) if intent == "relationship_event" else rows.where(~pair) if intent == "object_event" else rows


def first_of_each(rows: DataFrame, order: list, key: str = "event_id") -> DataFrame:
    """The best row of each id; rows without an id go."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def metadata_filter(rows: DataFrame, object_type=None, color=None, action=None, attribute=None, time_range=None) -> DataFrame:
    """Membership without regard to case; the time range contains both ends, as strings."""
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    for value, column in ((object_type, "object_types"), (color, "colors"), (action, "actions"), (attribute, "attributes")):
        if value:
            rows = rows.where(F.array_contains(low(F.col(column)), value.lower()))
    if time_range:
        rows = rows.where((F.col("start_time") >= time_range[0]) & (F.col("end_time") <= time_range[1]))
    return rows


def track_filter(rows: DataFrame, object_type=None, color=None, action=None, attributes=(), k: int | None = None) -> DataFrame:
    """Tracks with the object, either body colour, the action and all attributes; best first."""
    if object_type:
        rows = rows.where(F.lower("object_type") == object_type.lower())
    if color:
        rows = rows.where((F.lower("upper_color") == color.lower()) | (F.lower("lower_color") == color.lower()))
    if action:
        rows = rows.where(F.lower("action") == action.lower())
    for a in attributes:
        rows = rows.where(F.array_contains(F.transform("attributes", F.lower), a.lower()))
    rows = rows.orderBy(F.col("confidence").desc_nulls_last(), F.col("quality_score").desc_nulls_last(), "track_id")
    return rows if k is None else rows.limit(k)


def contains_filter(rows: DataFrame, object_type: str | None, color: str | None) -> DataFrame:
    """The agent's fallback: substrings."""
    for value, column in ((object_type, "object_type"), (color, "color")):
        if value:
            rows = rows.where(F.lower(column).contains(value))
    return rows


def merge_scores(sql: DataFrame, vector: DataFrame) -> DataFrame:
    """Full outer merge: 1 from the metadata alone, the similarity from the vectors alone,
    0.6 and 0.4 of them where both have the event."""
    a, b = sql.select("event_id", F.lit(1.0).alias("s")), vector.select("event_id", F.col("similarity").alias("v"))
    score = F.when(F.col("s").isNotNull() & F.col("v").isNotNull(), 0.6 + 0.4 * F.col("v")).when(F.col("v").isNotNull(), F.col("v")).otherwise(1.0)
    source = F.when(F.col("s").isNotNull() & F.col("v").isNotNull(), "hybrid").when(F.col("v").isNotNull(), "chromadb").otherwise("sql")
    return a.join(b, "event_id", "full").select("event_id", F.round(score, 6).alias("ranking_score"), source.alias("source"))


def fuse_ranks(lists: list[tuple[DataFrame, str, str]], k: int = 60, weight: float = 0.5, top: int = 5) -> DataFrame:
    """Reciprocal rank fusion of (rows with a position from 0, id column, prefix for those
    without an id): ids that occur again add up."""
    out = None
    for df, key, prefix in lists:
        one = df.select(F.coalesce(F.col(key).cast("string"), F.concat(F.lit(prefix), F.col("position").cast("string"))).alias("id"), (F.lit(weight) / (k + F.col("position") + 1)).alias("part"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("id").agg(F.round(F.sum("part"), 4).alias("score"), F.round(F.sum("part"), 9).alias("_s")).orderBy(F.col("_s").desc(), "id").limit(top).drop("_s")


def rerank(rows: DataFrame) -> DataFrame:
    """Weighted sum of similarity, metadata, confidence and time scores; missing ones are 1."""
    one = lambda c: T.safe_double(F.col(c), 1.0) if c in rows.columns else F.lit(1.0)
    sim = F.coalesce(*[T.safe_double(F.col(c)) for c in ("vector_score", "final_score") if c in rows.columns], F.lit(0.0))
    out = rows.withColumn("rerank_score", F.round(0.40 * sim + 0.30 * one("metadata_score") + 0.20 * one("confidence") + 0.10 * one("temporal_score"), 4))
    return first_of_each(out, [F.col("rerank_score").desc()])


def result_rows(rows: DataFrame) -> DataFrame:
    """Times in order, durations, clock times and numbers as results show them."""
    s, e = F.coalesce("start_time_seconds", F.lit(-1.0)), F.coalesce("end_time_seconds", F.lit(-1.0))
    lo, hi = F.when((s >= 0) & (e >= 0), F.least(s, e)).otherwise(s), F.when((s >= 0) & (e >= 0), F.greatest(s, e)).otherwise(e)
    r = rows.withColumns({"start_time_seconds": F.round(lo, 4), "end_time_seconds": F.round(hi, 4)})  # both from the old ones
    d = F.coalesce("duration_seconds", F.lit(-1.0))
    r = r.withColumn("duration_seconds", F.round(F.when(d >= 0, d).otherwise(F.greatest(F.lit(0.0), F.col("end_time_seconds") - F.col("start_time_seconds"))), 4))
    return r.withColumn("start_timestamp", T.clock(F.col("start_time_seconds"))).withColumn("end_timestamp", T.clock(F.col("end_time_seconds")))
