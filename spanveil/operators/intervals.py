"""Interval operators: as-of and overlap joins, gaps and islands, coverage, nearest starts.

All work within an equality key; intervals are half-open [start, end).  As-of,
nearest, coverage and containment are one sorted pass over the union of both
sides, so that a key with many rows costs no pairs; overlaps meet in buckets of
the start's range, so that only neighbours are compared.  The passes sort a key
in one task, spilling to disk; ``bucket`` splits the key of an overlap join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PAST = Window.unboundedPreceding


def clusters(spans: DataFrame, key: str = "conv_id", order: str = "ord") -> DataFrame:
    """``spans`` with ``cluster``: a new one where a start is at or past all ends before; touching spans stay apart."""
    by = Window.partitionBy(key).orderBy("start", F.desc("end"), order)
    reach = F.max("end").over(by.rowsBetween(_PAST, -1))
    marked = spans.withColumn("new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
    return marked.withColumn("cluster", F.sum("new").over(by.rowsBetween(_PAST, 0)).cast("int")).drop("new")


def islands(spans: DataFrame, key: list[str], gap: float = 0.0) -> DataFrame:
    """Spans of a key joined where the next starts at most ``gap`` past the last end: key, start, end, n."""
    by = Window.partitionBy(*key).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(_PAST, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0)
    marked = spans.select(*key, "start", "end", new.alias("new")).withColumn("island", F.sum("new").over(by.rowsBetween(_PAST, 0)))
    return marked.groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def _merged_sides(left: DataFrame, at: Column, right: DataFrame, place: Column, payload: Column, key: str, rights_first: bool) -> DataFrame:
    """Both sides in one table: key, at, side, row (of the left), right (payload of the right)."""
    kinds = (0, 1) if rights_first else (1, 0)
    row = F.struct(*[c for c in left.columns if c != key])
    a = left.select(F.col(key), at.alias("at"), F.lit(kinds[1]).alias("side"), row.alias("row"))
    b = right.select(F.col(key), place.alias("at"), F.lit(kinds[0]).alias("side"), payload.alias("right"))
    return a.unionByName(b, allowMissingColumns=True)


def turn_at(points: DataFrame, turns: DataFrame, at: str = "start") -> DataFrame:
    """As-of join: the first turn with char_start <= point <= char_end; turns don't overlap.

    The last two turns that start by a point are all that can hold it: a turn's
    end counts too, so a point may be the end of one and the start of the next.
    """
    turn = F.struct("char_start", "char_end", "turn_idx", "speaker")
    both = _merged_sides(points, F.col(at), turns, F.col("char_start"), turn, "conv_id", True)
    by = Window.partitionBy("conv_id").orderBy("at", "side")
    last = F.last("right", ignorenulls=True).over(by.rowsBetween(_PAST, 0))
    # of each turn the one before it, so that a point sees both
    ranked = both.withColumn("before", F.when(F.col("right").isNotNull(), F.last("right", ignorenulls=True).over(by.rowsBetween(_PAST, -1))))
    seen = ranked.withColumn("last", last).withColumn("earlier", F.last(F.when(F.col("right").isNotNull(), F.struct("before")), ignorenulls=True).over(by.rowsBetween(_PAST, 0))["before"])
    holds = lambda t: F.when((t["char_start"] <= F.col("at")) & (F.col("at") <= t["char_end"]), t)
    found = seen.where("row is not null").withColumn("t", F.coalesce(holds(F.col("earlier")), holds(F.col("last")))).where("t is not null")
    return found.select("conv_id", *[F.col(f"row.{c}").alias(c) for c in points.columns if c != "conv_id"], "t.turn_idx", "t.speaker")


def overlaps(a: DataFrame, b: DataFrame, key: str = "conv_id", bucket: int | None = None) -> DataFrame:
    """Interval join: rows of both (columns of ``b`` with prefix b_) and their common part lo, hi.

    Intervals meet in each bucket of ``bucket`` units that both touch, and a pair
    counts in the one where its common part starts.  Without ``bucket`` it is
    four times the mean length of the intervals.
    """
    if bucket is None:
        mean = a.select("start", "end").union(b.select("start", "end")).agg(F.avg(F.col("end") - F.col("start"))).first()[0]
        bucket = max(1, int(4 * (mean or 1)))
    spread = lambda df: df.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / bucket))))
    named = spread(b).select(F.col(key), F.col("__bucket"), *[F.col(c).alias(f"b_{c}") for c in b.columns if c != key])
    joined = spread(a).join(named, [key, "__bucket"]).where((F.col("start") < F.col("b_end")) & (F.col("end") > F.col("b_start")))
    joined = joined.withColumn("lo", F.greatest("start", "b_start")).withColumn("hi", F.least("end", "b_end"))
    return joined.where(F.col("__bucket") == F.floor(F.col("lo") / bucket)).drop("__bucket")


def _reach(spans: DataFrame, by: DataFrame, key: str) -> DataFrame:
    """``spans`` as (key, row, reach): the furthest end of what in ``by`` starts no later than the span."""
    both = _merged_sides(spans, F.col("start"), by, F.col("start"), F.col("end"), key, True)
    order = Window.partitionBy(key).orderBy("at", "side").rowsBetween(_PAST, 0)
    return both.withColumn("reach", F.max("right").over(order)).where("row is not null")


def not_inside(a: DataFrame, b: DataFrame, key: str = "conv_id") -> DataFrame:
    """Left-anti join: spans of ``a`` that no span of ``b`` contains."""
    apart = _reach(a, b, key).where(F.col("reach").isNull() | (F.col("reach") < F.col("row.end")))
    return apart.select(*[F.col(key) if c == key else F.col(f"row.{c}").alias(c) for c in a.columns])


def covered(spans: DataFrame, by: DataFrame, key: str = "conv_id") -> DataFrame:
    """``spans`` with ``covered``: whether the union of ``by`` holds each whole."""
    union = islands(by.select(key, "start", "end"), [key])
    hit = _reach(spans, union, key).withColumn("covered", F.coalesce(F.col("reach") >= F.col("row.end"), F.lit(False)))
    return hit.select(*[F.col(key) if c == key else F.col(f"row.{c}").alias(c) for c in spans.columns], "covered")


def nearest_within(a: DataFrame, b: DataFrame, window: Column | int, key: str = "conv_id") -> DataFrame:
    """Band join: for each row of ``a`` the nearest start of ``b`` at most ``window`` away (the earlier of two), and the distance."""
    both = _merged_sides(a, F.col("start"), b.select(key, "start"), F.col("start"), F.col("start"), key, True)
    order = Window.partitionBy(key).orderBy("at", "side")
    before = F.last("right", ignorenulls=True).over(order.rowsBetween(_PAST, 0))
    after = F.first("right", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    seen = both.withColumn("before", before).withColumn("after", after).where("row is not null")
    near = F.when(F.col("after").isNull() | (F.col("at") - F.col("before") <= F.col("after") - F.col("at")), F.col("before")).otherwise(F.col("after"))
    seen = seen.withColumn("nearest", near).withColumn("distance", F.abs(F.col("at") - F.col("nearest"))).where(F.col("distance") <= window)
    return seen.select(*[F.col(key) if c == key else F.col(f"row.{c}").alias(c) for c in a.columns], "nearest", "distance")
