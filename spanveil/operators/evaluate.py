"""Span metrics: exact and partial matches, precision, recall and F scores, leakage, word errors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.policy import tier_of
from .intervals import covered


def f_score(p: Column, r: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return F.when(b * p + r > 0, F.round((1 + b) * p * r / (b * p + r), 4)).otherwise(0.0)


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return {"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": f_score(p, r), "f2": f_score(p, r, 2.0)}


def exact_counts(gold: DataFrame, pred: DataFrame, typed: bool = True) -> DataFrame:
    """(entity, tp, fp, fn): equal spans pair one to one, repeated ones by their order."""
    keys = ["conv_id", "start", "end", *(["entity"] if typed else [])]
    n = Window.partitionBy(*keys).orderBy(F.lit(1))
    side = lambda df, name: df.select(*keys, *([] if typed else ["entity"]), F.row_number().over(n).alias("n"), F.lit(True).alias(name))
    g, p = side(gold, "g"), side(pred, "p")
    if not typed:
        p = p.withColumnRenamed("entity", "p_entity")
    both = g.join(p, [*keys, "n"], "full")
    entity = F.col("entity") if typed else F.coalesce("entity", "p_entity")
    is_g, is_p = F.col("g").isNotNull(), F.col("p").isNotNull()
    return both.groupBy(entity.alias("entity")).agg(F.count_if(is_g & is_p).alias("tp"), F.count_if(~is_g).alias("fp"), F.count_if(~is_p).alias("fn"))


def matched(gold: list[tuple], pred: list[tuple], fit) -> set[int]:
    """Places of predicted spans that a gold span takes: each, in its order, the first free one that fits."""
    used: set[int] = set()
    for g in gold:
        used.update(next(([k] for k, p in enumerate(pred) if k not in used and fit(g, p)), ()))
    return used


def partial_counts(gold: DataFrame, pred: DataFrame, boundary: bool = False, typed: bool = True, order: str | None = None) -> DataFrame:
    """(entity, tp, fp, fn) of overlaps, greedy in the order of ``order`` (a column of both; starts without one).

    ``boundary`` asks for half of the gold span.  Untyped, a span may take one of
    another entity, and there is one row, its entity null.  The spans of a
    conversation, few as its text is long, meet in one Arrow function.
    """
    own = [order] if order else ["start", "end"]
    spans = F.array_sort(F.collect_list(F.struct(*own, *[F.col(c).alias(f"_{c}") for c in ("start", "end", "entity")])))
    key = ["conv_id"]
    side = lambda df, name: df.groupBy(*key).agg(F.transform(spans, lambda s: F.struct(s["_start"].alias("start"), s["_end"].alias("end"), s["_entity"].alias("entity"))).alias(name))
    both = side(gold, "g").join(side(pred, "p"), key, "full")

    def fit(g: tuple, p: tuple) -> bool:
        shared = min(g[1], p[1]) - max(g[0], p[0])
        return (not typed or g[2] == p[2]) and shared > 0 and (not boundary or 2 * shared >= g[1] - g[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str | None, list[int]] = {}
            for g, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                g, p = ([(s["start"], s["end"], s["entity"]) for s in x or ()] for x in (g, p))
                for entity in {s[2] for s in g + p} if typed else {None}:
                    g_own, p_own = ([s for s in x if not typed or s[2] == entity] for x in (g, p))
                    tp = len(matched(g_own, p_own, fit))
                    node = counts.setdefault(entity, [0, 0, 0])
                    for k, n in enumerate((tp, len(p_own) - tp, len(g_own) - tp)):
                        node[k] += n
            columns = [list(counts), *([n[k] for n in counts.values()] for k in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["entity", "tp", "fp", "fn"])

    out = both.select("conv_id", "g", "p").mapInArrow(run, "entity string, tp long, fp long, fn long")
    return out.groupBy("entity").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def summary(counts: DataFrame) -> DataFrame:
    """Rates by entity, tier and over all, in one pass."""
    rows = counts.withColumn("tier", tier_of(F.col("entity"))).groupingSets([["entity"], ["tier"], []], "entity", "tier").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return rows.select("entity", "tier", "tp", "fp", "fn", *[c.alias(n) for n, c in rates(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def uncovered(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(conv_id, n, leaks): direct gold spans, and those that predicted spans don't cover whole."""
    direct = covered(gold.where(tier_of(F.col("entity")) == "direct"), pred)
    return direct.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(~F.col("covered")).alias("leaks"))


def leakage(gold: DataFrame, pred: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """One row: direct gold spans, those not wholly covered, and the share of conversations with one.

    The share is of ``convs`` (conv_id), all conversations; without it, of those
    with a direct gold span.
    """
    own = uncovered(gold, pred)
    if convs is not None:
        own = convs.join(own, "conv_id", "left").na.fill(0, ["n", "leaks"])
    return own.agg(F.sum("n").alias("direct_spans"), F.sum("leaks").alias("leaked_spans"), F.round(F.avg((F.col("leaks") > 0).cast("double")), 4).alias("conversation_leakage"))


def false_redaction_rate(counts: DataFrame) -> DataFrame:
    """One row: predicted spans, those that overlap no gold span of their entity, and their share; from typed ``partial_counts``."""
    return counts.agg(F.sum(F.col("tp") + F.col("fp")).alias("predicted_spans"), F.sum("fp").alias("false_redactions")).withColumn("false_redaction_rate", F.round(F.try_divide("false_redactions", "predicted_spans"), 4))


def rank_within(df: DataFrame, key: str, near: Column, order: str, parts: int = 16) -> DataFrame:
    """``df`` with ``rank`` from 1 by ``order`` within ``key``: ranks within ranges of ``near``, plus the counts of the ranges before.

    ``near`` must not fall where ``order`` rises.  Equal ranges over all rows are
    told from a sample, which steers only how rows are dealt.
    """
    named = df.withColumn("__near", near)
    cuts = sorted(set(named.approxQuantile("__near", [k / parts for k in range(1, parts)], 0.01))) if parts > 1 else []
    part = sum((F.when(F.col("__near") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    named = named.withColumn("__part", part)
    within = F.row_number().over(Window.partitionBy(key, "__part").orderBy(order))
    counts = named.groupBy(key, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = named.withColumn("__r", within).join(counts.select(key, "__part", before.alias("__base")), [key, "__part"])
    return named.withColumn("rank", F.col("__r") + F.col("__base")).drop("__near", "__part", "__r", "__base")


def percentiles(df: DataFrame, key: str, c: str, shares: dict[str, float]) -> DataFrame:
    """sorted[int(share * (n - 1))] of each key, without nulls: counts by value, then their running sums.

    Only distinct values of a key meet in a task, and equal ones are counted
    before they move.
    """
    counts = df.where(F.col(c).isNotNull()).groupBy(key, c).agg(F.count("*").alias("n"))
    by = Window.partitionBy(key)
    past = F.sum("n").over(by.orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
    runs = counts.withColumn("past", past).withColumn("all", F.sum("n").over(by))
    at = lambda share: F.min(F.when(F.col("past") > F.floor((F.col("all") - 1) * F.lit(share)), F.col(c)))
    return runs.groupBy(key).agg(*[at(share).alias(name) for name, share in shares.items()])
