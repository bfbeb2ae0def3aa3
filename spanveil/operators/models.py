"""What model detectors need around a model: labels of token tags, spans of tags, texts cut to a token budget.

No model is part of the library; ``register`` names a detector type, and its
maker gives a function from a text to (start, end, label, score).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.policy import Config

#: Marks of the beginning, inside, end, only and no token of a span.
MARKS = "BIELSUO"


def split_label(tag: str) -> tuple[str, str]:
    """The mark and label of a token tag; one without mark is inside."""
    mark, _, label = tag.partition("-") if tag[:1] in MARKS and tag[1:2] in ("-", "_") else ("I", "", tag)
    if not label and tag[1:2] == "_":
        mark, label = tag[0], tag[2:]
    return ("O", "") if tag == "O" else (mark, label)


def tag_spans(tags: list[tuple[int, int, str, float]]) -> Iterator[tuple[int, int, str, float]]:
    """Spans of tokens (start, end, tag, score): one begins at B, S or U or where the label changes, and ends after E, L, S or U; its score is the mean."""
    run: list[tuple[int, int, float]] = []
    current, closed = "", False
    for start, end, tag, score in [*tags, (0, 0, "O", 0.0)]:
        mark, label = split_label(tag)
        if run and (mark in "BSUO" or label != current or closed):
            yield run[0][0], run[-1][1], current, sum(s for _, _, s in run) / len(run)
            run = []
        if mark != "O":
            run.append((start, end, score))
            current, closed = label, mark in "ELSU"


def within_budget(text: str, count: Callable[[str], int], budget: int = 256, overlap: int = 40) -> Iterator[tuple[int, int]]:
    """Bounds of parts of a text that ``count`` finds within a budget of tokens: halves that share ``overlap`` characters, halved again."""
    todo = [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= 2 * overlap or count(text[lo:hi]) <= budget:
            yield lo, hi
        else:
            middle = (lo + hi) // 2
            todo += [(middle - overlap // 2, hi), (lo, middle + overlap // 2)]


def map_labels(detections: DataFrame, config: Config, family: str | Column) -> DataFrame:
    """``detections`` with the entity of each raw_label: the family's map, else the label if it is an entity; kept and unknown ones go."""
    table = [(f, label, entity) for f, labels in config.label_maps.items() for label, entity in labels.items()]
    maps = F.broadcast(detections.sparkSession.createDataFrame(table, "__family string, __label string, __entity string"))
    own = F.lit(family) if isinstance(family, str) else family
    joined = detections.withColumn("__f", own).withColumn("__l", F.lower(F.trim("raw_label")))
    joined = joined.join(maps, (F.col("__f") == F.col("__family")) & (F.col("__l") == F.col("__label")), "left")
    upper = F.replace(F.upper(F.trim("raw_label")), F.lit(" "), F.lit("_"))
    entity = F.coalesce("__entity", F.when(upper.isin(*config.entities), upper))
    return joined.withColumn("entity", entity).where(F.col("entity").isNotNull() & (F.col("entity") != "KEEP")).drop("__f", "__l", "__family", "__label", "__entity")


def best_claims(detections: DataFrame) -> DataFrame:
    """Of equal (conv_id, start, end, entity) the one with the best score."""
    others = [c for c in detections.columns if c not in ("conv_id", "start", "end", "entity")]
    best = detections.groupBy("conv_id", "start", "end", "entity").agg(F.max_by(F.struct(*others), "score").alias("b"))
    return best.select("conv_id", "start", "end", "entity", "b.*")
