"""Scores of the engine on labelled conversations: matches by mode, leakage, what goes needlessly, speed."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate
from ..sources import loaders
from .engine import Engine, _rows
from .policy import Config
from .storage import stored


def read_gold(spark: SparkSession, path: str, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """Turns, and gold spans (conv_id, ord, start, end, entity), of JSON lines with turns, spans and known values.

    Blank lines are skipped; a span outside its text, or of no entity, stops the job.
    """
    entities = set((config or Config()).entities)
    lines = spark.read.text(path).where("trim(value) <> ''")
    lines = stored(lines.select(F.sha2(F.concat_ws("|", F.input_file_name(), F.monotonically_increasing_id()), 256).alias("conv_id"), "value"), "gold")

    def spans(conv_id: str, value: str) -> Iterator[dict]:
        record = json.loads(value)
        if not isinstance(record, dict) or not isinstance(record.get("spans"), list):
            raise loaders.InputError("a labelled conversation needs a list of spans")
        size = len("\n".join(t["text"] for t in loaders.parse(value, "json")))
        for k, s in enumerate(record["spans"]):
            start, end = s.get("start"), s.get("end")
            if type(start) is not int or type(end) is not int or not 0 <= start < end <= size or s.get("entity") not in entities:
                raise loaders.InputError("annotation")
            yield {"conv_id": conv_id, "ord": k, "start": start, "end": end, "entity": s["entity"]}

    gold = _rows(lines, "conv_id string, ord int, start int, end int, entity string", spans)
    return loaders.load_texts(lines, "json"), gold


def read_labelled_table(spark: SparkSession, path: str, rows: int | None = None, seed: str = "spanveil") -> tuple[DataFrame, DataFrame]:
    """Texts as turns, and where each entity's surface stands in them, of a Parquet table (text, entities, domain).

    ``entities`` is JSON: [{"entity": surface, "types": [...]}].  ``rows`` of the
    table, if given, are those with the smallest hash of their text.
    """
    table = spark.read.parquet(path).where("text is not null").withColumn("conv_id", F.sha2(F.concat(F.lit(seed), F.lit("|"), "text"), 256))
    table = table.orderBy("conv_id").limit(rows) if rows else table
    kind = "array<struct<entity: string, types: array<string>>>"
    found = table.select("conv_id", "text", F.explode(F.from_json(F.translate(F.col("entities").cast("string"), "'", '"'), kind)).alias("e"))
    places = found.select("conv_id", F.expr("locate(e.entity, text)").alias("at"), F.length("e.entity").alias("n"), F.upper(F.get("e.types", F.lit(0))).alias("entity")).where("at > 0")
    gold = places.select("conv_id", F.col("at").alias("ord"), (F.col("at") - 1).cast("int").alias("start"), (F.col("at") - 1 + F.col("n")).cast("int").alias("end"), "entity")
    return loaders.from_turns(table.withColumn("turn", F.lit(0)).withColumn("role", F.lit("SPEAKER_UNKNOWN"))), gold


def predicted(results: DataFrame) -> DataFrame:
    """(conv_id, ord, start, end, entity) of the spans of ``deidentify`` that are not kept."""
    each = results.select("conv_id", F.posexplode("spans").alias("ord", "s")).where("s.action <> 'keep'")
    return each.select("conv_id", "ord", "s.start", "s.end", "s.entity")


def score(gold: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """Tables: overall by mode, partial by entity (worst recall first) and tier, leakage, false redactions, a row a conversation."""
    pred = predicted(results)
    modes = {"exact": evaluate.exact_counts(gold, pred), "partial": evaluate.partial_counts(gold, pred, order="ord"), "untyped_partial": evaluate.partial_counts(gold, pred, typed=False, order="ord")}
    total = lambda df: df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    overall = None
    for mode, counts in modes.items():
        row = total(counts).select(F.lit(mode).alias("mode"), "tp", "fp", "fn", *[c.alias(n) for n, c in evaluate.rates(F.col("tp"), F.col("fp"), F.col("fn")).items()])
        overall = row if overall is None else overall.unionByName(row)
    by = evaluate.summary(modes["partial"])
    counts = lambda df, name: df.groupBy("conv_id").agg(F.count("*").alias(name))
    fails = F.size(F.filter("findings", lambda f: f["severity"] == "fail"))
    each = results.select("conv_id", "status", fails.alias("qa_fail")).join(counts(gold, "n_gold"), "conv_id", "left").join(counts(pred, "n_pred"), "conv_id", "left").na.fill(0, ["n_gold", "n_pred"])
    return {
        "overall": overall,
        "by_entity": by.where("entity is not null").orderBy("recall"),
        "by_tier": by.where("tier is not null"),
        "leakage": evaluate.leakage(gold, pred, results.select("conv_id")),
        "false_redactions": evaluate.false_redaction_rate(modes["partial"]),
        "conversations": each,
    }


def benchmark(gold: DataFrame, texts: DataFrame, results: DataFrame) -> DataFrame:
    """One row of release figures; ``texts`` is (conv_id, text) of the source.

    Conversations by status, those in which a direct identifier survives as it
    was, the share of characters that went from conversations without
    identifiers, and the time that a conversation took.
    """
    direct = gold.where(evaluate.tier_of(F.col("entity")) == "direct").join(texts, "conv_id")
    surfaces = direct.groupBy("conv_id").agg(F.collect_set(F.lower(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")))).alias("surfaces"))
    leaks = evaluate.uncovered(gold, predicted(results))
    marked = results.join(surfaces, "conv_id", "left").join(leaks, "conv_id", "left").join(gold.select("conv_id").distinct().withColumn("labelled", F.lit(True)), "conv_id", "left")
    retained = F.coalesce(F.exists("surfaces", lambda s: F.contains(F.lower("sanitized_text"), s)), F.lit(False))
    passed, clean, ms = F.col("status") == "passed", F.col("labelled").isNull(), F.col("stats.total_s") * 1000
    at = lambda share: F.expr(f"percentile_disc({share}) within group (order by ms)")
    rows = marked.select("*", retained.alias("retained"), ms.alias("ms"), F.coalesce(F.col("leaks") > 0, F.lit(False)).alias("leaking"))
    return rows.agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("surfaces").isNotNull()).alias("direct_identifier_documents"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "review", "blocked")],
        F.count_if("retained").alias("retained_direct_surface_documents"),
        F.count_if(F.col("retained") & passed).alias("passed_with_retained_direct_surface"),
        F.count_if(F.col("leaking") & passed).alias("passed_with_uncovered_direct_span"),
        F.round(F.try_divide(F.sum(F.when(clean, F.col("stats.redacted_characters"))), F.sum(F.when(clean, F.col("stats.characters")))), 6).alias("negative_redacted_character_fraction"),
        F.round(at(0.5), 3).alias("latency_ms_p50"),
        F.round(at(0.95), 3).alias("latency_ms_p95"),
        F.round(F.try_divide(F.sum("stats.characters"), F.sum(F.col("stats.total_s"))), 1).alias("characters_per_second"),
    )


def run(spark: SparkSession, path: str, config: Config | None = None) -> dict[str, DataFrame]:
    """``score`` of the engine on a file of labelled conversations."""
    turns, gold = read_gold(spark, path, config)
    results = stored(Engine(spark, config).deidentify(turns), "scored")
    if results.isEmpty():
        raise ValueError("evaluation needs a labelled conversation")
    return score(stored(gold, "gold_spans"), results)


def word_errors(words: DataFrame) -> DataFrame:
    """pii_token_wer, wer and pii_tokens of each row of ``words`` (utt_id, ref, hyp, pii_idx)."""
    from ..operators.resolve import pii_word_errors

    def each(utt, ref, hyp, pii):
        return [{"utt_id": utt, **pii_word_errors(ref or [], hyp or [], set(pii or ()))}]

    return _rows(words.select("utt_id", "ref", "hyp", "pii_idx"), "utt_id string, pii_token_wer double, wer double, pii_tokens int", each)


__all__ = ["benchmark", "predicted", "read_gold", "read_labelled_table", "run", "score", "word_errors"]
