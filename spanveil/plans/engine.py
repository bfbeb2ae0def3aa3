"""The engine: turns in, sanitised conversations, spans, findings and a status out.

A conversation is one row from the moment its turns are gathered, so the whole
of it is one narrow step: one shuffle on the conversation's id, then one Arrow
function that detects, fuses, rewrites, scans its own output and decides.
Values known for all conversations go to executors in blocks of bounded size:
one block is a broadcast of that step; of longer lists each block is a pass of
its own, and its claims come back by id.
"""

from __future__ import annotations

import math
import time
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.plain import normalize
from ..operators import audio, gate, resolve, roles, rules
from ..operators.claims import CLAIM, Claim
from ..operators.context import Context
from ..operators.known import BLOCK, Known, checked, collected, value_blocks
from ..sources import loaders
from .policy import REGISTRY, Config
from .storage import stored

_SOURCE = "struct<detector: string, entity: string, score: double, start: int, end: int, channel: string>"
_SPAN = f"struct<start: int, end: int, entity: string, tier: string, score: double, action: string, replacement: string, risk: double, risk_reasons: array<string>, turn_idx: int, sources: array<{_SOURCE}>>"
_TURN = "struct<turn_idx: int, speaker: string, role: string, text: string, t_start: double, t_end: double, redactions: int>"
_FINDING = "struct<check: string, severity: string, message: string, detail: map<string, string>>"
_QUASI = "struct<risk_score: double, entity_counts: map<string, int>, combinations: array<struct<entities: array<string>, co_located: boolean, weight: double>>, escalated_spans: int>"
_STATS = f"struct<n_detections: int, n_spans: int, direct_spans: int, spans_by_entity: map<string, int>, spans_by_action: map<string, int>, detector_contribution: map<string, struct<spans: int, sole_source: int>>, speaker_roles: map<string, string>, pseudonym_pools: map<string, int>, quasi: {_QUASI}, audio: map<string, double>, characters: int, redacted_characters: int, redacted_fraction: double, turns: int, qa_counts: map<string, int>, detect_s: double, total_s: double>"
_INTERVAL = "struct<start: double, end: double, entity: string, action: string, mode: string, turn_index: int, words: int>"
RESULT = f"conv_id string, status string, sanitized_text string, turns array<{_TURN}>, spans array<{_SPAN}>, detections array<{CLAIM}>, findings array<{_FINDING}>, risk double, stats {_STATS}, audio_plan array<{_INTERVAL}>, pseudonyms map<string, string>"
#: Conversations that leave an executor's Python at once.
ROWS_OUT = 64


def plugged(spec: dict, config: Config, find: Callable) -> Callable[[str, Callable], list[Claim]]:
    """A detector around a model: ``find`` gives (start, end, label, score) of a chunk; labels are mapped, and of equal claims the best stays."""
    weight, family = float(spec.get("weight", 1.0)), spec.get("family", spec.get("type", ""))

    def run(text: str, role_at: Callable) -> list[Claim]:
        best: dict[tuple[int, int, str], Claim] = {}
        for lo, hi in resolve.chunk_bounds(text, int(spec.get("chunk_chars", 1800)), int(spec.get("chunk_words", 180))) if text else ():
            for start, end, label, score in find(text[lo:hi]):
                entity = config.map_label(family, label)
                if entity is None and config.get("fusion.drop_unmapped", True):
                    continue
                c = Claim(lo + start, lo + end, entity or label.upper().replace(" ", "_"), min(1.0, max(0.0, score * weight)), spec["name"], label)
                key = (c.start, c.end, c.entity)
                if key not in best or best[key].score < c.score:
                    best[key] = c
        return list(best.values())

    return run


def in_bounds(claims: list[Claim], text: str, strict: bool) -> list[Claim]:
    """Claims within the text; in strict mode one outside, or without a finite score, stops the job."""
    out = []
    for c in claims:
        if strict and not (math.isfinite(c.score) and 0 <= c.start < c.end <= len(text)):
            raise RuntimeError(f"detector {c.detector} gave an invalid claim")
        c.start, c.end = max(0, c.start), min(len(text), c.end)
        if c.start < c.end:
            out.append(c)
    return out


class Worker:
    """An engine's settings made ready on an executor."""

    def __init__(self, config: Config, only: list[str] | None, values: list[tuple[str, str]], key: bytes | None, makers: dict[str, Callable]):
        self.config, self.key, self.strict = config, key, bool(config.get("runtime.strict_detectors", True))
        self.finders: list[Callable[[str, Callable], list[Claim]]] = []
        self.spec: dict | None = None
        for spec in config.chosen(only, makers):
            kind = spec["type"]
            if kind == "known_values":
                self.spec = spec
            elif kind == "regex":
                more = rules.user_rules(spec.get("patterns"))
                self.finders.append(lambda text, role_at, more=more, name=spec["name"]: rules.claims(text, more, name))
            elif kind == "context":
                self.finders.append(Context.of(spec).claims)
            elif kind in makers:
                self.finders.append(plugged(spec, config, makers[kind](spec, config)))
        self.known = [Known(values, self.spec)] if values else []
        self.names = [roles.NameRoles(values)] if values else []
        self.values = values

    def _found(self, text: str, turns: list[dict]) -> list[Claim]:
        starts = [t["char_start"] for t in turns]

        def role_at(at: int) -> str | None:
            t = turns[max(0, bisect_right(starts, at) - 1)] if turns else None
            return t["role"] if t and t["char_start"] <= at <= t["char_end"] else None

        out = []
        for find in self.finders:
            try:
                out += in_bounds(find(text, role_at), text, self.strict)
            except Exception as e:
                if self.strict:
                    raise RuntimeError(f"a required detector failed: {type(e).__name__}") from None
        return out

    def __call__(self, row: dict) -> dict:
        config, began = self.config, time.perf_counter()
        turns, language = loaders.checked_turns(row["turns"]), row.get("language") or config.get("language", "en")
        own = checked([(k["entity"].upper(), k["value"].strip()) for k in loaders.known_of(row.get("known"))], config)
        known = self.known + ([Known(own, self.spec)] if own else [])
        given = {g["speaker"]: g["role"] for g in row.get("overrides") or ()}
        text = "\n".join(t["text"] for t in turns)
        names = [*self.names, *([roles.NameRoles(own)] if own else [])]
        if named := {t["speaker"]: t["named"] for t in turns if t.get("named")}:
            names.append(roles.Named(named))
        role = roles.speaker_roles(turns, given, names)
        for t in turns:
            t["role"] = role[t["speaker"]]
        claims = [Claim(c["start"], c["end"], c["entity"], c["score"], c["detector"], "known_value", c["channel"], c["raw_label"], c["partial"]) for c in row.get("claims") or ()]
        for k in known if self.spec else ():
            claims += k.claims(text)
        claims += self._found(text, turns)
        detected = time.perf_counter()
        spans = resolve.fuse(text, claims, config)
        report = resolve.combine(text, spans, config)
        alloc = resolve.Allocator(config, row["conv_id"], self.key)
        out, spans = resolve.rewrite(text, turns, spans, config, alloc, [*self.values, *own])
        sanitized = "\n".join(t["text"] for t in out)
        intervals = audio.plan(turns, spans, config)
        if not config.get("qa.enabled", True):
            findings, status = [gate.finding("qa_disabled", "warn", "the checks are off")], "review"
        else:
            findings = gate.source_checks(text, language, config)
            findings += gate.leak_checks([x for k in known for x in k.leaks(sanitized)])
            if config.get("qa.rescan", True):
                at, again = 0, []
                for t in out:
                    again.append({"role": t["role"], "char_start": at, "char_end": at + len(t["text"])})
                    at += len(t["text"]) + 1
                findings += gate.residual_checks(self._found(sanitized, again), sanitized, config)
            findings += gate.output_checks(sanitized, config) + gate.span_checks(turns, text, spans, config) + gate.risk_checks(report)
            findings, status = gate.settle(findings, config)
        return {
            "conv_id": row["conv_id"],
            "status": status,
            "sanitized_text": sanitized,
            "turns": out,
            "spans": [span_row(s) for s in spans],
            "detections": [{"detector": c.detector, "raw_label": "", "entity": c.entity, "start": c.start, "end": c.end, "score": c.score, "channel": c.channel, "known": c.value is not None, "partial": c.partial} for c in claims],
            "findings": findings,
            "risk": report["risk_score"],
            "stats": statistics_of(text, turns, out, claims, spans, report, alloc, findings, intervals) | {"detect_s": round(detected - began, 4), "total_s": round(time.perf_counter() - began, 4)},
            "audio_plan": intervals,
            "pseudonyms": list(alloc.mapping().items()) if config.get("surrogates.keep_mapping", False) else [],
        }


def span_row(s: resolve.Span) -> dict:
    """A span without the text it stands for; what is kept has no replacement either."""
    sources = [{"detector": c.detector, "entity": c.entity, "score": round(c.score, 4), "start": c.start, "end": c.end, "channel": c.channel} for c in s.sources]
    return {"start": s.start, "end": s.end, "entity": s.entity, "tier": s.tier, "score": s.score, "action": s.action, "replacement": "" if s.action == "keep" else s.replacement, "risk": s.risk, "risk_reasons": s.reasons, "turn_idx": s.turn, "sources": sources}


def _counted(items) -> list[tuple[str, int]]:
    """Counts, the most frequent first."""
    counts: dict[str, int] = {}
    for x in items:
        counts[x] = counts.get(x, 0) + 1
    return sorted(counts.items(), key=lambda kv: -kv[1])


def statistics_of(text, turns, out, claims, spans, report, alloc, findings, intervals) -> dict:
    by = [sorted({c.detector for c in s.sources}) for s in spans]
    share: dict[str, dict[str, int]] = {}
    for names in by:
        for n in names:
            node = share.setdefault(n, {"spans": 0, "sole_source": 0})
            node["spans"] += 1
            node["sole_source"] += len(names) == 1
    gone = sum(s.end - s.start for s in spans if s.action != "keep")
    counts = dict(_counted(f["severity"] for f in findings))
    return {
        "n_detections": len(claims),
        "n_spans": len(spans),
        "direct_spans": sum(s.tier == "direct" for s in spans),
        "spans_by_entity": _counted(s.entity for s in spans),
        "spans_by_action": _counted(s.action for s in spans),
        "detector_contribution": list(share.items()),
        "speaker_roles": list({o["speaker"]: t["role"] for o, t in zip(out, turns, strict=True)}.items()),
        "pseudonym_pools": list(alloc.inventory().items()),
        "quasi": {"risk_score": round(report["risk_score"], 3), "entity_counts": list(report["entity_counts"].items()), "combinations": report["combinations"], "escalated_spans": report["escalated_spans"]},
        "audio": list(audio.coverage(turns, intervals).items()) if intervals else [],
        "characters": len(text),
        "redacted_characters": gone,
        "redacted_fraction": round(gone / len(text), 4) if text else 0.0,
        "turns": len(turns),
        "qa_counts": [(s, counts.get(s, 0)) for s in ("fail", "warn", "info")],
    }


class Engine:
    """De-identifies conversations.

    ``values`` is (conv_id, entity, value), with a null conv_id for all
    conversations; without the column all are for all.  ``overrides`` is
    (conv_id, speaker, role).
    """

    def __init__(self, spark: SparkSession, config: Config | None = None, hmac_key: bytes | None = None, only: list[str] | None = None):
        self.spark, self.config, self.key, self.only = spark, config or Config(), hmac_key, only
        self.config.chosen(only)
        resolve.Allocator(self.config, "check", hmac_key)

    def conversations(self, turns: DataFrame, values: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
        """A row a conversation: conv_id, turns, known, overrides, language."""
        own = F.struct(*[c for c in ("turn_idx", "speaker", "text", "t_start", "t_end", "words", "char_start", "char_end") if c in turns.columns])
        meta = [F.first(c, ignorenulls=True).alias(c) for c in ("language", "known", "overrides") if c in turns.columns]
        convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(own)).alias("turns"), *meta)
        for name, kind in (("known", loaders.KNOWN), ("overrides", loaders.OVERRIDES), ("language", "string")):
            if name not in convs.columns:
                convs = convs.withColumn(name, F.expr(f"cast(null as {kind})"))
        more = [("overrides", overrides, F.struct("speaker", "role"))]
        if values is not None and "conv_id" in values.columns:
            more.append(("known", values.where("conv_id is not null"), F.struct("entity", "value")))
        for name, table, item in more:
            if table is not None:
                added = table.groupBy(F.col("conv_id").cast("string").alias("conv_id")).agg(F.collect_list(item).alias("added"))
                both = F.concat(F.coalesce(F.col(name), F.expr(f"cast(array() as {loaders.OVERRIDES if name == 'overrides' else loaders.KNOWN})")), F.col("added"))
                convs = convs.join(added, "conv_id", "left").withColumn(name, F.coalesce(both, F.col(name))).drop("added")
        return convs

    def deidentify(self, turns: DataFrame, values: DataFrame | None = None, overrides: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
        """``RESULT``: a row a conversation; no column holds source text.  A null or empty text is no turn, and no turns no row."""
        convs = self.conversations(turns, values, overrides)
        shared = self.config.raw.get("known_values")
        pairs = checked(collected(shared), self.config)
        if values is not None:
            everyone = values.where("conv_id is null") if "conv_id" in values.columns else values
            blocks = value_blocks(everyone, block)
            pairs += checked(next(blocks, []), self.config)
            more = next(blocks, None)
            if more is not None:
                return self._by_blocks(stored(convs, "conversations"), [pairs, more, *blocks])
        return self._run(convs, pairs)

    def _run(self, convs: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
        config, only, key, makers = self.config, self.only, self.key, dict(REGISTRY)
        shared = self.spark.sparkContext.broadcast(pairs)
        schema = to_arrow_schema(StructType.fromDDL(RESULT))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker = None
            for batch in batches:
                worker = worker or Worker(config, only, shared.value, key, makers)
                for at in range(0, len(batch), ROWS_OUT):
                    done = [worker(row) for row in batch.slice(at, ROWS_OUT).to_pylist()]
                    yield pa.RecordBatch.from_pylist(done, schema)

        return convs.mapInArrow(run, RESULT)

    def _by_blocks(self, convs: DataFrame, blocks: list[list[tuple[str, str]]]) -> DataFrame:
        """For more values than one broadcast holds: claims, speakers' names and leaks of each block in a pass of its own."""
        spec = next((d for d in self.config.chosen(self.only) if d["type"] == "known_values"), None)
        texts = convs.select("conv_id", F.array_join(F.transform("turns", lambda t: t["text"]), "\n").alias("text"))
        shared = [self.spark.sparkContext.broadcast(checked(b, self.config)) for b in blocks]
        if spec:
            item = F.struct("detector", "raw_label", "entity", "start", "end", "score", "channel", F.lit(True).alias("known"), "partial")
            found = reduce(DataFrame.unionByName, [_known_rows(texts, s, spec) for s in shared])
            convs = convs.join(found.groupBy("conv_id").agg(F.collect_list(item).alias("claims")), "conv_id", "left")
        speakers = convs.select(F.explode("turns.speaker").alias("speaker")).distinct()
        named = reduce(DataFrame.union, [_named_roles(speakers, s) for s in shared]).groupBy("speaker").agg(F.min_by("role", "rank").alias("named"))
        each = convs.select("conv_id", F.explode("turns").alias("t")).join(named, F.col("t.speaker") == F.col("speaker"), "left")
        again = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("t.*", "named"))).alias("turns"))
        done = stored(self._run(convs.drop("turns").join(again, "conv_id"), []), "rewritten")
        if not self.config.get("qa.enabled", True):
            return done
        left = reduce(DataFrame.union, [_leak_rows(done.select("conv_id", "sanitized_text"), s, spec) for s in shared])
        severity = "fail" if gate.settle([gate.finding("known_value_leak", "fail", "")], self.config)[0][0]["severity"] == "fail" else "warn"
        finding = F.struct(F.lit("known_value_leak").alias("check"), F.lit(severity).alias("severity"), F.concat(F.lit("known "), F.col("entity"), F.lit(" survived")).alias("message"), F.create_map(F.lit("entity"), F.col("entity"), F.lit("at"), F.col("at").cast("string"), F.lit("end"), F.col("past").cast("string")).alias("detail"))
        done = done.join(left.groupBy("conv_id").agg(F.collect_list(finding).alias("leaks")), "conv_id", "left")
        findings = F.when(F.col("leaks").isNull(), F.col("findings")).otherwise(F.concat("findings", "leaks"))
        done = done.withColumn("findings", findings)
        return done.withColumn("status", F.when(F.col("leaks").isNull(), F.col("status")).otherwise(decide(F.col("findings"), bool(self.config.get("qa.fail_closed", True))))).drop("leaks")

    def from_text(self, text: str, conv_id: str = "text", fmt: str = "auto") -> DataFrame:
        return loaders.load_texts(self.spark.createDataFrame([(conv_id, text)], "conv_id string, value string"), fmt)

    def from_files(self, path: str, fmt: str | None = None) -> DataFrame:
        return loaders.load_files(self.spark, path, fmt)


def _rows(df: DataFrame, schema: str, find: Callable) -> DataFrame:
    """The rows that ``find`` gives for each pair of the first two columns."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([r for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in find(*row)], kind)

    return df.mapInArrow(run, schema)


def _once(make: Callable):
    held: list = []
    return lambda: held[0] if held else held.append(make()) or held[0]


def _known_rows(texts: DataFrame, shared, spec: dict) -> DataFrame:
    known = _once(lambda: Known(shared.value, spec))
    row = lambda conv_id, c: {"conv_id": conv_id, "detector": c.detector, "raw_label": c.value, "entity": c.entity, "start": c.start, "end": c.end, "score": c.score, "channel": c.channel, "partial": c.partial}
    return _rows(texts, "conv_id string, detector string, raw_label string, entity string, start int, end int, score double, channel string, partial boolean", lambda conv_id, text: [row(conv_id, c) for c in known().claims(text)])


def _leak_rows(texts: DataFrame, shared, spec: dict | None) -> DataFrame:
    known = _once(lambda: Known(shared.value, spec))
    return _rows(texts, "conv_id string, entity string, at int, past int", lambda conv_id, text: [{"conv_id": conv_id, "entity": e, "at": lo, "past": hi} for e, lo, hi in known().leaks(text)])


def _named_roles(speakers: DataFrame, shared) -> DataFrame:
    names, order = _once(lambda: roles.NameRoles(shared.value)), list(roles.KNOWN_ROLE.values())

    def find(speaker):
        role = names().role(normalize(speaker))
        return [{"speaker": speaker, "rank": order.index(role), "role": role}] if role else []

    return _rows(speakers, "speaker string, rank int, role string", find)


def decide(findings: Column, fail_closed: bool = True) -> Column:
    """blocked on any failure (review if not fail-closed), review on any warning, else passed."""
    has = lambda s: F.exists(findings, lambda f: f["severity"] == s)
    return F.when(has("fail"), "blocked" if fail_closed else "review").when(has("warn"), "review").otherwise("passed")


def release_view(results: DataFrame, allow_review: bool = False) -> DataFrame:
    """Texts of conversations that may go out; others are withheld."""
    free = F.col("status").isin("passed", *(["review"] if allow_review else []))
    return results.select("conv_id", "status", F.when(free, F.col("sanitized_text")).alias("text"), (~free).alias("text_withheld"))


def statistics(results: DataFrame) -> DataFrame:
    """(entity, action, n, n_sole, characters): spans, those one detector alone found, and characters replaced."""
    rows = results.select("conv_id", F.inline("spans"))
    sole = F.size(F.array_distinct(F.transform("sources", lambda s: s["detector"]))) == 1
    return rows.groupBy("entity", "action").agg(F.count("*").alias("n"), F.count_if(sole).alias("n_sole"), F.sum(F.col("end") - F.col("start")).alias("characters"))


def contributions(results: DataFrame) -> DataFrame:
    """(detector, spans, sole_source) over all conversations."""
    each = results.select(F.explode("stats.detector_contribution").alias("detector", "c"))
    return each.groupBy("detector").agg(F.sum("c.spans").alias("spans"), F.sum("c.sole_source").alias("sole_source"))
