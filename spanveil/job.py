"""The job: ``python -m spanveil run | detectors | eval | offsets | audio-plan | selftest``."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.audio import ffmpeg_command
from .plans import evaluation
from .plans.engine import Engine
from .plans.policy import BUILT_IN, REGISTRY, Config, read_settings
from .sources import loaders

#: Exit codes.
OK, ERROR, REVIEW, BLOCKED = 0, 2, 10, 20
FORMATS = ("auto", "text", "json", "jsonl", "srt", "vtt")


def settings(args: argparse.Namespace) -> Config:
    config = Config.load(args.config)
    if args.known:
        config.set("known_values", read_settings(args.known))
    for pair in args.set or ():
        name, _, value = pair.partition("=")
        try:
            config.set(name.strip(), json.loads(value))
        except json.JSONDecodeError:
            config.set(name.strip(), value)
    config.enable(args.enable or [])
    config.enable(args.disable or [], False)
    for name in ("scope", "style"):
        if getattr(args, name, None):
            config.set(f"surrogates.{name}", getattr(args, name))
    if getattr(args, "no_qa", False):
        config.set("qa.enabled", False)
    return config


def write_private(path: str, text: str) -> None:
    """Puts a file that its owner alone can read in the place of another, at once."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, prefix=".spanveil-", encoding="utf-8", delete=False) as f:
        f.write(text if text.endswith("\n") else text + "\n")
    try:
        os.replace(f.name, path)
    except OSError:
        os.unlink(f.name)
        raise


def _turns(spark: SparkSession, source: str, fmt: str, conv_id: str | None) -> DataFrame:
    if source == "-":
        raw = spark.createDataFrame([(conv_id or "stdin", sys.stdin.read())], "conv_id string, value string")
        return loaders.load_texts(raw, fmt)
    turns = loaders.load_files(spark, source, None if fmt == "auto" else fmt)
    return turns.withColumn("conv_id", F.lit(conv_id)) if conv_id else turns


def report(row: dict, show: bool, detections: bool) -> dict:
    """A result as a report, without text where it may not go out."""
    out = {k: v for k, v in row.items() if k not in ("turns", "conv_id", "risk") and (detections or k != "detections")}
    out["sanitized_turns"] = row["turns"]
    if not show:
        out |= {"sanitized_text": "", "sanitized_turns": [], "text_withheld": True}
    return out


def _run(spark: SparkSession, args: argparse.Namespace) -> int:
    engine = Engine(spark, settings(args), only=args.only)
    results = engine.deidentify(_turns(spark, args.input, args.format, args.doc_id))
    if args.input != "-" and os.path.isdir(args.input):
        # many conversations: their reports are written where they are made
        if not args.output:
            raise ValueError("a folder of transcripts needs an output folder")
        free = F.col("status").isin("passed", *(["review"] if args.allow_review else []))
        plain = results.withColumn("sanitized_text", F.when(free, F.col("sanitized_text"))).withColumn("turns", F.when(free, F.col("turns")))
        (plain if args.include_detections else plain.drop("detections")).write.json(args.output)
        worst = {r.status for r in spark.read.json(args.output).select("status").distinct().collect()}
        return BLOCKED if "blocked" in worst else REVIEW if "review" in worst else OK
    row = json.loads(results.toJSON().first() or "{}")
    if not row:
        row = {"status": "passed", "sanitized_text": "", "turns": [], "spans": [], "findings": [], "stats": {"n_spans": 0, "direct_spans": 0}}
    show = row["status"] == "passed" or row["status"] == "review" and args.allow_review
    if args.text_only:
        text = row["sanitized_text"] if show else ""
    elif args.turns:
        text = "\n".join(f"{t['speaker']}: {t['text']}" for t in row["turns"]) if show else ""
    else:
        text = json.dumps(report(row, show, args.include_detections), indent=2, ensure_ascii=False)
    if args.output:
        write_private(args.output, text)
    else:
        print(text)
    if not args.quiet:
        stats = row["stats"]
        top = list(stats.get("spans_by_entity", {}).items())[:12]
        print(f"status {row['status']}, {stats['n_spans']} spans ({stats['direct_spans']} direct): {', '.join(f'{k}={v}' for k, v in top)}", file=sys.stderr)
        for f in row["findings"]:
            print(f"  [{f['severity']}] {f['check']}: {f['message']}", file=sys.stderr)
    return {"blocked": BLOCKED, "review": REVIEW}.get(row["status"], OK)


def _detectors(spark: SparkSession, args: argparse.Namespace) -> int:
    config = settings(args)
    for spec in config.raw["detectors"]:
        if args.all or spec.get("enabled", True):
            ready = spec["type"] in BUILT_IN or spec["type"] in REGISTRY
            print(f"{spec['name']:<14} {spec['type']:<13} {'ready' if ready else 'offline'}")
    return OK


def _eval(spark: SparkSession, args: argparse.Namespace) -> int:
    scores = {name: [r.asDict(True) for r in df.collect()] for name, df in evaluation.run(spark, args.gold, settings(args)).items()}
    text = json.dumps(scores, indent=2)
    if args.output:
        write_private(args.output, text)
    else:
        print(text)
    rate = scores["leakage"][0]["conversation_leakage"] or 0.0
    print(f"conversation leakage rate {rate:.4f}", file=sys.stderr)
    return BLOCKED if args.max_leakage is not None and rate > args.max_leakage else OK


def _offsets(spark: SparkSession, args: argparse.Namespace) -> int:
    turns = [r.asDict() for r in _turns(spark, args.input, "auto", None).orderBy("turn_idx").select("conv_id", "speaker", "char_start", "char_end", "text").collect()]
    print(json.dumps({"text": "\n".join(t["text"] for t in turns), "turns": [{k: v for k, v in t.items() if k != "conv_id"} for t in turns]}, indent=2, ensure_ascii=False))
    return OK


def _audio_plan(spark: SparkSession | None, args: argparse.Namespace) -> int:
    intervals = read_settings(args.result).get("audio_plan") or []
    if not intervals:
        print("no audio plan: the transcript had no word timings", file=sys.stderr)
        return ERROR
    print(ffmpeg_command(args.input, args.output, intervals, args.mode))
    return OK


def _selftest(spark: SparkSession, args: argparse.Namespace) -> int:
    from .selftest import run_selftest

    return 1 if run_selftest(spark, show=(lambda line: None) if args.quiet else print) else OK


def _rate(value: str) -> float:
    rate = float(value)
    if not 0 <= rate <= 1:
        raise argparse.ArgumentTypeError("a rate lies between zero and one")
    return rate


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanveil", description="De-identifies conversation transcripts")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, common: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        if common:
            c.add_argument("-c", "--config")
            c.add_argument("-k", "--known")
            c.add_argument("--set", action="append", metavar="KEY=VALUE")
            c.add_argument("--enable", action="append")
            c.add_argument("--disable", action="append")
        return c

    c = command("run", _run)
    c.add_argument("input", help="a transcript, a folder of them, or - for standard input")
    c.add_argument("-o", "--output")
    c.add_argument("-f", "--format", default="auto", choices=FORMATS)
    c.add_argument("--doc-id")
    c.add_argument("--only", action="append")
    for flag in ("--text-only", "--allow-review", "--turns", "--include-detections", "--no-qa"):
        c.add_argument(flag, action="store_true")
    c.add_argument("--scope", choices=["per_turn", "per_conversation"])
    c.add_argument("--style", choices=["placeholder", "surrogate", "hmac"])
    c.add_argument("-q", "--quiet", action="store_true")
    command("detectors", _detectors).add_argument("--all", action="store_true")
    c = command("eval", _eval)
    c.add_argument("gold")
    c.add_argument("-o", "--output")
    c.add_argument("--max-leakage", type=_rate)
    command("offsets", _offsets, False).add_argument("input")
    c = command("audio-plan", _audio_plan, False)
    c.add_argument("result")
    c.add_argument("--input", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--mode", default="mute", choices=["mute", "beep"])
    command("selftest", _selftest, False).add_argument("-q", "--quiet", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The exit code; errors are named by their kind alone, so that no text gets out."""
    args = parser().parse_args(argv)
    try:
        needs = args.run not in (_audio_plan, _detectors)
        return args.run((spark or SparkSession.builder.getOrCreate()) if needs else None, args)
    except Exception as e:
        print(f"error: {type(e).__name__}; check input, settings and detectors", file=sys.stderr)
        return ERROR
