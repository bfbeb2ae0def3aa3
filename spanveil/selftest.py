"""Built-in end-to-end checks: transcripts, what must not survive in them, and what must appear."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.engine import Engine
from .plans.policy import Config

#: name, transcript, known values (entity: value), must not appear, must appear
CASES = [
    ("direct identifiers", "CHILD: I'm Leila and Mum collects me from Ashgrove School.\nPARENT: Ring me on 07700 900123 or write to leila.mum@example.org.", {"CHILD_NAME": "Leila", "SCHOOL_NAME": "Ashgrove School"}, ["Leila", "Ashgrove", "07700", "900123", "leila.mum@example.org"], ["<CHILD_01>", "<SCHOOL_01>"]),
    ("misheard known names", "PARENT: Lyla goes to Ash grove School, her teacher is Miss Doorothy.\nCHILD: my name is leela karrim.", {"CHILD_NAME": "Leila Karim", "SCHOOL_NAME": "Ashgrove School", "TEACHER_NAME": "Ms Dorothy"}, ["Lyla", "Doorothy", "leela", "karrim"], []),
    ("spoken identifiers", "PARENT: my number is oh seven seven double oh nine oh oh one two three, and my address is leila dot mum at example dot org.", {}, ["oh seven seven double", "at example dot org"], []),
    ("combination of details", "CHILD: I'm eight and I'm the only drummer in the under-9 Hawks band.\nPARENT: Mum runs the pharmacy behind Larkhill Primary.", {}, ["eight", "Larkhill"], ["<AGE_6_8>"]),
    ("roles and pseudonyms", "CHILD: my teacher is Ms Orla and my sister Nadia is in year 3.\nPARENT: Nadia joined the same school as Leila.", {"CHILD_NAME": "Leila"}, ["Nadia", "Orla", "Leila"], ["<SIBLING_01>", "<TEACHER_01>", "<CHILD_01>"]),
    ("structured identifiers", "PARENT: pupil number 5518-7, NHS number 943 476 5919, we live at 14 Elm Road, EC1A 1BB. The DOB is 03/11/2015.", {}, ["5518-7", "943 476 5919", "14 Elm Road", "EC1A 1BB", "03/11/2015"], []),
]


def run_selftest(spark: SparkSession, config: Config | None = None, show=print) -> int:
    """The number of cases that fail; all run as one job."""
    raw = spark.createDataFrame([(name, text) for name, text, *_ in CASES], "conv_id string, value string")
    known = spark.createDataFrame([(name, e, v) for name, _, values, *_ in CASES for e, v in values.items()], "conv_id string, entity string, value string")
    from .sources import loaders

    done = Engine(spark, config).deidentify(loaders.load_texts(raw, "text"), known)
    got = {r.conv_id: r for r in done.select("conv_id", "status", "sanitized_text", F.size("spans").alias("n")).collect()}
    failed = 0
    for name, _, _, absent, present in CASES:
        text = got[name].sanitized_text
        problems = [f"LEAK {x!r}" for x in absent if x.lower() in text.lower()] + [f"MISSING {x!r}" for x in present if x not in text]
        failed += bool(problems)
        show(f"[{'FAIL' if problems else 'ok'}] {name}: {got[name].status}, {got[name].n} spans {'; '.join(problems)}")
    show(f"{len(CASES) - failed}/{len(CASES)} cases passed")
    return failed
