"""Invented labelled conversations, written and as speech recognition would spell them, for tests and benchmarks."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Slots: entity, and surfaces as written and as recognised.
SLOTS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "child": ("CHILD_NAME", [("Nerys Vaughan", "nerris vaughn"), ("Idris Pell", "idriss pel"), ("Oona Marsh", "una marsh"), ("Tamsin Rowe", "tamzin row")]),
    "parent": ("PARENT_NAME", [("Gwen", "gwenn"), ("Bryn", "brin"), ("Delyth", "delith"), ("Marek", "marrek")]),
    "teacher": ("TEACHER_NAME", [("Ms Corbett", "miss corbit"), ("Mr Adeyemi", "mister adayemi"), ("Mrs Lund", "misses lund")]),
    "school": ("SCHOOL_NAME", [("Larkhill Primary School", "lark hill primary school"), ("Elmbridge Academy", "elm bridge academy"), ("Saint Cadoc College", "saint cadock college")]),
    "phone": ("PHONE", [("07700 900123", "oh seven seven double oh nine oh oh one two three"), ("020 7946 0958", "oh two oh seven nine four six oh nine five eight")]),
    "email": ("EMAIL", [("gwen.v@example.org", "gwen dot v at example dot org"), ("bryn_p@example.com", "bryn underscore p at example dot com")]),
    "address": ("STREET_ADDRESS", [("14 Elm Road", "fourteen elm road"), ("32 Quarry Lane", "thirty two quarry lane")]),
    "postcode": ("POSTCODE", [("EC1A 1BB", "e c one a one b b"), ("NW3 4RD", "n w three four r d")]),
    "born": ("DATE_OF_BIRTH", [("09/06/2014", "the ninth of june twenty fourteen"), ("3 May 2015", "the third of may twenty fifteen")]),
    "age": ("EXACT_AGE", [("9", "nine"), ("7", "seven")]),
    "pupil": ("STUDENT_ID", [("5518-7", "five five one eight seven"), ("HK-2041", "h k two oh four one")]),
    "club": ("CLUB_NAME", [("lakeside chess club", "lakeside chess club"), ("riverside judo club", "river side judo club")]),
}
#: Scenarios: lines of a speaker, with slots in braces.
SCENARIOS = [
    ["PARENT: My daughter {child} starts at {school} on Monday.", "CLINICIAN: And who is her teacher?", "PARENT: It will be {teacher}.", "CHILD: I'm {age} and I want to go."],
    ["CLINICIAN: Which number can we ring?", "PARENT: You can reach me on {phone}.", "CLINICIAN: And in writing?", "PARENT: Write to {email}, please."],
    ["PARENT: We live at {address}.", "CLINICIAN: What is the postcode?", "PARENT: It is {postcode}.", "CHILD: {parent} says the garden is small."],
    ["CLINICIAN: What is the date of birth?", "PARENT: The date of birth is {born}.", "PARENT: The pupil number is {pupil}.", "CHILD: My name is {child}."],
    ["CHILD: I go training at {club}.", "PARENT: {child} loves it there.", "CLINICIAN: How old is she now?", "PARENT: She is {age} years old."],
    ["CHILD: {teacher} told {child} to sit down.", "PARENT: That was at {school}.", "CLINICIAN: Did {parent} hear of it?", "PARENT: Call me on {phone} about it."],
]
#: Lines without anything that identifies.
PLAIN = ["CLINICIAN: How did that make you feel?", "CHILD: I was cross and then I was fine.", "PARENT: We had a quiet evening.", "CHILD: The soup was too hot.", "PARENT: It rained for most of the walk.", "CLINICIAN: Let us talk about sleep.", "CHILD: I like drawing more than sums."]
KNOWN = ("child", "parent", "school")


def conversation(number: int, spoken: bool = False, negative: bool = False, seed: int = 1) -> dict:
    """A labelled conversation: turns, spans in the flat text, known values; the written and the spoken one of a number are twins."""
    rng = random.Random(f"{seed}-{number}-{negative}")
    lines = rng.sample(PLAIN, 5) if negative else [*SCENARIOS[number % len(SCENARIOS)], *rng.sample(PLAIN, 2)]
    chosen = {name: rng.choice(surfaces) for name, (_, surfaces) in SLOTS.items()}
    turns, spans, at = [], [], 0
    for line in lines:
        speaker, text = line.split(": ", 1)
        parts, size = [], 0
        for k, piece in enumerate(text.replace("}", "{").split("{")):
            if k % 2:
                surface = chosen[piece][spoken]
                spans.append({"start": at + size, "end": at + size + len(surface), "entity": SLOTS[piece][0]})
            else:
                surface = piece.lower() if spoken else piece
            parts.append(surface)
            size += len(surface)
        turns.append({"speaker": speaker, "text": "".join(parts)})
        at += size + 1
    known = {} if negative else {SLOTS[name][0]: [chosen[name][0]] for name in KNOWN}
    return {"turns": turns, "spans": spans, "known_values": known}


def conversations(spark: SparkSession, n: int, spoken: bool = False, negative: bool = False, seed: int = 1) -> DataFrame:
    """``n`` of them as JSON lines (value), made where they are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(conversation(k, spoken, negative, seed), ensure_ascii=False) for k in b.column(0).to_pylist()], pa.string())], ["value"])

    return spark.range(n).mapInArrow(run, "value string")
