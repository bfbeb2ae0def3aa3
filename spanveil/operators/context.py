"""Context detector: names and places told by the words around them, without any model."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.lexicon import FIRST_NAMES, NAME_ENDS, PARTICLES, ROLE_ENTITY, STOP_CAPS, TITLE_ENTITY, VENUES, gazetteer
from ..functions.plain import is_capitalised, normalize
from .claims import Claim
from .rules import detections

WORD = re.compile(r"[^\W\d_][\w'’­​‌‍⁠﻿-]*")
_NAME = rf"(?!(?:{'|'.join(NAME_ENDS)})\b){WORD.pattern}"
NAMES = rf"(?P<name>{_NAME}(?:\s+{_NAME}){{0,2}})"
_LONGEST_FIRST = lambda words: "|".join(sorted(words, key=len, reverse=True))

#: The words that announce a name, a workplace, a place or what is unique.
ROLE_IS = re.compile(rf"\b(?:my|our|his|her|their|your|the)\s+(?P<role>{_LONGEST_FIRST(ROLE_ENTITY)})(?:'s\s+name\s+is|\s*,\s*|\s+is\s+called\s+|\s+is\s+|\s+named\s+|\s+){NAMES}", re.I)
TITLED = re.compile(rf"\b(?P<title>{_LONGEST_FIRST(TITLE_ENTITY)})\.?\s+{NAMES}", re.I)
INTRODUCED = re.compile(rf"\b(?:my\s+name\s+is|i'?m|i\s+am|this\s+is|that'?s|call\s+me|it'?s|here\s+with|joined\s+by|speaking\s+to)\s+{NAMES}", re.I)
OWN_INTRODUCTION = {"my", "i'm", "im", "i"}
CALLED = [(re.compile(rf"(?:^|[.!?]\s+)(?P<name>{WORD.pattern})\s*[,!](?=\s)"), "vocative"), (re.compile(rf",\s*(?P<name>{WORD.pattern})\s*[.!?]"), "vocative_tail")]
WORKPLACES = [
    (re.compile(r"\b(?:works?|working|worked|job|shift|office)\s+(?:at|for|in)\s+(?:the\s+)?((?:[\w'&-]+\s?){1,4})", re.I), 0.65),
    (re.compile(r"\b(?:owns?|owned|runs?|manages?)\s+(?:the\s+|a\s+|his\s+|her\s+|their\s+)?((?:[\w'&-]+\s?){1,4})", re.I), 0.55),
]
PLACES = re.compile(r"\b(in|from|near|around|opposite|next\s+to|behind|by)\s+(?-i:([A-Z][\w'-]+(?:\s+[A-Z][\w'-]+){0,2}))", re.I)
UNIQUE = re.compile(r"\b(?:the\s+only|one\s+of\s+the\s+only|the\s+first|the\s+youngest|the\s+oldest|the\s+best)\s+([^.,;!?\n]{4,60})", re.I)


@dataclass(frozen=True)
class Context:
    """Settings of the detector; ``first_names`` and ``stops`` are sets of normalised words."""

    first_names: frozenset[str] = FIRST_NAMES
    stops: frozenset[str] = STOP_CAPS
    cap_score: float = 0.3
    initial_score: float = 0.24
    sweep: bool = True
    use_names: bool = True
    detector: str = "context"

    @classmethod
    def of(cls, spec: dict) -> Context:
        """From a detector's settings; ``gazetteer_path`` names a file of first names that takes the place of the short list."""
        names = FIRST_NAMES
        if spec.get("gazetteer_path"):
            with open(spec["gazetteer_path"], encoding="utf-8") as f:
                names = gazetteer(f.read().splitlines())
        stops = STOP_CAPS | {normalize(w) for w in spec.get("stopwords") or ()}
        return cls(names, stops, float(spec.get("cap_score", 0.3)), float(spec.get("sentence_initial_score", 0.24)), bool(spec.get("cap_sweep", True)), bool(spec.get("gazetteer", True)), spec.get("name", "context"))

    # -- pieces -------------------------------------------------------

    def _stop(self, word: str) -> bool:
        return normalize(word) in self.stops

    def _core(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """The first run of words within bounds that are no stop words."""
        run = []
        for m in WORD.finditer(text, lo, hi):
            if not self._stop(m[0]):
                run.append(m)
            elif run:
                break
        return (run[0].start(), run[-1].end()) if run else None

    def _named(self, text: str, lo: int, hi: int, entity: str, score: float, label: str) -> Iterator[Claim]:
        core = self._core(text, lo, hi)
        if core and core[1] - core[0] >= 2:
            yield Claim(*core, entity, score, self.detector, label)

    def _announced(self, text: str, role_at) -> Iterator[Claim]:
        for m in ROLE_IS.finditer(text):
            if not self._stop(m["name"]):
                yield from self._named(text, *m.span("name"), ROLE_ENTITY[normalize(m["role"])], 0.75, "role_is")
        for m in TITLED.finditer(text):
            if not self._stop(m["name"].split()[0]):
                yield from self._named(text, *m.span(), TITLE_ENTITY[normalize(m["title"])], 0.8, "title_name")
        for m in INTRODUCED.finditer(text):
            first = normalize(m["name"].split()[0])
            if first in self.stops and first not in self.first_names:
                continue
            role = role_at(m.start("name")) if normalize(m[0].split()[0]) in OWN_INTRODUCTION else None
            entity = {"child": "CHILD_NAME", "parent": "PARENT_NAME"}.get(role, "PERSON_NAME")
            strong = m["name"][0].isupper() or first in self.first_names
            yield from self._named(text, *m.span("name"), entity, 0.8 if strong else 0.55, "introduction")
        for rx, label in CALLED:
            for m in rx.finditer(text):
                known = normalize(m["name"]) in self.first_names
                if not self._stop(m["name"]) and (known or m["name"][0].isupper()):
                    yield from self._named(text, *m.span("name"), "PERSON_NAME", 0.5, label)

    def _places(self, text: str) -> Iterator[Claim]:
        for rx, score in WORKPLACES:
            for m in rx.finditer(text):
                core = self._core(text, *m.span(1))
                words = [normalize(w) for w in WORD.findall(m[1])]
                if not core or len(normalize(text[slice(*core)])) < 3 or words[0] in PARTICLES:
                    continue
                if VENUES.intersection(words) or any(map(is_capitalised, WORD.findall(text[slice(*core)]))):
                    yield Claim(*core, "PARENT_WORKPLACE", score, self.detector, "workplace")
        for m in PLACES.finditer(text):
            if not self._stop(m[2].split()[0]):
                entity = "NEIGHBORHOOD" if m[1].lower() in ("in", "from") else "LOCAL_LANDMARK"
                yield Claim(*m.span(2), entity, 0.45, self.detector, "place_trigger")
        for m in UNIQUE.finditer(text):
            yield Claim(*m.span(), "UNIQUE_EVENT", 0.5, self.detector, "uniqueness_phrase")

    def _capitals(self, text: str, words: list[re.Match]) -> Iterator[Claim]:
        """Runs of up to three capitalised words; one that opens a sentence says little."""
        common = {m[0] for m in words if m[0].islower()}
        run: list[re.Match] = []
        for m in [*words, None]:
            if run and not (m and len(run) < 3 and is_capitalised(m[0]) and text[run[-1].end() : m.start()].strip() in ("", "-")):
                yield from self._run(text, run, common)
                run = []
            if m and is_capitalised(m[0]):
                run.append(m)

    def _run(self, text: str, run: list[re.Match], common: set[str]) -> Iterator[Claim]:
        core = self._core(text, run[0].start(), run[-1].end())
        if not core:
            return
        own = text[slice(*core)].split()
        score = 0.5 if normalize(own[0]) in self.first_names else 0.38 if len(own) > 1 else self.cap_score
        before = text[max(0, run[0].start() - 64) : run[0].start()].rstrip() or text[: run[0].start()].rstrip()
        if len(run) == 1 and (not before or before[-1] in ".!?\n"):
            known = normalize(run[0][0]) in self.first_names
            if not known and run[0][0].lower() in common:
                return
            score = 0.45 if known else self.initial_score
        yield Claim(*core, "PERSON_NAME", score, self.detector, "capitalised_span")

    # -- all ----------------------------------------------------------

    def claims(self, text: str, role_at=lambda at: None) -> list[Claim]:
        """Claims on a text; ``role_at`` tells the role of who speaks at a place."""
        words = list(WORD.finditer(text))
        out = [*self._announced(text, role_at), *self._places(text)]
        if self.use_names:
            for m in words:
                n = normalize(m[0])
                if len(n) >= 3 and n in self.first_names and n not in self.stops:
                    out.append(Claim(*m.span(), "PERSON_NAME", 0.45, self.detector, "gazetteer_first_name"))
        if self.sweep:
            out += self._capitals(text, words)
        return out


def detect_context(convs: DataFrame, spec: dict | None = None) -> DataFrame:
    """Detections of ``convs`` (conv_id, text) by context, without roles of speakers."""
    own = Context.of(spec or {})
    return detections(convs, own.claims)
