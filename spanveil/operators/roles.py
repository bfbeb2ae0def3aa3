"""Speaker roles: overrides, labels, known names, cue words, and the other of two speakers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import CUES, LABEL_ROLE
from ..functions.plain import fuzzy, normalize
from .known import Index

ROLES = ("child", "parent", "clinician", "teacher", "sibling", "unknown")
#: Entities of known names and the role of who bears one, and the least score of cues.
KNOWN_ROLE = {"CHILD_NAME": "child", "PARENT_NAME": "parent", "SIBLING_NAME": "sibling", "TEACHER_NAME": "teacher", "DOCTOR_NAME": "clinician", "THERAPIST_NAME": "clinician"}
LEAST_CUE, LABEL_LIKENESS = 2.0, 0.85
OTHER = {"child": "parent", "parent": "child"}

_CUES = {role: [(re.compile(rx), weight) for rx, weight in cues] for role, cues in CUES.items()}


def label_role(label: str) -> str | None:
    """The role that a speaker's label says, as a whole or by one of its words."""
    key = normalize(label).replace(".", "").strip()
    return next((LABEL_ROLE[p] for p in (key, *re.split(r"[\s_\-0-9]+", key)) if p in LABEL_ROLE), None)


class NameRoles:
    """Roles of known names, found by a lossless index."""

    def __init__(self, pairs: list[tuple[str, str]]):
        order = list(KNOWN_ROLE)
        self.by: dict[str, int] = {}
        for entity, value in pairs:
            if entity in KNOWN_ROLE and (n := normalize(value)):
                self.by[n] = min(order.index(entity), self.by.get(n, len(order)))
        self.index = Index(self.by, LABEL_LIKENESS, True)

    def role(self, label: str) -> str | None:
        met = [self.by[n] for n in self.index.near(normalize(label)) if fuzzy(label, n, LABEL_LIKENESS)]
        return list(KNOWN_ROLE.values())[min(met)] if met else None


class Named:
    """Roles of names that were looked up before."""

    def __init__(self, roles: dict[str, str]):
        self.roles = roles

    def role(self, label: str) -> str | None:
        return self.roles.get(label)


def cue_scores(text: str) -> dict[str, float]:
    return {role: sum(weight * sum(1 for _ in rx.finditer(text)) for rx, weight in cues) for role, cues in _CUES.items()}


def check_roles(overrides: dict[str, str]) -> dict[str, str]:
    if set(overrides.values()) - set(ROLES):
        raise ValueError("unsupported speaker role")
    return {normalize(k): v for k, v in overrides.items()}


def speaker_roles(turns: list[dict], overrides: dict[str, str] | None = None, names: list[NameRoles] = ()) -> dict[str, str]:
    """The role of each speaker of a conversation."""
    given, said = check_roles(overrides or {}), {}
    for t in turns:
        said.setdefault(t["speaker"], []).append(t["text"])
    roles = {}
    for speaker, texts in said.items():
        role = given.get(normalize(speaker))
        if role is None:
            role = label_role(speaker) or next((r for n in names if (r := n.role(speaker))), None)
        if role is None:
            scores = cue_scores(" ".join(texts))
            best = max(scores, key=scores.get)
            role = best if scores[best] >= LEAST_CUE else "unknown"
        roles[speaker] = role
    if len(roles) == 2:
        for a, b in (tuple(roles), tuple(roles)[::-1]):
            if roles[a] == "unknown" and roles[b] in OTHER:
                roles[a] = OTHER[roles[b]]
                break
    return roles


def assign_roles(turns: DataFrame, overrides: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """``turns`` with ``role``; ``overrides`` is (conv_id, speaker, role), ``known`` (entity, value) of all conversations.

    An override outside the roles stops the job.  Roles are decided on one row a
    conversation, of the texts its speakers said.
    """
    from .known import value_blocks

    own = F.struct("turn_idx", "speaker", "text")
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(own)).alias("turns"))
    if overrides is not None:
        given = overrides.groupBy("conv_id").agg(F.collect_list(F.struct("speaker", "role")).alias("given"))
        convs = convs.join(given, "conv_id", "left")
    else:
        convs = convs.withColumn("given", F.expr("cast(null as array<struct<speaker: string, role: string>>)"))
    blocks = [turns.sparkSession.sparkContext.broadcast([p for p in b if p[0] in KNOWN_ROLE]) for b in value_blocks(known.where(F.col("entity").isin(*KNOWN_ROLE)))] if known is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [NameRoles(b.value) for b in blocks]
        for batch in batches:
            out = []
            for conv_id, said, given in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                roles = speaker_roles(said, {g["speaker"]: g["role"] for g in given or ()}, names)
                out += [(conv_id, s, r) for s, r in roles.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else [(), (), ()])], ["conv_id", "speaker", "role"])

    return turns.join(convs.mapInArrow(run, "conv_id string, speaker string, role string"), ["conv_id", "speaker"])
