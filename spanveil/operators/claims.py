"""What a detector claims, and the same as a row."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(slots=True)
class Claim:
    """That ``text[start:end]`` is ``entity``; ``value`` is the known value that it is, ``partial`` tells of a part of one."""

    start: int
    end: int
    entity: str
    score: float
    detector: str
    label: str
    channel: str | None = None
    value: str | None = None
    partial: bool = False


CLAIM = "struct<detector: string, raw_label: string, entity: string, start: int, end: int, score: double, channel: string, known: boolean, partial: boolean>"
DETECTION = "conv_id string, detector string, raw_label string, entity string, start int, end int, score double, channel string, surface string"
