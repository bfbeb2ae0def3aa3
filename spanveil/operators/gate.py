"""The release gate: checks of a sanitised conversation, fail-closed."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

from ..functions.lexicon import STOP_CAPS
from ..functions.plain import normalize
from ..plans.policy import Config
from .audio import has_timings
from .claims import Claim
from .resolve import Span

PLACEHOLDER = re.compile(r"<[A-Z][A-Z0-9_]{1,96}>")
_DIGITS = re.compile(r"\d[\d\s.-]{3,}\d")
_CAPITAL = re.compile(r"\b[A-Z][a-z]{2,}\b")
_ENGLISH = ("en", "eng", "en-US", "en-GB")


def finding(check: str, severity: str, message: str, **detail) -> dict:
    """A finding; its details are counts, places and labels, never text."""
    return {"check": check, "severity": severity, "message": message, "detail": [(k, str(v)) for k, v in detail.items()]}


def masked(text: str) -> str:
    """Placeholders blanked by as many spaces, so offsets hold."""
    return PLACEHOLDER.sub(lambda m: " " * len(m[0]), text)


def _foreign(text: str) -> bool:
    return not text.isascii() and any(c.isalpha() and ord(c) > 127 and "LATIN" not in unicodedata.name(c, "") for c in set(text))


def source_checks(text: str, language: str, config: Config) -> list[dict]:
    out = []
    if not config.get("qa.rescan", True):
        out.append(finding("rescan_disabled", "warn", "the output is not scanned again"))
    if not config.get("runtime.strict_detectors", True):
        out.append(finding("detector_failures_allowed", "warn", "detectors may fail in this configuration"))
    if PLACEHOLDER.search(text):
        out.append(finding("input_placeholder_review", "warn", "the input holds what looks like a placeholder"))
    if language not in _ENGLISH or _foreign(text):
        out.append(finding("language_review", "warn", "the language or script needs review"))
    letters = [c for c in text if c.isalpha()]
    if len(letters) >= 40 and not any(c.isupper() for c in letters):
        out.append(finding("uncased_transcript_review", "warn", "a long text without capitals can hide names"))
    return out


def residual_checks(claims: list[Claim], sanitized: str, config: Config) -> list[dict]:
    """What detectors still claim in the output, outside placeholders and known values."""
    out, direct = [], 0
    safe = [m.span() for m in PLACEHOLDER.finditer(sanitized)]
    starts = [lo for lo, _ in safe]
    for c in claims:
        k = bisect_right(starts, c.start) - 1
        if c.value is not None or c.score < config.threshold(c.entity) or k >= 0 and c.end <= safe[k][1]:
            continue
        if config.policy(c.entity).tier == "direct":
            direct += 1
            severity = "fail" if direct > int(config.get("qa.max_residual_direct", 0)) else "warn"
            out.append(finding("direct_entity_residual", severity, f"possible {c.entity} remains", entity=c.entity, detector=c.detector, score=round(c.score, 3)))
        else:
            out.append(finding("quasi_residual", "warn", f"quasi-identifier {c.entity} remains", entity=c.entity, detector=c.detector, score=round(c.score, 3)))
    return out


def leak_checks(leaks: list[tuple[str, int, int]]) -> list[dict]:
    return [finding("known_value_leak", "fail", f"known {e} survived", entity=e, at=lo, end=hi) for e, lo, hi in leaks]


def output_checks(sanitized: str, config: Config) -> list[dict]:
    out, plain = [], masked(sanitized)
    for m in _DIGITS.finditer(plain):
        n = sum(map(str.isdecimal, m[0]))
        if n >= int(config.get("qa.digit_run_length", 6)):
            out.append(finding("digit_run_residual", "fail", f"a run of {n} digits survived", at=m.start(), end=m.end()))
    if config.get("qa.capitalized_token_audit", True):
        left = set()
        for m in _CAPITAL.finditer(plain):
            before = plain[max(0, m.start() - 200) : m.start()].rstrip() or plain[: m.start()].rstrip()
            if before and before[-1] not in ".!?\n" and normalize(m[0]) not in STOP_CAPS:
                left.add(m[0])
        if left:
            out.append(finding("capitalized_token_audit", "warn", f"{len(left)} capitalised words remain"))
    return out


def span_checks(turns: list[dict], text: str, spans: list[Span], config: Config) -> list[dict]:
    """Spans without replacement, and the confidence and timing of the words under them."""
    out = []
    bad = [s for s in spans if s.action != "keep" and not s.replacement]
    if bad:
        out.append(finding("unreplaced_span", "fail", f"{len(bad)} spans have no replacement", entities=",".join(sorted({s.entity for s in bad}))))
    words = [w for t in turns for w in t.get("words") or ()]
    if not words:
        return out
    under = bytearray(len(text))
    for s in spans:
        under[s.start : s.end] = b"\1" * (s.end - s.start)
    sure = [w["conf"] for w in words if w["conf"] is not None and w["char_start"] >= 0 and any(under[w["char_start"] : w["char_end"]])]
    least = float(config.get("qa.min_asr_confidence", 0.5))
    low = sum(c < least for c in sure)
    if low:
        out.append(finding("low_asr_confidence", "warn", f"{low} of {len(sure)} words under spans are below confidence {least:.2f}", low=low, total=len(sure), mean=round(sum(sure) / len(sure), 3)))
    if config.get("audio.enabled", True) and has_timings(turns):
        timed = [w for w in words if w["start"] is not None and w["end"] is not None and w["end"] > w["start"] and w["char_start"] >= 0]
        heard = bytearray(len(text))
        for w in timed:
            heard[w["char_start"] : w["char_end"]] = b"\1" * (w["char_end"] - w["char_start"])
        silent = sum(any(not heard[i] and not text[i].isspace() for i in range(s.start, s.end)) for s in spans if s.action != "keep")
        if silent:
            out.append(finding("audio_alignment_review", "warn", f"{silent} spans are not wholly covered by timed words"))
    return out


def risk_checks(report: dict) -> list[dict]:
    risk = report["risk_score"]
    if risk < 1:
        return []
    return [finding("quasi_combination_risk", "warn" if risk < 3 else "fail", f"risk of combinations {risk:.2f}", risk_score=round(risk, 3))]


def settle(findings: list[dict], config: Config) -> tuple[list[dict], str]:
    """Findings with the severities that the settings give them, and the status: blocked, review or passed."""
    block, warn = set(config.get("qa.block_on") or ()), set(config.get("qa.warn_on") or ())
    for f in findings:
        if f["severity"] == "fail" and (f["check"] in warn or block and f["check"] not in block):
            f["severity"] = "warn"
    levels = {f["severity"] for f in findings}
    if "fail" in levels:
        return findings, "blocked" if config.get("qa.fail_closed", True) else "review"
    return findings, "review" if "warn" in levels else "passed"
