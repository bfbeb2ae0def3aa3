"""Information-theoretic sanitisation of personal data.

Base spans are e-mail addresses, IP addresses, card and phone numbers found by
fixed patterns.  Each distinct value is a protected entity.  How strongly a
term of an entity's texts reveals it is estimated from the corpus: with n(t, e)
the texts that hold both and n(t) those that hold the term, a term discloses the
share of the entity's information I(t; e) / I(e) = 1 - log p(e|t) / log p(e).
Terms at or over the disclosure threshold are spans too, wherever they stand in
a text with that entity, and are generalised or removed with it.  No least number
of texts is asked: a term that stands in the one text of an entity and nowhere
else discloses it whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release

#: Share of the entity's information from which a term discloses it.
DISCLOSURE = 0.9
TERM = re.compile(r"[^\W\d_]{3,}")
KINDS = ("email", "ip", "card", "phone")
GENERAL = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>"}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From sign to sign: the local part is the run before it, so long runs without one cost nothing."""
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN(text, at) if start < at else None
        if m:
            yield start, m.end()
            past = m.end()
        else:
            past = max(past, at + 1)
        at = text.find("@", past)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(part: str) -> bool:
    """Whether digits, however many zeros lead them, say at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base spans, in order."""
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _entity(kind: int, surface: str) -> str:
    return f"{KINDS[kind]}:{surface.lower() if kind == 0 else surface if kind == 1 else _digits(surface)}"


def held_terms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of a text's terms in order; start is -1 for one that touches a base span."""
    k, past = 0, -1  # the furthest end of the base spans that start before the term ends
    for m in TERM.finditer(text):
        a, b = m.span()
        while k < len(spans) and spans[k][0] < b:
            past = max(past, spans[k][2])
            k += 1
        yield (m[0].lower(), -1 if a < past else a, b)


_TERMS = "array<struct<term: string, start: int, end: int>>"
_FOUND = f"doc_id long, spans array<struct<start: int, kind: int, end: int>>, entities array<string>, terms {_TERMS}"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    terms_type = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        spans, entities, terms = [], [], []
        for text in b.column(1):
            text = text.as_py() or ""
            own = base_spans(text)
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
            entities.append(sorted({_entity(k, text[s:e]) for s, k, e in own}))
            terms.append([{"term": t, "start": a, "end": z} for t, a, z in held_terms(text, own)] if own else [])
        more = {"text_sha256": b.column(2)} if b.num_columns > 2 else {}
        own = {"doc_id": b.column(0), "spans": pa.array(spans, spans_type), "entities": pa.array(entities, pa.list_(pa.string())), "terms": pa.array(terms, terms_type)}
        yield pa.RecordBatch.from_pydict(own | more)


#: Distinct terms that a task counts before it hands their counts on.
COUNT_TERMS = 1 << 18


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, texts that hold it), summed in each task; rows grow as the texts do."""
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n_texts"])

    for b in batches:
        for text in b.column(0):
            counts.update({t.lower() for t in set(TERM.findall(text.as_py() or ""))})
            if len(counts) > COUNT_TERMS:
                yield out()
                counts.clear()
    yield out()
    counts.clear()
    release()


def disclosing_terms(docs: DataFrame, entities: DataFrame, terms: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(row, term) of the terms of a row that disclose an entity of that row over the whole corpus.

    ``entities`` (row, entity) and ``terms`` (row, term) have each entity of a
    row, and each term of the rows with entities, once.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = texts.mapInArrow(_count_texts, "term string, n_texts long").groupBy("term").agg(F.sum("n_texts").alias("n_texts"))
    total = docs.count()
    alone = F.least(F.lit(0.5), F.col("n_entity") / F.lit(float(max(total, 2))))
    # p(e|t) is at most n(e) / n(t), so terms of many more texts than any entity of the row has disclose none
    told = lambda both: 1 - F.log(F.least(F.lit(1.0), both / F.col("n_texts"))) / F.log(alone) >= disclosure - 1e-12
    named = materialise(entities.join(entities.groupBy("entity").agg(F.count("*").alias("n_entity")), "entity"), "entities")
    pairs = terms.join(counts, "term").join(named, "row").where(told(F.col("n_entity")))
    pairs = materialise(pairs.select("row", "entity", "term", "n_entity", "n_texts"), "pairs")
    known = pairs.groupBy("entity", "term", "n_entity", "n_texts").agg(F.count("*").alias("n_both")).where(told(F.col("n_both")))
    return pairs.join(known.select("entity", "term"), ["entity", "term"], "left_semi").select("row", "term").distinct()


def _text_key() -> Column:
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)


def personal_spans(docs: DataFrame, disclosure: float = DISCLOSURE, keyed: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base, spans.

    ``base`` and ``spans`` are strings of kind:start:end in code points, comma-joined
    by start and then kind (email, ip, card, phone, term); ``spans`` adds the
    terms that disclose an entity of their text.  A null or empty text has no
    spans.  Rows with a null or repeated doc_id are kept and judged singly.  An
    empty table gives an empty result; other columns are ignored.  ``keyed`` adds
    text_sha256, of which equal texts have one and the same spans.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if keyed:
        rows = rows.withColumn("text_sha256", _text_key())
    key, kind = (["text_sha256"], ", text_sha256 string") if keyed else ([], "")
    found = materialise(rows.mapInArrow(_find, _FOUND + kind).withColumn("row", F.monotonically_increasing_id()), "spans")
    some = found.where("size(spans) > 0")
    placed = some.select("row", F.inline("terms"))
    told = disclosing_terms(rows, some.select("row", F.explode("entities").alias("entity")), placed.select("row", "term").distinct(), disclosure)
    terms = placed.where("start >= 0").join(told, ["row", "term"], "left_semi").select("row", F.struct("start", F.lit(len(KINDS)).alias("kind"), "end").alias("span"))
    terms = terms.groupBy("row").agg(F.collect_list("span").alias("terms"))
    # only rows with spans can have terms, so the others need no join
    plain = found.where("size(spans) = 0").select("doc_id", *key, "spans", F.expr("cast(null as array<struct<start: int, kind: int, end: int>>)").alias("terms"))
    some = some.drop("terms").join(terms, "row", "left").select("doc_id", *key, "spans", "terms")
    out = plain.unionByName(some)
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    every = F.concat("spans", F.coalesce("terms", F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")))
    return out.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], joined(F.col("spans")).alias("base"), joined(every).alias("spans"), *key)


def sanitise(docs: DataFrame, remove_terms: bool = False, **limits) -> DataFrame:
    """``docs`` with its own columns and ``sanitised``: each span replaced by its class; with ``remove_terms``, disclosing terms dropped.

    Spans belong to a text, whatever its doc_id, which may be null or repeat; the
    doc_id takes no part.  A null text becomes an empty one, and a column named
    ``sanitised`` is replaced.
    """
    general = {**GENERAL, "term": "" if remove_terms else GENERAL["term"]}
    spans = personal_spans(docs, keyed=True, **limits).where("spans <> ''")
    spans = spans.groupBy(F.col("text_sha256").alias("__text_key")).agg(F.max("spans").alias("__span_list"))

    @F.arrow_udf("string")
    def rewrite(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
            text, at = text or "", None
            for kind, start, end in reversed([x.split(":") for x in own.split(",")] if own else []):
                if at is None or int(end) <= at:  # of spans that overlap, the last to start is replaced
                    text, at = text[: int(start)] + general[kind] + text[int(end) :], int(start)
            out.append(text)
        return pa.array(out, pa.string())

    joined = docs.withColumn("__text_key", _text_key()).join(spans, "__text_key", "left")
    return joined.withColumn("sanitised", rewrite(F.col("text").cast("string"), F.col("__span_list"))).drop("__text_key", "__span_list")
