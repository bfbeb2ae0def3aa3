"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +-1.  A trigram binds its letters: the
product of their vectors, the first permuted twice and the second once.  A
text's vector bundles (adds) its trigrams'; a language's prototype bundles the
unit vectors of its training texts.  Texts go to the prototype of the largest
cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, utf8
from .quality import held_out

DIMENSIONS = 1024
#: Distinct trigrams whose vectors are in memory at once.
BLOCK = 4096
#: Texts whose trigrams are counted in one table, of so many rows and ``BLOCK`` columns.
TEXTS = 1024
UNKNOWN = "und"
_SPACE = 32


def letter_vector(code: int) -> np.ndarray:
    """The fixed random vector of a code point."""
    return np.random.Generator(np.random.PCG64(code + 101)).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


class Letters:
    """Letter vectors, each in its three permutations, made when first asked for."""

    def __init__(self):
        self.at: dict[int, int] = {}
        self.turned = [np.zeros((256, DIMENSIONS), np.int8) for _ in range(3)]

    def rows(self, codes: np.ndarray) -> np.ndarray:
        for code in codes.tolist():
            if code not in self.at:
                k = self.at[code] = len(self.at)
                if k == len(self.turned[0]):
                    self.turned = [np.concatenate([t, np.zeros_like(t)]) for t in self.turned]
                for turn in range(3):
                    self.turned[turn][k] = np.roll(letter_vector(code), turn)
        return np.array([self.at[c] for c in codes.tolist()], np.int64)

    def trigrams(self, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
        n = len(rows)
        a, b, c = rows[keys // (n * n)], rows[keys // n % n], rows[keys % n]
        return (self.turned[2][a] * self.turned[1][b] * self.turned[0][c]).astype(np.float32)


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, text, trigram, count, has a letter): runs of other characters are one space, also at either end."""
    raw = [(" " + t.lower() + " ").encode("utf-32-le", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) // 4 for r in raw])
    code = np.frombuffer(b"".join(raw), np.uint32)
    seen = np.flatnonzero(np.bincount(code))
    letter = np.array([chr(c).isalpha() for c in seen.tolist()], bool)
    is_letter = np.zeros(int(seen[-1]) + 1, bool)
    is_letter[seen[letter]] = True
    alpha = is_letter[code]
    first = np.zeros(len(code), bool)
    first[np.concatenate([[0], ends[:-1]])] = True
    keep = alpha | first
    keep[1:] |= alpha[:-1]
    text = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[keep]
    codes = np.concatenate([[_SPACE], seen[letter]])
    place = np.zeros(int(seen[-1]) + 1, np.int64)
    place[seen[letter]] = np.arange(1, len(codes))
    small = np.where(alpha, place[code], 0)[keep]
    n = len(codes)
    key = (small[:-2] * n + small[1:-1]) * n + small[2:]
    full = (text[2:] == text[:-2]) & (small[1:-1] + small[:-2] + small[2:] > 0)
    key, count = np.unique(text[2:][full] * n**3 + key[full], return_counts=True)
    return codes, key // n**3, key % n**3, count, np.bincount(text, small > 0, len(texts)) > 0


def bundle(letters: Letters, codes: np.ndarray, row: np.ndarray, trigram: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Sums of weighted trigram vectors in n rows."""
    out, rows = np.zeros((n, DIMENSIONS), np.float32), letters.rows(codes)
    distinct, column = np.unique(trigram, return_inverse=True)
    order = np.argsort(column, kind="stable")
    cuts = np.searchsorted(column[order], np.arange(0, len(distinct) + BLOCK, BLOCK))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        own, some = order[lo:hi], distinct[k * BLOCK : (k + 1) * BLOCK]
        table = np.zeros((n, len(some)), np.float32)
        np.add.at(table, (row[own], column[own] - k * BLOCK), weight[own])
        out += table @ letters.trigrams(rows, some)
    return out


def _parts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    for first, past, _, _ in chunks(*utf8(column), 1 << 20):
        for lo in range(first, past, TEXTS):
            hi = min(lo + TEXTS, past)
            yield lo, hi, [t or "" for t in column[lo:hi].to_pylist()]


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters, sums = Letters(), {}
    for b in batches:
        for lo, hi, texts in _parts(b.column(0)):
            langs, lang = np.unique(b.column(1)[lo:hi].to_pylist(), return_inverse=True)
            codes, text, trigram, count, _ = trigram_counts(texts)
            length = np.sqrt(np.bincount(text, count.astype(float) ** 2, len(texts)))
            pair, at = np.unique(lang[text] * len(codes) ** 3 + trigram, return_inverse=True)
            weight = np.bincount(at, count / length[text])
            found = bundle(letters, codes, pair // len(codes) ** 3, pair % len(codes) ** 3, weight, len(langs))
            for name, vector in zip(langs.tolist(), found.astype(float), strict=True):
                sums[name] = sums[name] + vector if name in sums else vector
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "vector"])


def _add(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(v, float) for v in table.column("vector").to_pylist()], 0)
    return pa.table({"lang": table.column("lang")[:1], "vector": pa.array([total.tobytes()], pa.binary())})


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, in order, and their prototypes, bundled from all training rows of ``docs`` (doc_id, text, lang)."""
    own = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held_out(F.col("doc_id")).alias("held_out"))
    sums = own.where("not held_out and lang is not null and text is not null").select("text", "lang").mapInArrow(_train, "lang string, vector binary")
    # a few bounded vectors a task: first summed in groups of tasks, then by language
    sums = sums.withColumn("part", F.spark_partition_id() % 64).groupBy("lang", "part").applyInArrow(_add, "lang string, vector binary")
    rows = sorted(sums.groupBy("lang").applyInArrow(_add, "lang string, vector binary").collect())
    return [r.lang for r in rows], np.array([np.frombuffer(r.vector, float) for r in rows], np.float32).reshape(len(rows), DIMENSIONS)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        letters, unit = Letters(), table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
        for b in batches:
            names, scores = [], []
            for lo, hi, texts in _parts(b.column(2)):
                codes, text, trigram, count, known = trigram_counts(texts)
                if not langs:
                    names += [UNKNOWN] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    continue
                vectors = bundle(letters, codes, text, trigram, count, hi - lo)
                cosine = vectors @ unit.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                best = cosine.argmax(1)
                names += [langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
                scores += np.where(known, np.clip(cosine[np.arange(hi - lo), best], 0, 1), 0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Prototypes come from the rows outside the held-out fold whose lang and text
    are not null.  A text that is null or has no letter is ``und`` with score 0,
    and so is every text where nothing was learned.  The score is the cosine,
    at least 0; ties go to the first language in order.  A null doc_id is not
    held out; repeated rows count and are returned singly; an empty table gives
    an empty result; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(prototypes(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
