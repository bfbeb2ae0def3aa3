"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text's tokens are runs of letters and digits and runs of signs.  Tokens count
singly, in pairs and in triples, by their lower-cased bytes and by their shapes
(case, length class, signs), and a token that repeats its neighbour or the one
before counts as such.  The score is the logistic of a sparse dot product
of hashed counts, scaled to unit length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, chunks, mix, prefix_hash, range_hash, runs, utf8

BITS = 19
#: Labelled rows the fit takes at most, those of the smallest hashes of doc_id.
FIT_ROWS = 6000
FOLDS, HELD = 5, 0
#: Pairs and triples of words, most of which stand in one text only, count by this share.
GRAM_SCALE = 0.2
EPOCHS, ALPHA, BETA, L1, L2 = 5, 0.5, 1.0, 0.3, 1.0

_U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hashed feature, value) of the features of texts; values have unit length a text."""
    n = len(offsets) - 1
    word = _WORD[data]
    kinds = []
    low = LOWER[data]
    prefix = prefix_hash(low)
    for mask, kind in ((word, 0), (~word & ~SPACE[data], 1)):
        start, end, text = runs(mask, offsets)
        kinds.append((start, end, text, np.full(len(start), kind)))
    start, end, text, kind = (np.concatenate(x) for x in zip(*kinds, strict=True))
    order = np.argsort(start, kind="stable")
    start, end, text, kind = start[order], end[order], text[order], kind[order]
    token = range_hash(prefix, start, end)
    up, dig = (np.concatenate([[0], np.cumsum(t[data])]) for t in (_UPPER, _DIGIT))
    size, up, dig = end - start, up[end] - up[start], dig[end] - dig[start]
    shape = (np.minimum(up, 2) + 3 * (up * 2 > size) + 6 * (dig > 0) + 12 * np.minimum(size // 4, 3)).astype(_U)
    shape = mix(np.where(kind == 1, token, shape) + _U(11))
    parts = [mix(token + _U(1)), mix(shape + _U(2))]
    texts, lights = [text, text], [0, 0]
    for back in (1, 2):
        same = text[back:] == text[:-back]
        again = same & (token[back:] == token[:-back])
        parts.append(np.full(int(again.sum()), back, _U) + _U(3))
        texts.append(text[back:][again])
        lights.append(0)
        for own, salt, light in ((shape, 31, 0), (token, 37, 1)):
            gram = own[back:] * _U(salt)
            for k in range(1, back + 1):
                gram = mix(gram + own[back - k : len(own) - k])
            parts.append(gram[same])
            texts.append(text[back:][same])
            lights.append(light)
    column = (np.concatenate(parts) >> _U(64 - BITS)).astype(np.int64)
    # odd columns are for pairs and triples of words, which count less
    column = column & ~1 | np.repeat(np.array(lights), [len(t) for t in texts])
    key, value = np.unique(np.concatenate(texts) << BITS | column, return_counts=True)
    text, column = key >> BITS, key & ((1 << BITS) - 1)
    value = np.log1p(value) * np.where(column & 1, GRAM_SCALE, 1.0)
    length = np.sqrt(np.bincount(text, value * value, n))
    return text, column, value / length[text]


def fit(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """Weights (and the bias, last) by FTRL-proximal updates, one text at a time in the order given."""
    size = (1 << BITS) + 1
    z, g2 = np.zeros(size), np.zeros(size)
    data, offsets = utf8(pa.array(texts, pa.string()))
    rows = []
    for lo, hi, d, o in chunks(data, offsets):
        text, column, value = features(d, o)
        cut = np.searchsorted(text, np.arange(hi - lo + 1))
        rows += [(np.append(column[a:b], size - 1), np.append(value[a:b], 1.0)) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def weight(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    order = np.random.default_rng(17)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            at, x = rows[k]
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - labels[k]) * x
            more = g2[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(g2[at])) / ALPHA * w
            g2[at] = more
    return weight(np.arange(size))


def score_texts(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    out = np.empty(len(column))
    for lo, hi, data, offsets in chunks(*utf8(column), 1 << 19):
        text, at, value = features(data, offsets)
        out[lo:hi] = np.bincount(text, weights[at] * value, hi - lo) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves the held-out remainder; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def fit_labelled(docs: DataFrame, labels: DataFrame, column: str, most: int, function) -> bytes:
    """What ``function`` makes, in one task, of at most ``most`` labelled texts outside the held-out fold, in the order of their ids' hashes."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(most)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = own.join(F.broadcast(known), "doc_id").orderBy("order", "text").limit(most).select("text", "label").coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, given = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            given += b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([function(texts, np.array(given, float))], pa.binary())], ["model"])

    made = rows.mapInArrow(run, "model binary").first()
    return bytes(made.model) if made else function([], np.zeros(0))


class QualityModel:
    """A fitted scorer; ``score`` gives a Column, so rows keep all their columns."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> QualityModel:
        """Fits on at most ``most`` rows of ``labels`` (doc_id, quality) outside the held-out fold.

        Rows without a label or id are left out; of several labels of one id
        the largest counts.  Without any labelled row every score is 0.5.
        """
        made = fit_labelled(docs, labels, "quality", most, lambda texts, y: (fit(texts, y) if texts else np.zeros((1 << BITS) + 1)).tobytes())
        return cls(np.frombuffer(made))

    def score(self, docs: DataFrame, text: str = "text") -> Column:
        return scorer(docs, self.weights, score_texts)(F.col(text).cast("string"))


def scorer(docs: DataFrame, model, function):
    """An Arrow function over a string column, with the model sent to each executor once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(function(column, sent.value), pa.float64())

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Null texts count as empty and score as such; a null doc_id is not held out;
    repeated rows score alike.  An empty table gives an empty result.  Other
    columns are ignored.
    """
    model = QualityModel.fit(docs, labels)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("score", model.score(docs))
    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD
