"""Scratch tables, Arrow text buffers and vectorised hashing for the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import scratch_path

#: Bytes that executors hand Python at once.
BATCH_BYTES = 2 << 20
#: Text bytes that one vectorised step handles, save for a single longer text.
CHUNK_BYTES = 1 << 19

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.random.Generator(np.random.PCG64(7919)).integers(1, 2**63, 256, dtype=U64)
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_powers = {1: np.ones(1, U64), -1: np.ones(1, U64)}


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Plans run within hand Python at most about ``size`` bytes at once; a single longer row goes alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialise(df: DataFrame, name: str, batch: int = BATCH_BYTES) -> DataFrame:
    """Writes ``df`` to the shared scratch folder and reads it back: lineage ends there, so lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, name)
    with small_batches(df.sparkSession, batch):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Hands memory that a task no longer needs back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def partitions(spark: SparkSession, rows: int, each: int) -> int:
    """Enough partitions for ``each`` rows in one, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8), offsets


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, past, bytes, offsets) of runs of whole texts with about ``size`` bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        past = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
        yield at, past, data[offsets[at] : offsets[past]], offsets[at : past + 1] - offsets[at]
        at = past


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int, sign: int = 1) -> np.ndarray:
    if len(_powers[sign]) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), _MULT if sign > 0 else _INV, U64)
        steps[0] = 1
        _powers[sign] = np.multiply.accumulate(steps)
    return _powers[sign][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``range_hash`` takes the hash of any byte range."""
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = (prefix[end] - prefix[start]) * powers(len(prefix), -1)[start]
    return mix(h ^ ((end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each maximal run of True in ``mask``; runs never cross texts."""
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    cut = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[cut] = mask[cut]
    start = np.flatnonzero(first)
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    cut = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[cut] = mask[cut]
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the words ``[^\\x20\\x09-\\x0D]+`` of texts, A-Z lower-cased."""
    data = LOWER[data]
    start, end, text = runs(~SPACE[data], offsets)
    return range_hash(prefix_hash(data), start, end), text


_GRAM = [U64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingles(word: np.ndarray, text: np.ndarray, n_texts: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text and its offsets among them; a shorter text's whole sequence is its one shingle."""
    count = np.bincount(text, minlength=n_texts)
    h = np.zeros(max(0, len(word) - size + 1), U64)
    for k in range(size):
        h += mix(word[k : k + len(h)] + _GRAM[k]) * _GRAM[k]
    full = text[: len(h)] == text[size - 1 :] if len(h) else np.zeros(0, bool)
    per = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(offsets[-1], U64)
    at = np.flatnonzero(full)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    if len(at):
        out[offsets[text[at]] + at - first[text[at]]] = mix(h[at])
    for d in np.flatnonzero((count > 0) & (count < size)):
        own = word[first[d] : first[d] + count[d]]
        out[offsets[d]] = mix(np.sum(mix(own + np.arange(1, len(own) + 1, dtype=U64)), keepdims=True) ^ U64(len(own)))[0]
    return out, offsets


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def unsigned(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h, np.int64).view(U64)


class IdFilter:
    """Bloom filter of ids with a fixed bound on its size; past that bound it lets more through, and exact joins drop it."""

    MOST_BITS = 1 << 26

    def __init__(self, n: int):
        self.bits = 1 << max(10, min(self.MOST_BITS, 12 * max(n, 1)).bit_length())
        self.held = np.zeros(self.bits // 8, np.uint8)

    def _places(self, ids: np.ndarray) -> list[np.ndarray]:
        h = mix(unsigned(ids))
        return [((h >> U64(s)) & U64(self.bits - 1)).astype(np.int64) for s in (0, 17, 34)]

    def add(self, ids: np.ndarray) -> None:
        for p in self._places(ids):
            np.bitwise_or.at(self.held, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def may_hold(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), bool)
        for p in self._places(ids):
            out &= (self.held[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out


def id_filter(ids: DataFrame) -> IdFilter:
    """The filter of a one-column DataFrame; each task sends its own filter, never ids."""
    n = ids.count()
    size = IdFilter(n)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = IdFilter(n)
        for b in batches:
            own.add(b.column(0).to_numpy())
        at = np.flatnonzero(own.held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own.held[at].astype(np.int16), pa.int16())], ["at", "bits"])

    merged = ids.mapInArrow(build, "at long, bits smallint").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    with small_batches(ids.sparkSession):
        merged = merged.toArrow()
    for batch in merged.to_batches():
        size.held[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint8)
    return size
