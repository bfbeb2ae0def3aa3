"""Exact dedup over a cuckoo-filter index of live digests.

The index keeps 16-bit fingerprints in buckets of four slots and, beside each
fingerprint, the full key: a fingerprint hit is only a hint until the stored
key confirms it.  Keys can be deleted again; when an insertion finds no room
after the usual evictions, the table doubles and refills from its stored keys.

Digests that several rows share are verified against content: their texts meet
in buckets of the digest, the least and the greatest of each task's own first,
and must be one text.  Texts of single rows never move.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, id_filter, materialise, partitions, utf8

#: Live digests that one map-side index gathers before it is handed on.
MAP_KEYS = 1 << 16
#: Digests that one reducing index should hold.
REDUCE_KEYS = 1 << 18


class CuckooIndex:
    """Cuckoo filter of digests whose slots carry the digest and a value [largest id, live rows]."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 64):
        self.resizes = 0
        self._clear(1 << max(1, buckets - 1).bit_length())

    def _clear(self, buckets: int) -> None:
        self.buckets, self.size = buckets, 0
        self.marks = array("H", bytes(2 * buckets * self.SLOTS))
        self.held: list = [None] * (buckets * self.SLOTS)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[-2:], "little") or 1
        one = int.from_bytes(key[:6], "little") & (self.buckets - 1)
        return mark, one, one ^ self._jump(mark)

    def _jump(self, mark: int) -> int:
        return (mark * 0x5BD1E995 >> 3) & (self.buckets - 1)

    def _slot(self, key: bytes) -> int:
        mark, one, two = self._places(key)
        for bucket in (one, two):
            for at in range(bucket * self.SLOTS, bucket * self.SLOTS + self.SLOTS):
                if self.marks[at] == mark and self.held[at][0] == key:
                    return at
        return -1

    def get(self, key: bytes):
        at = self._slot(key)
        return None if at < 0 else self.held[at][1]

    def insert(self, key: bytes, value) -> None:
        """Adds a key that ``get`` did not find."""
        entry = (key, value)
        while not self._put(entry):
            kept = [e for e in self.held if e is not None]
            buckets = self.buckets
            while True:
                buckets *= 2
                self.resizes += 1
                self._clear(buckets)
                if all(self._put(e) for e in kept):
                    break

    def _put(self, entry) -> bool:
        """False, and the table as it was, if no place was found."""
        mark, bucket, other = self._places(entry[0])
        for b in (bucket, other):
            for at in range(b * self.SLOTS, b * self.SLOTS + self.SLOTS):
                if not self.marks[at]:
                    self.marks[at], self.held[at] = mark, entry
                    self.size += 1
                    return True
        moved = []
        for kick in range(self.KICKS):
            at = bucket * self.SLOTS + (kick + mark) % self.SLOTS
            moved.append(at)
            mark, self.marks[at] = self.marks[at], mark
            entry, self.held[at] = self.held[at], entry
            bucket ^= self._jump(mark)
            for to in range(bucket * self.SLOTS, bucket * self.SLOTS + self.SLOTS):
                if not self.marks[to]:
                    self.marks[to], self.held[to] = mark, entry
                    self.size += 1
                    return True
        for at in reversed(moved):
            mark, self.marks[at] = self.marks[at], mark
            entry, self.held[at] = self.held[at], entry
        return False

    def delete(self, key: bytes) -> bool:
        at = self._slot(key)
        if at < 0:
            return False
        self.marks[at], self.held[at] = 0, None
        self.size -= 1
        return True

    def add(self, key: bytes, doc_id: int | None, rows: int) -> None:
        """Counts ``rows`` live rows of a key, the largest of them ``doc_id``; negative rows retire some."""
        value = self.get(key)
        if value is None:
            self.insert(key, [doc_id, rows])
            return
        value[1] += rows
        if doc_id is not None and (value[0] is None or doc_id > value[0]):
            value[0] = doc_id

    def batch(self) -> pa.RecordBatch:
        held = [e for e in self.held if e is not None]
        return pa.RecordBatch.from_arrays(
            [pa.array([e[0] for e in held], pa.binary()), pa.array([e[1][0] for e in held], pa.int64()), pa.array([e[1][1] for e in held], pa.int64())], ["digest", "keep_id", "group_size"]
        )


_GROUPS = "digest binary, keep_id long, group_size long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = utf8(b.column(1))
        low = LOWER[data].tobytes()
        found = [hashlib.sha256(low[s:e]).digest() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), b.column(2)], ["doc_id", "digest", "live"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: one row a digest and ``MAP_KEYS``; rows of a hot digest never travel singly."""
    index = CuckooIndex(1024)
    for b in batches:
        for key, doc_id, live in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            index.add(key, doc_id if live else None, 1 if live else 0)
            if index.size >= MAP_KEYS:
                yield index.batch()
                index = CuckooIndex(1024)
    if index.size:
        yield index.batch()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex(4096)
    retired = []
    for b in batches:
        for key, doc_id, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
            index.add(key, doc_id, rows)
            if rows == 0:
                retired.append(key)
    for key in retired:  # digests of which no live row is left leave the index
        if (value := index.get(key)) and value[1] == 0:
            index.delete(key)
    if index.size:
        yield index.batch()


def _shared(wanted: Broadcast):
    """(digest, lower-cased bytes) of texts whose digest may be one that several rows have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(0))
            low = LOWER[data].tobytes()
            texts = [low[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            found = [hashlib.sha256(t).digest() for t in texts]
            marks = np.frombuffer(b"".join(d[:8] for d in found), ">i8").astype(np.int64)
            keep = np.flatnonzero(wanted.value.may_hold(marks)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in keep], pa.binary()) for x in (found, texts)], ["digest", "low"])

    return run


def verified(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """``groups`` (digest and others) of which every row's text (lower-cased A-Z) is the same; others stop the job.

    Only texts that may have such a digest leave their task, and a task sends the
    least and the greatest of each digest, so a hot group moves as two texts a task.
    """
    mark = F.conv(F.substring(F.hex("digest"), 1, 16), 16, -10).cast("long")
    wanted = texts.sparkSession.sparkContext.broadcast(id_filter(groups.select(mark.alias("mark"))))
    own = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_shared(wanted), "digest binary, low binary")
    ends = own.groupBy("digest").agg(F.min("low").alias("least"), F.max("low").alias("greatest"))
    same = F.when(F.col("least") == F.col("greatest"), True).otherwise(F.raise_error(F.lit("texts of one digest differ")))
    # an inner join, so that the check is not skipped: each group has its texts
    return groups.join(ends, "digest").withColumn("same", same).where("same").drop("same", "least", "greatest")


def text_digest(text: Column) -> Column:
    """SHA-256 of a text with A-Z lower-cased; a null text counts as empty."""

    @F.arrow_udf("binary")
    def digest(column: pa.Array) -> pa.Array:
        data, offsets = utf8(column)
        low = LOWER[data].tobytes()
        return pa.array([hashlib.sha256(low[s:e]).digest() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())

    return digest(text.cast("string"))


def exact_dedup(docs: DataFrame, retired: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the
    row with the largest doc_id stays.  ``retired`` (doc_id) names rows that are
    no longer live: they count in no group and are never kept.

    Null texts count as empty, and all empty texts are one group.  A null
    doc_id is smaller than any other, and such a row stays only where its group
    has no other.  Rows that repeat a doc_id and a text count singly and share
    one decision.  An empty table gives an empty result; other columns are
    ignored.  A text's bytes reach one Python task at a time; digests are
    shuffled, and of texts with a shared digest what ``verified`` says.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if retired is None:
        rows = rows.withColumn("live", F.lit(True))
    else:
        gone = retired.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("gone")).distinct()
        rows = rows.join(gone, "doc_id", "left").select("doc_id", "text", F.col("gone").isNull().alias("live"))
    texts = rows.select("text")
    rows = materialise(rows.mapInArrow(_digests, "doc_id long, digest binary, live boolean"), "digests")
    parts = rows.mapInArrow(_combine, _GROUPS)
    n = partitions(spark, rows.count(), REDUCE_KEYS)
    groups = materialise(parts.repartition(n, "digest").mapInArrow(_merge, _GROUPS), "groups")
    shared = materialise(verified(texts, groups.where("group_size > 1")), "verified")
    groups = groups.where("group_size < 2").unionByName(shared)
    return rows.join(groups, "digest", "left").select(
        "doc_id",
        F.when(F.col("live"), F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(0)).alias("group_size"),
        (F.col("live") & F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
