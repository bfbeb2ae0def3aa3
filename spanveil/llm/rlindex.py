"""Removal of repeated passages with a run-length index.

Every window of ``LENGTH`` bytes belongs to the smallest of the hashes of its
``GRAM``-byte grams, its anchor, so equal windows have equal anchors wherever
they stand.  The windows of one anchor in a row are a segment.  Segments equal
in anchor and in the hash of all their bytes (128 bits together) are marked
whole; they meet by both hashes, so that an anchor of many texts is spread over
all tasks.  The distinct segments of an anchor meet in one task if they are few;
a run-compressed Burrows-Wheeler transform of them, with the text places at both ends of each
run sampled, gives every place's longest match elsewhere: at a sampled place by
comparison with its neighbour in suffix order, at any other place as one less
than the place before.  Places that match ``LENGTH`` bytes or more are marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialise, mix, partitions, prefix_hash, range_hash, utf8

LENGTH, GRAM = 200, 32
#: Longest stretch of one text that one vectorised step takes; places in it fit 24 bits.
STRETCH = 1 << 23
#: Segments that one reducing task should gather.
REDUCE_SEGMENTS = 1 << 20
#: Distinct segments of one anchor that one index takes; beyond, windows are told apart one by one.
ANCHOR_SEGMENTS = 4096
#: Bytes of one index.
INDEX_BYTES = 1 << 21

_U = np.uint64
_PLACE = _U((1 << 24) - 1)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start in it, windows, anchor, hash of the bytes) of the segments of texts."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.view(_U), none.view(_U)
    prefix = prefix_hash(data)
    place = np.arange(n - GRAM + 1)
    gram = range_hash(prefix, place, place + GRAM)
    low = (gram & ~_PLACE) | place.astype(_U)
    wide, span = 1, LENGTH - GRAM + 1
    while 2 * wide <= span:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if wide < span:
        low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :])
    anchor = (low & _PLACE).astype(np.int64)
    text = np.searchsorted(offsets, place[: len(anchor)], "right") - 1
    whole = place[: len(anchor)] + LENGTH <= offsets[text + 1]
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(first)
    last = whole.copy()
    last[:-1] &= ~whole[1:] | first[1:]
    end = np.flatnonzero(last) + 1
    return text[start], start - offsets[text[start]], end - start, gram[anchor[start]], range_hash(prefix, start, end - 1 + LENGTH)


def _stretches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place in its text, bytes, offsets) of runs of texts, or of parts of a very long text that overlap by all but one byte of a window."""
    for lo, _, data, offsets in chunks(*utf8(column)):
        for at in range(0, max(1, len(data) - LENGTH + 1), STRETCH) if len(data) > 2 * STRETCH else (0,):
            part = data[at : at + STRETCH + LENGTH - 1] if len(data) > 2 * STRETCH else data
            yield lo, at, part, np.array([0, len(part)]) if len(data) > 2 * STRETCH else offsets


def _merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of each row, in order, joined where they touch."""
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    if not len(row):
        return row, lo, hi
    base = np.concatenate([[0], np.cumsum(row[1:] != row[:-1])]) << 40
    reach = np.maximum.accumulate(hi + base)
    new = np.concatenate([[True], (lo + base)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return row[first], lo[first], (reach - base)[np.append(first[1:], len(row)) - 1]


_SENT = "bucket int, entries binary, row long, lo long, hi long"
_TOLD = "kind string, row long, lo long, hi long, anchor long, many boolean"
#: Segments that a sending task gathers before it hands them on.
SEND_SEGMENTS = 1 << 18


def _send(buckets: int):
    """Segments to the bucket of both their hashes; of those that repeat in a task's reach one goes, and all are marked at once."""

    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        row, start, windows, anchor, mark = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((mark, anchor))
        row, start, windows, anchor, mark = (x[order] for x in (row, start, windows, anchor, mark))
        new = np.ones(len(row), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (mark[1:] != mark[:-1])
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(row))) > 1
        again = np.repeat(many, np.diff(np.append(first, len(row))))
        own = _merged(row[again], start[again], start[again] + windows[again] - 1 + LENGTH)
        n = len(own[0])
        if n:
            spread = (own[0] % buckets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.nulls(n, pa.binary()), *map(pa.array, own)], ["bucket", "entries", "row", "lo", "hi"])
        sent = [x[first] for x in (anchor, mark, row.view(_U))] + [(start[first] << 16 | windows[first] << 1 | many).astype(_U)]
        bucket = (mix(sent[0] ^ mix(sent[1])) % _U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        table = np.stack(sent)[:, order]
        full = np.flatnonzero(np.diff(cuts))
        none = pa.nulls(len(full), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([table[:, cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()), none, none, none], ["bucket", "entries", "row", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, at, data, offsets in _stretches(batch.column(1)):
                text, start, windows, anchor, mark = segments(data, offsets)
                parts.append((ids[lo + text], start + at, windows, anchor, mark))
                if sum(len(p[0]) for p in parts) > SEND_SEGMENTS:
                    yield from flush(parts)
                    parts = []
        if parts:
            yield from flush(parts)

    return run


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of segments that repeat whole ("all"), and one of each distinct segment ("one")."""
    held = []

    def rows(kind: str, row, lo, hi, anchor=None, many=None) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(row), 1 << 18):
            cut = slice(k, k + (1 << 18))
            n = len(row[cut])
            columns = [pa.array([kind] * n, pa.string()), pa.array(row[cut]), pa.array(lo[cut]), pa.array(hi[cut]), pa.nulls(n, pa.int64()) if anchor is None else pa.array(anchor[cut]), pa.nulls(n, pa.bool_()) if many is None else pa.array(many[cut])]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "row", "lo", "hi", "anchor", "many"])

    for batch in batches:
        plain = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        if plain.any():
            own = batch.filter(pa.array(plain))
            yield from rows("all", *(own.column(k).to_numpy() for k in (2, 3, 4)))
        held += [np.frombuffer(x, _U).reshape(4, -1) for x in batch.column(1).drop_null().to_pylist()]
    if not held:
        return
    anchor, mark, row, place = np.concatenate(held, axis=1)
    held.clear()
    order = np.lexsort((mark, anchor))
    anchor, mark, row, place = anchor[order], mark[order], row[order].view(np.int64), place[order].astype(np.int64)
    start, windows, many = place >> 16, (place & 0xFFFF) >> 1, (place & 1).astype(bool)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (mark[1:] != mark[:-1])])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(row)))
    repeated = (size > 1) | np.bitwise_or.reduceat(many, first)
    all_of = np.repeat(repeated, size) & ~many
    yield from rows("all", *_merged(row[all_of], start[all_of], (start + windows - 1 + LENGTH)[all_of]))
    yield from rows("one", row[first], start[first], (start + windows - 1 + LENGTH)[first], anchor[first].view(np.int64), repeated)


#: Stands between segments and is no byte, so that a match of bytes never crosses it.
SEPARATOR = 256


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of symbols up to 510, by prefix doubling from seven of them; only suffixes that still tie are sorted again."""
    n = len(text)
    padded = np.concatenate([text.astype(_U) + _U(1), np.zeros(7, _U)])
    key = np.zeros(n, _U)
    for k in range(7):
        key = key << _U(9) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    wide = 7
    while wide < 2 * n:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = order[at]
        after = np.where(own + wide < n, rank[np.minimum(own + wide, n - 1)] + 1, 0)
        key = rank[own] << 32 | after
        by = np.argsort(key, kind="stable")
        order[at], key = own[by], key[by]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[at] = fresh
        rank[order[at]] = np.maximum.accumulate(np.where(fresh, at, 0))
        wide *= 2
    return order


class RunLengthIndex:
    """The runs of a text's Burrows-Wheeler transform: the text places at both ends of each run, and their neighbours in suffix order.

    Within a run the place before each has the same symbol as its neighbour's, so
    its match there is one longer: only the ends of runs need be compared.
    """

    def __init__(self, text: np.ndarray):
        order = suffix_order(text)
        bwt = text[order - 1]
        change = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        head, tail = np.append(0, change), np.append(change, len(bwt)) - 1
        self.text = text
        self.sampled, self.neighbour = [], []
        for end, step in ((head, -1), (tail, 1)):
            end = end[(end + step >= 0) & (end + step < len(order))]
            self.sampled.append(order[end])
            self.neighbour.append(order[end + step])

    def matching_statistics(self) -> np.ndarray:
        """The longest match elsewhere of each place, in text order."""
        out = np.zeros(len(self.text), np.int64)
        for place, other in zip(self.sampled, self.neighbour, strict=True):
            reach = np.zeros(len(self.text), np.int64)
            np.maximum.at(reach, place, place + self._common(place, other))
            out = np.maximum(out, np.maximum.accumulate(reach) - np.arange(len(self.text)))
        return out

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common bytes from two places on, compared eight at a time."""
        n = len(self.text)
        eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.text, np.zeros(8, self.text.dtype)]), 8)
        out, left = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(left):
            x, y = a[left] + out[left], b[left] + out[left]
            same = np.cumprod(eight[np.minimum(x, n)] == eight[np.minimum(y, n)], axis=1).sum(1)
            out[left] += same
            left = left[(same == 8) & (np.maximum(x, y) + 8 <= n)]
        return out


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, the starts of its windows that start anywhere else in the parts too."""
    text = np.full(1 + sum(len(p) + 1 for p in parts), SEPARATOR, np.uint16)
    at = 1
    for p in parts:
        text[at : at + len(p)] = np.frombuffer(p, np.uint8)
        at += len(p) + 1
    match = RunLengthIndex(text).matching_statistics()
    out, at = [], 1
    for p in parts:
        out.append(np.flatnonzero(match[at : at + max(0, len(p) - length + 1)] >= length))
        at += len(p) + 1
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, row, lo, part, many), sorted by anchor, to marked intervals."""
    parts: list[bytes] = []
    info: list[tuple[int, int, bool]] = []
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        rows, los, his = [], [], []
        for (row, lo, many), starts in zip(info, repeated_windows(parts), strict=True):
            if not many and len(starts):
                cut = np.flatnonzero(np.diff(starts) > LENGTH)
                rows += [row] * (len(cut) + 1)
                los += (lo + starts[np.append(0, cut + 1)]).tolist()
                his += (lo + starts[np.append(cut, len(starts) - 1)] + LENGTH).tolist()
        parts.clear()
        info.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows, los, his)], ["row", "lo", "hi"])

    for batch in batches:
        for anchor, row, lo, part, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > INDEX_BYTES and anchor != last:
                yield flush()
                size = 0
            last = anchor
            parts.append(part)
            info.append((row, lo, many))
            size += len(part)
    if parts:
        yield flush()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their segments to one row a segment."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for row, text, some in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = text.as_buffer()
            for s in some:
                for column, x in zip(out, (s["kind"], s["anchor"], row, s["lo"], s["many"]), strict=True):
                    column.append(x)
                out[-1][-1] = (raw.slice(s["lo"], s["hi"] - s["lo"]).to_pybytes(), s["many"])
        parts = [x for x, _ in out[4]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(parts, pa.binary()), pa.array([m for _, m in out[4]], pa.bool_())],
            ["kind", "anchor", "row", "lo", "part", "many"],
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, row, lo, n): every window of segments with too common an anchor; one of a repeated segment counts as two."""
    for batch in batches:
        digest, row, lo, n = [], [], [], []
        for r, at, part, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for k in range(len(part) - LENGTH + 1):
                digest.append(hashlib.blake2b(part[k : k + LENGTH], digest_size=12).digest())
                lo.append(at + k)
            row += [r] * (len(part) - LENGTH + 1)
            n += [1 + many] * (len(part) - LENGTH + 1)
        yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), *(pa.array(x, pa.int64()) for x in (row, lo, n))], ["digest", "row", "lo", "n"])


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """(row, lo, hi) of marked byte intervals, which may overlap, of ``docs`` (row, text)."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = partitions(spark, size // 80, REDUCE_SEGMENTS)
    told = docs.mapInArrow(_send(buckets), _SENT).repartition(buckets, "bucket").mapInArrow(_tell, _TOLD)
    told = materialise(told, "segments")
    # counted before they move, so that an anchor of most segments is one row a task
    shared = told.where("kind = 'one'").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    kind = F.when(F.col("n") <= ANCHOR_SEGMENTS, "index").otherwise("window").alias("kind")
    need = told.where("kind = 'one'").join(shared, "anchor").select("row", kind, "anchor", "lo", "hi", "many")
    need = need.groupBy("row").agg(F.collect_list(F.struct("kind", "anchor", "lo", "hi", "many")).alias("some"))
    cut = docs.dropna(subset=["text"]).join(need, "row").select("row", F.col("text").cast("binary").alias("text"), "some")
    cut = materialise(cut.mapInArrow(_cut, "kind string, anchor long, row long, lo long, part binary, many boolean"), "cut")
    indexed = cut.where("kind = 'index'").select("anchor", "row", "lo", "part", "many").repartition(buckets, "anchor").sortWithinPartitions("anchor").mapInArrow(_index, "row long, lo long, hi long")
    windows = cut.where("kind = 'window'").select("row", "lo", "part", "many").mapInArrow(_windows, "digest binary, row long, lo long, n long")
    again = windows.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")
    windows = windows.where("n = 1").join(again, "digest", "left_semi").select("row", "lo", (F.col("lo") + LENGTH).alias("hi"))
    return told.where("kind = 'all'").select("row", "lo", "hi").union(indexed).union(windows)


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, los, his in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = text.as_py() or b""
                spans: list[list[int]] = []
                for lo, hi in sorted(zip(los or (), his or (), strict=True)):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                kept, at = [], 0
                for lo, hi in spans:
                    kept.append(raw[at:lo])
                    at = hi
                kept = b"".join([*kept, raw[at:]])
                for column, x in zip(out, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None), strict=True):
                    column.append(x)
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[: 5 if with_text else 4]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 6 if with_text else 5])

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text].

    Texts are their UTF-8 bytes.  Every byte covered by a ``LENGTH``-byte string
    that starts anywhere else too, the same text included, is removed; n_spans
    counts the maximal removed runs.  In ``kept_text``, bytes of characters cut
    in half become U+FFFD.

    A null text counts as empty.  Rows with a null or repeated doc_id are texts
    of their own, so that of rows repeated whole all long bytes go.  An empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("row", F.xxhash64(F.col("doc_id").cast("string"), F.lit("\0"), "text"))
    found = repeated_intervals(rows.select("row", "text"))
    found = found.groupBy("row").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    joined = rows.join(found, "row", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "lo", "hi")
    return joined.mapInArrow(_apply(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)
