"""Packs token runs into sequences: shortest pack first over the length histogram.

Each document is tokenised once.  Its ids are cut into pieces of at most one
sequence while the ids are at hand, so that only lengths and checksums move.
The histogram of piece lengths (at most ``SEQUENCE`` entries, whatever the
input's size) is packed on the driver, longest lengths first, each into the
pattern with most room; the patterns' places are then joined back to pieces by
the rank of a piece among those of its length.
"""

from __future__ import annotations

import heapq
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, materialise, release, utf8

SEQUENCE = 4096
#: Text bytes whose runs are told apart at once.
WORD_BYTES = 1 << 23
#: Distinct words whose ids a worker remembers.
CACHE_WORDS = 400_000
#: Rows of one length that one sorting task should rank.
RANK_ROWS = 1_000_000


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with room for n at least, doubled where it is too small."""
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class WordIds:
    """Token ids of texts, found once for each distinct run between ASCII spaces.

    White space becomes a boundary that no id crosses, so the ids of a text are
    those of its runs in turn.  A run of composed Latin letters and signs is
    split here by the tokenizer file's own pattern, and the tokenizer's model
    finds each distinct part's ids; any other run goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            pattern = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.parts = regex.compile(pattern).findall
        self.plain = regex.compile("[!-~\u00a1-\u024f]*").fullmatch
        # a byte-level vocabulary writes a byte that is no visible character as one past 255
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = (b for b in range(256) if b not in printable)
        self.byte_chars = {b: chr(256 + k) for k, b in enumerate(others)}
        self._forget()

    def _forget(self) -> None:
        self.last: tuple[np.ndarray, list[str]] = np.zeros(0, np.int64), []
        self.at: dict[str, int] = {}
        self.part: dict[str, bytes] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[k]: past the ids of run k-1

    def _whole(self, run: str) -> bytes:
        return array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()

    def _learn(self, new: list[str]) -> None:
        known, tokenize, parts, plain = self.part, self.tokenizer.model.tokenize, self.parts, self.plain
        lists = []
        for run in new:
            if not plain(run):
                lists.append(self._whole(run))
                continue
            low = run.lower()
            ids = b""
            for part in (low,) if low.isalpha() else parts(low):
                if (own := known.get(part)) is None:
                    spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.byte_chars)
                    own = known[part] = array("I", [t.id for t in tokenize(spelled)]).tobytes()
                ids += own
            lists.append(ids)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        k, total = len(self.at), int(sizes.sum())
        start = int(self.ends[k])
        self.flat, self.ends = _grown(self.flat, start + total), _grown(self.ends, k + len(new) + 1)
        self.flat[start : start + total] = np.frombuffer(b"".join(lists), np.uint32)
        self.ends[k + 1 : k + 1 + len(new)] = start + np.cumsum(sizes)
        self.at.update(zip(new, range(k, k + len(new)), strict=True))

    def shrink(self) -> None:
        """Forgets the runs but those of the last call."""
        k, distinct = self.last
        first, size = self.ends[k], self.ends[k + 1] - self.ends[k]
        past = np.cumsum(size)
        flat = self.flat[np.repeat(first - past + size, size) + np.arange(int(size.sum()))]
        self._forget()
        self.flat, self.ends = flat, np.concatenate([[0], past])
        self.at = dict(zip(distinct, range(len(distinct)), strict=True))
        self.last = np.arange(len(distinct)), distinct

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and their len+1 offsets."""
        split = pc.ascii_split_whitespace(texts)
        runs = split.flatten().dictionary_encode()
        distinct = runs.dictionary.to_pylist()
        own = np.fromiter(map(self.at.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(new := np.flatnonzero(own < 0)):
            own[new] = len(self.at) + np.arange(len(new))
            self._learn([distinct[k] for k in new.tolist()])
        k = own[runs.indices.to_numpy()] if len(distinct) else own
        first, size = self.ends[k], self.ends[k + 1] - self.ends[k]
        past = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(first - past[:-1], size) + np.arange(past[-1])]
        counts = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        self.last = own, distinct
        if len(self.at) > CACHE_WORDS or len(self.part) > CACHE_WORDS:
            self.shrink()
        return ids, past[counts]


#: The ids that a worker has found, for its later tasks too; one tokenizer at a time.
_WORKER: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORKER:
        _WORKER.clear()
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(tokenizer: str, end_id: int, sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            texts = pc.fill_null(b.column(1).cast(pa.large_string()), "")
            out: list[list] = [[], [], [], [], []]
            for lo, hi, _, _ in chunks(*utf8(texts), size=WORD_BYTES):
                ids, at = ids_of(texts[lo:hi])
                ids = ids.astype("<u4", copy=False)
                for doc_id, first, past in zip(b.column(0)[lo:hi].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    total = past - first + 1
                    for start in range(0, total, sequence):
                        length = min(sequence, total - start)
                        last = start + length == total
                        check = zlib.crc32(ids[first + start : first + start + length - last])
                        if last:
                            check = zlib.crc32(end, check)
                        for column, x in zip(out, (doc_id, start, length, check, total), strict=True):
                            column.append(x)
            release()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        ids_of.shrink()  # the next task on this worker starts with frequent runs, and other operators' find room
        release()

    return run


def pack_histogram(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shortest pack first: patterns [(how often, [(length, how many in a row), ...])].

    Lengths go longest first; each goes to the patterns with most room left,
    which split when they are more than the pieces.  Where none has room, just as
    many sequences open as the remaining pieces need.
    """
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    free: list[int] = []

    def put(left: int, often: int, pattern: list[tuple[int, int]]) -> None:
        if left not in room:
            room[left] = []
            heapq.heappush(free, -left)
        room[left].append((often, pattern))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            while free and not room.get(-free[0]):
                room.pop(-heapq.heappop(free), None)
            if not free or -free[0] < length:
                put(sequence, -(-n // (sequence // length)), [])
                continue
            left = -free[0]
            often, pattern = room[left].pop()
            used = min(often, n)
            if used < often:
                room[left].append((often - used, pattern))
            last = pattern[-1] if pattern else (0, 0)
            put(left - length, used, [*pattern[:-1], (length, last[1] + 1)] if last[0] == length else [*pattern, (length, 1)])
            n -= used
    return [p for left in sorted(room) for p in room[left]]


def _slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: the first rank, first sequence, sequences and offset of each run of places.

    However many pieces there are, a length opens one pattern and splits one at
    most, and a pattern holds under 91 distinct lengths (they add up to the
    sequence): at most 750,000 runs, 24 MB, and some ten thousand in practice.
    """
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for often, pattern in patterns:
        offset = 0
        for length, many in pattern:
            rank = ranks.get(length, 0)
            by.setdefault(length, []).append((rank, sequence, often, offset))
            ranks[length] = rank + often * many
            offset += length * many
        sequence += often
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in by.items()}


def _place(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
                own = order[lo:hi]
                first, base, often, at = table[int(length[own[0]])]
                k = np.searchsorted(first, rank[own], "right") - 1
                turn, place = np.divmod(rank[own] - first[k], often[k])
                sequence[own], offset[own] = base[k] + place, at[k] + turn * length[own]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = 2) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text), with its place in a sequence.

    A null or empty text is its end id alone.  Null and repeated doc_ids are
    documents of their own; pieces that tie in every column are interchangeable.
    An empty table gives no pieces, and other columns are ignored.  Columns:
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialise(rows.mapInArrow(_pieces(tokenizer, end_id, sequence), _PIECES), "pieces", WORD_BYTES)
    # ranks within a length come from ranks within (length, part): a length may hold most pieces
    n = pieces.count()
    parts = max(16, -(-n // RANK_ROWS))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int"))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    base = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialise(counts.withColumn("base", F.coalesce(F.sum("n").over(base), F.lit(0))), "ranks")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(pack_histogram(histogram, sequence)))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("r", F.row_number().over(order) - 1).join(counts.drop("n"), ["length", "part"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("r") + F.col("base")).cast("long").alias("rank"))
    return ranked.mapInArrow(_place(slots), _PIECES + ", sequence_id long, offset long")


def padding(total: int, sequence: int = SEQUENCE) -> int:
    """Pad ids that a sequence of ``total`` ids takes: none at a power of two."""
    return 0 if total & (total - 1) == 0 else sequence - total

