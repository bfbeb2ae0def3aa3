"""Similarity join of word-shingle sets by parity sketches.

The shingles of a set are dealt to words by their hash, and each word is the
XOR of its shingles' 64-bit hashes.  A shingle that one set has and another
lacks changes one word, so the number of words that differ is a lower bound of
the symmetric difference.  Sets of sizes a <= b with Jaccard similarity J or
more differ in at most (1 - J) / (1 + J) * (a + b) shingles, hence at most
(1 / J - 1) * a; so among any more than that many non-empty words of the
smaller one, one at least is equal in both (pigeonhole).  Each size band has a
number of words of its own; a set publishes the first of its non-empty words,
in one fixed order, and those of the next band if a partner may lie there.
Sets that share a word are candidates; their exact intersection decides.

Words of frequent shingles come last in the order, the most frequent at the
end, so that a line which many unrelated texts share is published only by texts
with little else.  Identical sets are one node throughout.

Nodes that share a word are paired with the first of them, the pivot.  What
this leaves in several components meets again with the others of its pivot in
blocks of bounded size, except that the largest component does not meet itself:
sketches tell who has a candidate there, and of those, with their sets, each
block adds the links that join what it finds apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_filter, materialise, mix, partitions, release, shingles, signed, small_batches, unsigned, utf8, words

SIMILARITY = (75, 100)
SHINGLE = 5
#: Sets below this size have a word for each shingle; above, bands grow fourfold.
SMALL = 64
#: Published words that one reducing task should gather.
REDUCE_WORDS = 1 << 21
#: Nodes that share a word are paired directly up to this many; beyond, through the pivot and, if that leaves several components, in blocks.
DIRECT = 4
#: Nodes, and shingles of their sets, of one block of a large group.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: A shingle is frequent that one in so many texts holds, and so many texts at least; they steer the order of words only, never what is found.
FREQUENT_SHARE, FREQUENT_LEAST = 3200, 5
#: Shingles that a counting task holds at once.
COUNT_SHINGLES = 1 << 20
#: Frequent shingles come in levels, each of fourfold frequency.
LEVELS = 7

_U = np.uint64


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for lo, hi, data, offsets in chunks(*utf8(column)):
        found, at = shingles(*words(data, offsets), hi - lo, SHINGLE)
        for k in range(hi - lo):
            own = np.sort(found[at[k] : at[k + 1]])
            yield lo + k, own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own


def _node(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _band(n: int) -> int:
    band = 0
    while n >= SMALL * 4**band:
        band += 1
    return band


def published(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """Keys of the words that a set of sorted shingle hashes publishes; ``frequent`` has sorted shingles and their levels."""
    n, (shingle, level) = len(own), frequent
    of = np.zeros(n, np.uint8)
    if len(shingle) and n:
        k = np.minimum(np.searchsorted(shingle, own), len(shingle) - 1)
        of = np.where(shingle[k] == own, level[k], of)
    parts = [(late, own[of == late]) for late in np.unique(of).tolist()] if of.any() else [(0, own)]
    need = n * (similarity[1] - similarity[0]) // similarity[0] + 1
    band, out = _band(n), []
    bands = (band, band + 1) if _band(-(-n * similarity[1] // similarity[0])) > band else (band,)
    for b in bands:
        got, top = 0, 3 * SMALL * 4**b // 4
        for late, part in parts:
            if got >= need or not len(part):
                continue
            if b == 0:
                place, value = part[: need - got], part[: need - got]
            else:
                slot = ((part >> _U(32)) * _U(top)) >> _U(32)
                first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
                value = np.bitwise_xor.reduceat(mix(part), first)[: need - got]
                place = slot[first][: need - got]
            got += len(value)
            out.append(mix(value + mix(place * _U(1024) + _U(16 * b + late))))
    return np.concatenate(out)


def bit_sketch(own: np.ndarray) -> np.ndarray:
    """Parity of the shingles at each bit, packed; a power of two of at least 512 and twice the set's size in bits."""
    bits = max(512, 1 << (2 * max(1, len(own)) - 1).bit_length())
    return np.packbits(np.bincount((own & _U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little")


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch (or rows of sketches) with fewer bits: halves are XORed."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


_PUBLISHED = "bucket int, words binary, doc_id long, n long, node long, sketch binary"
_FOUND = "kind string, doc_id long, n long, a long, b long, sketch binary"


def _publish(frequent: Broadcast, buckets: int, similarity: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        nodes: list[tuple[int, int]] = []
        seen: set[int] = set()
        passed = 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate(held)
            node = np.repeat(np.array([x for x, _ in nodes], np.int64), [k for _, k in nodes])
            bucket = (keys % _U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            keys, node = keys[order], node[order]
            full = np.flatnonzero(np.diff(cuts))
            blobs = [keys[cuts[k] : cuts[k + 1]].tobytes() + node[cuts[k] : cuts[k + 1]].tobytes() for k in full]
            none = pa.nulls(len(full), pa.int64())
            held.clear()
            nodes.clear()
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary()), none, none, none, pa.nulls(len(full), pa.binary())], ["bucket", "words", "doc_id", "n", "node", "sketch"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows, sizes, own_nodes, sketches, waiting = [], [], [], [], 0
            for k, own in _sets(batch.column(1)):
                node = _node(own)
                rows.append(k)
                sizes.append(len(own))
                own_nodes.append(node)
                sketches.append(None)
                if len(own) and ids[k] is not None and node not in seen:
                    if len(seen) >= 1 << 18:
                        seen.clear()
                    seen.add(node)
                    held.append(published(own, frequent.value, similarity))
                    nodes.append((node, len(held[-1])))
                    sketches[-1] = bit_sketch(own).tobytes()
                    waiting += len(held[-1])
                    if waiting > 1 << 18:
                        yield flush()
                        waiting = 0
            if held:
                yield flush()
            doc = pa.array([ids[k] for k in rows], pa.int64())
            # by place, not by node: copies of one text are many rows
            spread = pa.array((np.arange(passed, passed + len(rows)) % buckets).astype(np.int32), pa.int32())
            passed += len(rows)
            yield pa.RecordBatch.from_arrays([spread, pa.nulls(len(rows), pa.binary()), doc, pa.array(sizes, pa.int64()), pa.array(own_nodes, pa.int64()), pa.array(sketches, pa.binary())], ["bucket", "words", "doc_id", "n", "node", "sketch"])
        seen.clear()
        release()

    return run


def _pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents pass; published words become candidate pairs, in large groups those with the pivot."""
    keys, nodes = [], []

    def rows(kind: str, a: np.ndarray, b: np.ndarray, doc=None, n=None, sketch=None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(a)), none if doc is None else doc, none if n is None else n, pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.binary()) if sketch is None else sketch], ["kind", "doc_id", "n", "a", "b", "sketch"])

    for batch in batches:
        blobs = batch.column(1)
        plain = blobs.is_null().to_numpy(zero_copy_only=False)
        if plain.any():
            own = batch.filter(pa.array(plain))
            node = own.column(4).to_numpy()
            yield rows("doc", node, node, own.column(2), own.column(3), own.column(5))
        for blob in blobs.drop_null().to_pylist():
            both = np.frombuffer(blob, np.int64).reshape(2, -1)
            keys.append(both[0].view(_U))
            nodes.append(both[1])
    if not keys:
        return
    key, node = np.concatenate(keys), np.concatenate(nodes)
    keys.clear()
    nodes.clear()
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
    key, node = key[new], node[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    pairs = []
    for g in range(2, DIRECT + 1):
        if len(at := first[size == g]):
            members = node[at[:, None] + np.arange(g)]
            x, y = np.triu_indices(g, 1)
            pairs.append(np.stack([members[:, x].ravel(), members[:, y].ravel()], 1))
    large = size > DIRECT
    if large.any():
        group = np.repeat(np.arange(len(size)), size)
        member = large[group]
        pivot = node[first[group[member]]]
        other = node[member] != pivot
        # near copies share many words, of most of which one node is the first: groups of a pivot are one
        both = np.unique(np.stack([pivot[other], node[member][other]], 1), axis=0)
        for lo in range(0, len(both), 1 << 18):
            yield rows("hot", both[lo : lo + (1 << 18), 0], both[lo : lo + (1 << 18), 1])
    if pairs:
        both = np.unique(np.concatenate(pairs), axis=0)
        for lo in range(0, len(both), 1 << 18):
            yield rows("pair", both[lo : lo + (1 << 18), 0], both[lo : lo + (1 << 18), 1])
    del key, node, order, new, first, size, pairs
    release()


def _contents(wanted: Broadcast):
    """(doc_id, node, set) of documents whose id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).drop_null()
            batch = batch.filter(batch.column(0).is_valid())
            batch = batch.filter(pa.array(wanted.value.may_hold(ids.to_numpy())))
            if len(batch):
                found = [own for _, own in _sets(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_node(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "node", "held"])

    return run


def _near(similarity: tuple[int, int]):
    """Candidate pairs whose sketches, a lower bound of the symmetric difference, allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for n, m, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64))
                ok.append(apart <= (n + m) * (similarity[1] - similarity[0]) // (similarity[1] + similarity[0]))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def linked(x: np.ndarray, y: np.ndarray, similarity: tuple[int, int]) -> bool:
    """Whether the Jaccard similarity of two sets is as asked."""
    if similarity[1] * min(len(x), len(y)) < similarity[0] * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return similarity[1] * both >= similarity[0] * (len(x) + len(y) - both)


def _verify(similarity: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), similarity) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``edges`` (a, b): root is the smallest node reachable, by alternating large and small stars."""
    spark = edges.sparkSession
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    mark = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "stars")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        edges = materialise(small, "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _open_groups(hot: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (pivot, node, root, n) of the large groups of ``hot`` (pivot a, other b) that lie in several components yet."""
    members = hot.select(F.col("a").alias("pivot"), F.col("b").alias("node")).union(hot.select("a", "a")).distinct()
    named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(nodes.select("node", "n"), "node")
    split = named.groupBy("pivot").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return named.join(split.select("pivot"), "pivot")


def _placed(members: DataFrame) -> DataFrame:
    """``members`` of open groups in pairs of blocks (x, y), each with its own block.

    The largest component of a group is its bulk, which has nothing to find in
    itself: blocks of the others meet one another and each block of the bulk, so
    copies grow with the others, not with the square of the group.
    """
    bulk = members.groupBy("pivot", "root").agg(F.count("*").alias("g")).groupBy("pivot").agg(F.max_by("root", F.struct("g", "root")).alias("bulk"))
    members = members.join(bulk, "pivot").withColumn("main", F.col("root") == F.col("bulk"))
    blocks = lambda part: F.greatest(F.ceil(F.count_if(part) / BLOCK), F.ceil(F.sum(F.when(part, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("pivot").agg(blocks(~F.col("main")).alias("others"), blocks(F.col("main")).alias("mains"))
    members = members.join(sizes, "pivot")
    turn = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    members = members.withColumn("own", F.when(F.col("main"), F.col("others") + turn("mains")).otherwise(turn("others")))
    last = F.when(F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    members = members.select("pivot", "node", "root", "n", "own", F.explode(F.sequence(F.lit(0), last)).alias("to"))
    return members.select("pivot", F.least("own", "to").alias("x"), F.greatest("own", "to").alias("y"), "node", "root", "n", "own")


def _candidates(table: pa.Table, label: np.ndarray, similarity: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, later rows whose sketches allow a link and whose labels differ, nearest first) between two blocks, or within one; ``label`` may change meanwhile."""
    n, own = table.column("n").to_numpy(), table.column("own").to_numpy()
    crossed = bool((own != own[0]).any())
    sketches = [np.frombuffer(x, np.uint8) for x in table.column("sketch").to_pylist()]
    # sets that can link have sizes within the similarity, so sketches of one size class or the next
    sizes = np.array([len(x) for x in sketches])
    classes = {c: np.flatnonzero(sizes == c) for c in np.unique(sizes).tolist()}
    for c, rows in classes.items():
        near = np.concatenate([rows, classes.get(2 * c, rows[:0])])
        bits = np.stack([folded(sketches[k], c) for k in near]).view(_U)
        for i, k in enumerate(rows.tolist()):
            other = near[i + 1 :]
            fit = (label[other] != label[k]) & (similarity[1] * np.minimum(n[other], n[k]) >= similarity[0] * np.maximum(n[other], n[k]))
            if crossed:
                fit &= own[other] != own[k]
            if not fit.any():
                continue
            other = other[fit]
            both = n[k] + n[other]
            apart = np.bitwise_count(bits[i + 1 :][fit] ^ bits[i]).sum(1, dtype=np.int64)
            ok = apart <= both * (similarity[1] - similarity[0]) // (similarity[1] + similarity[0])
            if ok.any():
                yield k, other[ok][np.argsort(apart[ok] / both[ok], kind="stable")]


def _labels(table: pa.Table) -> np.ndarray:
    return np.unique(table.column("root").to_numpy(), return_inverse=True)[1]


def _partnered(similarity: tuple[int, int]):
    """The rows of a group that have a candidate in it; only their sets are needed."""

    def run(table: pa.Table) -> pa.Table:
        keep = np.zeros(len(table), bool)
        for k, other in _candidates(table, _labels(table), similarity):
            keep[k] = True
            keep[other] = True
        return table.filter(pa.array(keep))

    return run


def _forest(similarity: tuple[int, int]):
    """Verified links that join what two blocks (or one) of a group have apart; at most one less than their nodes."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, label, held = table.column("node").to_numpy(), _labels(table), table.column("held").chunk(0)
        a, b = [], []
        for k, other in _candidates(table, label, similarity):
            x = np.frombuffer(held[k].as_buffer(), _U)
            for m in other.tolist():
                if label[m] != label[k] and linked(x, np.frombuffer(held[m].as_buffer(), _U), similarity):
                    a.append(min(node[k], node[m]))
                    b.append(max(node[k], node[m]))
                    label[label == label[m]] = label[k]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def similar_components(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, n_tree_links.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a text's
    set is its distinct five-word shingles, or its whole sequence if that is
    shorter.  Two texts link when the Jaccard similarity of their sets is at
    least ``similarity`` (a fraction); component_id is the smallest doc_id
    reachable by links, and n_tree_links counts the links of the row's set
    to other sets that were verified on the way there, not all that exist: of a
    large group only those that join components are verified.

    A null or empty text has an empty set and links with nothing, its own id
    its component.  A row with a null doc_id has null for its component and
    links with nothing.  Rows that repeat an id and text share one result, and
    one id with several texts has a row for each.  An empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    frequent = spark.sparkContext.broadcast(_frequent(rows, total, size))
    buckets = partitions(spark, size // 12, REDUCE_WORDS)
    published_rows = rows.mapInArrow(_publish(frequent, buckets, similarity), _PUBLISHED)
    found = materialise(published_rows.repartition(buckets, "bucket").mapInArrow(_pair_up, _FOUND), "parity")
    table = found.where("kind = 'doc'").select("doc_id", "n", F.col("a").alias("node"), "sketch")
    nodes = materialise(table.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch")), "nodes")

    def sets(named: DataFrame) -> DataFrame:
        named = materialise(named.distinct(), "named")
        wanted = spark.sparkContext.broadcast(id_filter(named.join(nodes, "node").select("doc_id")))
        firsts = nodes.select("doc_id", F.col("node").alias("own")).join(named, F.col("own") == named["node"], "left_semi")
        found = rows.mapInArrow(_contents(wanted), "doc_id long, node long, held binary")
        # a node's set is read from one of its rows
        held = found.join(firsts, (found["doc_id"] == firsts["doc_id"]) & (found["node"] == firsts["own"]), "left_semi")
        return materialise(held.select("node", "held").dropDuplicates(["node"]), "sets")

    first = found.where("kind <> 'doc'").select("a", "b").distinct()
    side = lambda c, n: nodes.select(F.col("node").alias(c), F.col("n").alias(n), F.col("sketch").alias(f"{n}_sketch"))
    first = first.join(side("a", "n"), "a").join(side("b", "m"), "b").where(f"{similarity[1]} * least(n, m) >= {similarity[0]} * greatest(n, m)")
    pairs = materialise(first.select("a", "b", "n", "m", "n_sketch", "m_sketch").mapInArrow(_near(similarity), "a long, b long"), "pairs")
    held = sets(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    sides = pairs.join(held.select(F.col("node").alias("b"), F.col("held").alias("y")), "b").join(held.select(F.col("node").alias("a"), F.col("held").alias("x")), "a")
    edges = materialise(sides.select("a", "b", "x", "y").mapInArrow(_verify(similarity), "a long, b long"), "links")
    roots = connected(edges)
    hot = materialise(_open_groups(found.where("kind = 'hot'").select("a", "b"), nodes, roots), "open")
    if not hot.isEmpty():
        placed = _placed(hot)
        placed = placed.join(nodes.select("node", "sketch"), "node")
        placed = materialise(placed.groupBy("pivot", "x", "y").applyInArrow(_partnered(similarity), placed.schema), "placed")
        placed = placed.join(sets(placed.select("node")), "node")
        more = materialise(placed.groupBy("pivot", "x", "y").applyInArrow(_forest(similarity), "a long, b long"), "links")
        edges = edges.union(more).distinct()
        roots = connected(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_tree_links"))
    own = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(degree, "node", "left")
    least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    own = own.join(least, "root").select("node", "component_id", "n_tree_links")
    joined = table.drop("sketch").join(own, "node", "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(linked, F.coalesce("n_tree_links", F.lit(0))).otherwise(0).alias("n_tree_links"))


def _count(buckets: int):
    """The distinct shingles of some texts, packed by bucket, and how many of those texts hold each; one that a single text holds has no number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            # by bucket, in each those of one text first
            place = (found % _U(buckets)).astype(np.int64) * 2 + (n > 1)
            order = np.argsort(place, kind="stable")
            found, n = found[order], n[order].astype(np.uint32)
            cuts = np.searchsorted(place[order], np.arange(2 * buckets + 1))
            full = np.flatnonzero(cuts[2::2] > cuts[:-1:2])
            blobs = [[x[cuts[k] : cuts[k + 1]].tobytes() for k in 2 * full + late] for x, late in ((found, 0), (found, 1), (n, 1))]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], ["bucket", "once", "more", "times"])

        for batch in batches:
            for _, own in _sets(batch.column(1)):
                held.append(own)
                waiting += len(own)
                if waiting >= COUNT_SHINGLES:
                    yield flush()
                    waiting = 0
        if waiting:
            yield flush()
        release()

    return run


def _frequent_of(least: int):
    """The shingles of a task's buckets that ``least`` texts or more hold, and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more, times = [], [], []
        for batch in batches:
            for into, column, kind in ((once, 1, _U), (more, 2, _U), (times, 3, np.uint32)):
                into += [np.frombuffer(x, kind) for x in batch.column(column).to_pylist()]
        if not once:
            return
        shingle = np.concatenate(once + more)
        n = np.concatenate([np.ones(sum(map(len, once)), np.uint32), *times])
        once.clear()
        more.clear()
        order = np.argsort(shingle)
        shingle = shingle[order]
        first = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]])) if len(shingle) else np.zeros(0, np.int64)
        n = np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        keep = n >= least
        yield pa.RecordBatch.from_arrays([pa.array(signed(shingle[first][keep])), pa.array(n[keep], pa.int64())], ["shingle", "n"])
        del shingle, n, order, first
        release()

    return run


def _frequent(rows: DataFrame, total: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that many texts share and their levels, counted over all texts; at most FREQUENT_SHARE times a text's mean."""
    least = max(FREQUENT_LEAST, total // FREQUENT_SHARE)
    buckets = partitions(rows.sparkSession, size // 6, REDUCE_WORDS)
    counted = rows.mapInArrow(_count(buckets), "bucket int, once binary, more binary, times binary").repartition(buckets, "bucket")
    found = counted.mapInArrow(_frequent_of(least), "shingle long, n long")
    found = found.select("shingle", F.least(1 + F.floor(F.log(F.col("n") / least) / F.log(F.lit(4.0))), F.lit(LEVELS)).cast("tinyint").alias("level"))
    with small_batches(rows.sparkSession):
        found = found.toArrow()
    shingle = unsigned(found.column(0).to_numpy())
    order = np.argsort(shingle)
    return shingle[order], found.column(1).to_numpy().astype(np.uint8)[order]
