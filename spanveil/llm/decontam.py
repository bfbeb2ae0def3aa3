"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

Texts and items become words (runs of letters and digits, lower-cased) and
five-word shingles.  A window as long as an item is fingerprinted where the
item's shingles it holds have at least the share of the item's weight that the
similarity demands: the shared weight is at most theirs, so no other window can
reach it.  Each such window gets a 64-bit SimHash of its weighted shingles.
Fingerprints within ``RADIUS`` agree in one of ``RADIUS`` + 1 blocks at least,
so a pair with no equal block is out; Hamming distance and then the exact
weighted Jaccard similarity of the shingles decide.  At a similarity of 0.75
fingerprints differ in 11 bits of 64 on average, so the radius must be wide and
the blocks are of two or three bits: as an index they would pair all windows
with all items of their length.  So pairs come from the shingles, and blocks and
radius sift them.

Items of under five words have one shingle, so a window is as similar only if it
is the item: they are met by the hash of the whole window, at any place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SHINGLE = 5
SIMILARITY = 0.75
RADIUS = 23
#: Shingles of items up to which the items are broadcast; beyond, they are joined by shuffle.
BROADCAST_SHINGLES = 1 << 19


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words; of no words, an empty array."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: str) -> Column:
    """Shingle hashes of a column of word hashes, by place; a shorter text's sequence is one shingle."""
    at = lambda k, n: F.get(F.col(words), k + n)
    full = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda k: F.xxhash64(*[at(k, n) for n in range(SHINGLE)]))
    whole = F.array(F.xxhash64(F.array_join(F.col(words), " "), F.size(words)))
    return F.when(F.size(words) >= SHINGLE, full).when(F.size(words) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def _by_size(df: DataFrame, shingles: int) -> DataFrame:
    return F.broadcast(df) if shingles <= BROADCAST_SHINGLES else df


def fingerprints(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """64-bit SimHash, over each group of ``keys``, of rows (*keys, shingle, weight): bit b is the sign of the weights' sum.

    Halves of one long have the weights of the shingles with bit b and with bit
    b + 32: a group's weights, the shingles of one text, add up to less than 2**31.
    """
    pair = lambda b: F.sum(F.shiftrightunsigned("shingle", b).bitwiseAND(F.lit(1 << 32 | 1)) * F.col("weight"))
    sums = shingles.groupBy(*keys).agg(F.sum("weight").alias("total"), *[pair(b).alias(f"b{b}") for b in range(32)])
    bits = "transform(pairs, (p, b) -> if(2 * (p & 4294967295L) > total, shiftleft(1L, b), 0L) | if(2 * shiftrightunsigned(p, 32) > total, shiftleft(1L, b + 32), 0L))"
    sums = sums.select(*keys, "total", F.array(*[f"b{b}" for b in range(32)]).alias("pairs"))
    return sums.select(*keys, F.expr(f"aggregate({bits}, 0L, (a, x) -> a | x)").alias("fingerprint"))


def hamming_blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """Array of (block, value): radius + 1 disjoint runs of the 64 bits."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    blocks = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")).alias("value")) for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    return F.array(*blocks)


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): the best window of each document for each item it holds.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text.  start and
    n_words count words; of windows of one similarity the first is taken.  Texts
    and items that are null or without words match nothing, as do rows with a
    null id.  A document with fewer words than an item is one window.  Items of
    under five words match wherever their words stand in a row.  Repeated rows give one result; a doc_id with several texts is
    judged by each.  Empty tables give an empty result; other columns are
    ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("words")).where("item_id is not null and size(words) > 0")
    items = materialise(items, "item_words")
    brief = items.where(F.size("words") < SHINGLE)
    items = items.where(F.size("words") >= SHINGLE).select("item_id", F.size("words").alias("item_words"), F.explode(shingle_hashes("words")).alias("shingle"))
    items = materialise(items.groupBy("item_id", "item_words", "shingle").agg(F.count("*").alias("weight")), "items")
    sizes = items.groupBy("item_id", "item_words").agg(F.sum("weight").alias("item_total"))
    n = items.count()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(F.col("text")).alias("words")).where("doc_id is not null and size(words) > 0")
    seeds = rows.select("doc_id", F.posexplode(shingle_hashes("words")).alias("place", "shingle")).join(_by_size(items.select("item_id", "shingle", "weight"), n), "shingle")
    # a window as similar as asked holds shingles of that share of the item's weight
    seeds = materialise(seeds.select("doc_id", "item_id", "shingle", "weight", "place"), "seeds")
    held = seeds.select("doc_id", "item_id", "shingle", "weight").distinct().groupBy("doc_id", "item_id").agg(F.sum("weight").alias("held"))
    held = held.join(_by_size(sizes, n), ["item_id"]).where(F.col("held") >= similarity * F.col("item_total"))
    held = materialise(held.select("doc_id", "item_id", "item_words", "item_total"), "held")

    named = held.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(named, "doc_id", "left_semi")
    texts = texts.select("doc_id", word_hashes(F.col("text")).alias("words"))
    texts = materialise(texts.select("doc_id", F.size("words").alias("doc_words"), shingle_hashes("words").alias("shingles")).distinct(), "texts")

    # every start at which the window holds enough seeds of the item
    kept = seeds.join(held, ["doc_id", "item_id"]).select("doc_id", "item_id", "item_words", "item_total", "place", "shingle", "weight")
    reach = F.greatest(F.col("item_words") - SHINGLE, F.lit(0))
    starts = kept.select("doc_id", "item_id", "item_words", "item_total", "shingle", "weight", F.explode(F.sequence(F.greatest(F.col("place") - reach, F.lit(0)), F.col("place"))).alias("start"))
    starts = starts.distinct().groupBy("doc_id", "item_id", "item_words", "item_total", "start").agg(F.sum("weight").alias("held"))
    starts = materialise(starts.where(F.col("held") >= similarity * F.col("item_total")).select("doc_id", "item_id", "item_words", "start"), "starts")
    windows = starts.select("doc_id", "item_words", "start").distinct().join(texts, "doc_id")
    span = F.greatest(F.col("item_words") - SHINGLE + 1, F.lit(1))
    # past the end a window would be another's part; the last whole one has those shingles
    windows = windows.where(F.col("start") <= F.greatest(F.col("doc_words") - F.col("item_words"), F.lit(0)))
    windows = windows.select("doc_id", "item_words", "start", "doc_words", F.slice("shingles", F.col("start") + 1, span).alias("shingles"))
    keys = ["doc_id", "item_words", "start", "doc_words"]
    parts = windows.select(*keys, F.explode("shingles").alias("shingle")).groupBy(*keys, "shingle").agg(F.count("*").alias("weight"))
    parts = materialise(parts, "windows")

    # only pairs that the weight bound allows: those of which a block agrees, then those within the radius;
    # written on their own, since the driver plans a query anew after each of its stages
    marks = materialise(fingerprints(parts, keys), "marks").join(starts, ["doc_id", "item_words", "start"])
    item_marks = materialise(fingerprints(items, ["item_id"]).select("item_id", F.col("fingerprint").alias("item_print")), "item_marks")
    near = marks.join(_by_size(item_marks, n), "item_id").where(F.arrays_overlap(hamming_blocks(F.col("fingerprint"), radius), hamming_blocks(F.col("item_print"), radius)))
    near = near.where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= radius).select(*keys, "item_id").distinct()
    near = materialise(near, "near")

    both = near.join(parts, keys).join(_by_size(items.select("item_id", "shingle", F.col("weight").alias("item_weight")), n), ["item_id", "shingle"], "left")
    weights = items.groupBy("item_id").agg(F.sum("weight").alias("item_total"))
    both = both.groupBy("item_id", *keys).agg(F.sum(F.least("weight", F.coalesce("item_weight", F.lit(0)))).alias("shared"), F.sum("weight").alias("total"))
    both = both.join(_by_size(weights, n), "item_id").withColumn("similarity", F.col("shared") / (F.col("total") + F.col("item_total") - F.col("shared")))
    best = both.where(F.col("similarity") >= similarity).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), F.least("doc_words", "item_words").alias("n_words"))).alias("best"))
    best = best.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start"), F.col("best.n_words").alias("n_words"))
    return best.unionByName(_brief_windows(rows, brief))


def _brief_windows(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The first place of each item of under five words in each of ``rows`` (doc_id, words)."""
    lengths = sorted(r[0] for r in items.select(F.size("words")).distinct().collect())  # one to four
    marked = items.select("item_id", F.size("words").alias("n_words"), F.xxhash64("words").alias("window"))
    places = lambda n: F.transform(F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.lit(n).alias("n_words"), F.xxhash64(F.slice("words", k + 1, F.lit(n))).alias("window"), k.alias("start")))
    if not lengths:
        return rows.limit(0).select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(1.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).alias("n_words"))
    each = rows.select("doc_id", F.inline(F.concat(*map(places, lengths))))
    found = each.join(_by_size(marked, items.count()), ["n_words", "window"])
    return found.groupBy("doc_id", "item_id").agg(F.lit(1.0).alias("similarity"), F.min("start").alias("start"), F.first("n_words").alias("n_words"))
