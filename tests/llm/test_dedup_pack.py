import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from spanveil.llm import cuckoo, packing, parity, queries, quality, warc
from spanveil.llm.common import scratch_path

from .brute import components, held_out

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, keep_id string, n int"


def rows_of(name, columns, sf=SF):
    return duckdb.sql(f"select {columns} from '{sf}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(1, "Same Text", "x", 1), (2, "same text", None, 2), (2, "same text", "y", None), (3, None, "z", 1), (4, "", "z", 1), (None, "same text", "q", 0), (None, None, "q", 0), (5, "É", "", 1), (6, "é", "", 1), (7, "word " * 50_000, "", 1)]
    return spark.createDataFrame(rows, DOCS)


def test_cuckoo_index_inserts_deletes_and_resizes():
    index, keys = cuckoo.CuckooIndex(2), [hashlib.sha256(str(k).encode()).digest() for k in range(5000)]
    for k, key in enumerate(keys):
        index.add(key, k, 1)
    assert index.resizes and index.size == 5000 and all(index.get(key) == [k, 1] for k, key in enumerate(keys))
    assert all(index.delete(key) for key in keys[::2]) and not index.delete(keys[0])
    assert index.size == 2500 and all((index.get(key) is None) == (k % 2 == 0) for k, key in enumerate(keys))


def test_exact_dedup_odd_rows(odd_docs):
    got = {(r.doc_id, r.text_sha256): r for r in cuckoo.exact_dedup(odd_docs).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    same = sha("same text")
    assert got[2, same].group_size == 4 and got[1, same].keep_id == 2 and got[2, same].kept and not got[None, same].kept
    assert got[4, sha("")].group_size == 3 and got[3, sha("")].keep_id == 4
    assert got[5, sha("É")].kept and got[6, sha("é")].kept
    assert cuckoo.exact_dedup(odd_docs.limit(0)).count() == 0


def test_exact_dedup_stops_where_content_differs(spark):
    texts = spark.createDataFrame([("a",), ("A",), ("b",)], "text string")
    sha = lambda s: hashlib.sha256(s).digest()
    groups = spark.createDataFrame([(bytearray(sha(b"a")), 1, 2)], "digest binary, keep_id long, group_size long")
    assert cuckoo.verified(texts, groups).count() == 1
    # a digest that two texts share, as if the hash had failed
    def same(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sha(b"a")] * len(b), pa.binary()), b.column(0).cast(pa.binary())], ["digest", "low"])

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(cuckoo, "_shared", lambda wanted: same)
        with pytest.raises(Exception, match="texts of one digest differ"):
            cuckoo.verified(texts, groups).collect()


def test_exact_dedup_retires(spark, odd_docs):
    gone = spark.createDataFrame([(2,)], "doc_id long")
    got = {(r.doc_id, r.text_sha256[:4]): r for r in cuckoo.exact_dedup(odd_docs, gone).collect()}
    same = hashlib.sha256(b"same text").hexdigest()[:4]
    assert got[1, same].kept and got[1, same].group_size == 2 and not got[2, same].kept


def test_warc_round_trip(spark):
    long = "x" * 1000
    rows = [(1, "u", long, 9), (2, None, long, 9), (2, None, long, 8), (3, "a\r\nb", "short", 7), (4, "v", "short", 7), (5, "w", None, 6), (None, "w", long, 6)]
    path = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string, sha256 int"), scratch_path(spark, "t"))
    got = [r for r in warc.read_archive(spark, path).collect()]
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None)]
    for r in got:
        assert r.payload_bytes == len(r.payload) and r.payload_digest == hashlib.sha1(r.payload).hexdigest()
        head = bytes(r.warc_header).decode()
        assert re.search(r"WARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n", head)
        assert head.startswith("WARC/1.1\r\n") and head.endswith("\r\n\r\n")
        block = bytes(r.record)[len(r.warc_header) : -4]
        assert f"Content-Length: {len(block)}\r\n" in head
        assert block == bytes(r.http_header) + (bytes(r.payload) if r.record_type == "response" else b"")
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    out = scratch_path(spark, "files")
    warc.export_warc(spark, path, out)
    text = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(out + "/*.gz").collect())
    import gzip

    assert len(gzip.decompress(text)) == sum(len(r.record) for r in got)
    empty = warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), scratch_path(spark, "t"))
    assert warc.read_archive(spark, empty).count() == 0


def _similar(rng, words, n, changes):
    out = list(words)
    for _ in range(changes):
        k = rng.randrange(len(out))
        rng.choice((lambda: out.__setitem__(k, f"n{rng.random()}"), lambda: out.pop(k), lambda: out.insert(k, f"i{rng.random()}")))()
    return " ".join(out)


def test_parity_join_matches_brute_force(spark):
    rng, docs = random.Random(5), []
    shared = " ".join(f"boiler{k}" for k in range(12))
    for base in range(40):
        words = [rng.choice(["the", "a", f"w{rng.randrange(3000)}"]) for _ in range(rng.choice([3, 5, 8, 20, 60, 70, 200, 260, 1200]))]
        for _ in range(rng.choice([1, 2, 3, 30])):
            docs.append(_similar(rng, words, 1, rng.randrange(1 + len(words) // 12)))
        docs.append(" ".join(words[:20]) + " " + shared)
    docs += ["", None, "  ", "one", "ONE", docs[0].upper()]
    docs = list(enumerate(docs))
    want = components(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity.similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_frequent_shingles_are_counted_over_all_texts(spark, monkeypatch):
    """The frequent shingles and their levels by brute force, however many texts there are."""
    monkeypatch.setattr(parity, "FREQUENT_SHARE", 50)
    rng = random.Random(3)
    lines = [" ".join(f"w{rng.randrange(90)}" for _ in range(9)) for _ in range(12)]
    texts = [" ".join(rng.choice(lines[: 1 + k % 12]) for _ in range(rng.randint(0, 5))) + f" own{k % 400} words of text {k}" for k in range(1500)]
    texts += [None, "", "one", lines[0]]
    held = {}
    for _, own in parity._sets(pa.array(texts)):
        for shingle in own.tolist():
            held[shingle] = held.get(shingle, 0) + 1
    least = len(texts) // 50
    want = {x: min(1 + int(np.log(n / least) / np.log(4.0)), parity.LEVELS) for x, n in held.items() if n >= least}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    shingle, level = parity._frequent(rows, len(texts), sum(len(t or "") for t in texts))
    assert dict(zip(shingle.tolist(), level.tolist(), strict=True)) == want and len(set(want.values())) > 1
    assert (np.diff(shingle.view(np.int64)) != 0).all() and (shingle[1:] > shingle[:-1]).all()


def test_parity_join_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(parity, "DIRECT", 3)
    monkeypatch.setattr(parity, "BLOCK", 16)
    rng, docs = random.Random(6), []
    base = [f"w{k}" for k in range(90)]
    for group in range(6):  # chains of ever more changes: neighbours link, ends don't
        words = list(base)
        for step in range(14):
            words = words[: 3 * step] + [f"g{group}s{step}x{k}" for k in range(3)] + words[3 * step + 3 :]
            docs.append(" ".join(words))
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity.similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == components(docs)


def test_parity_join_real_and_odd_rows(spark, odd_docs):
    docs = rows_of("documents", "doc_id, text")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_parity_join(spark, SF).collect()}
    assert got == components(docs)
    odd = parity.similar_components(odd_docs).collect()
    assert len(odd) == 10 and sorted((r.doc_id, r.component_id) for r in odd if r.doc_id) == [(1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7)]
    assert all(r.component_id is None for r in odd if r.doc_id is None)
    assert parity.similar_components(odd_docs.limit(0)).count() == 0


def test_packing(spark, odd_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    tokenizer.encode_special_tokens = True
    texts = dict(rows_of("documents", "doc_id, text"))
    pieces = queries.op7_packing(spark, SF).toPandas()
    places, sums = {}, {}
    for p in pieces.sort_values(["doc_id", "start"]).itertuples():
        assert p.start == sums.get(p.doc_id, 0) and 0 < p.length <= 4096
        sums[p.doc_id] = p.start + p.length
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for d, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        own = pieces[pieces.doc_id == d]
        assert sums[d] == len(ids) and (own.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32))
    pad = 0
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
        pad += packing.padding(at)
    assert pad < 4096 + 0.01 * sum(sums.values())  # the last sequence, and little else
    odd = packing.pack(odd_docs, queries.tokenizer_path()).toPandas()
    assert (odd[odd.doc_id.isin([3, 4])].length == 1).all() and odd.groupby("sequence_id").length.sum().max() <= 4096
    assert packing.pack(odd_docs.limit(0), queries.tokenizer_path()).count() == 0


def test_packing_ids_of_odd_texts():
    ids = packing.WordIds(queries.tokenizer_path())
    texts = ["", "  a  b\t\nc", "it's 12,5 €uro İ ǅ ﬁ Σας ΣΑΣ", "é ́x", "<|endoftext|> a<|startoftext|>b", "日本語 テキスト", "a\x00b \x85 c\xa0d \x1c", "don't WE'LL", "ab" * 4000, "ǄǅßÄé—–“x”"]
    got, at = ids(pa.array(texts, pa.large_string()))
    for k, text in enumerate(texts):
        assert got[at[k] : at[k + 1]].tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids, text
    # forgetting, also of nothing, changes no ids
    for some in (texts[:2], [], texts[2:]):
        ids.shrink()
        got, at = ids(pa.array(some, pa.large_string()))
        assert [got[at[k] : at[k + 1]].tolist() for k in range(len(some))] == [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    ids(pa.array([], pa.large_string()))
    ids.shrink()
    assert len(ids(pa.array(["a b"], pa.large_string()))[0]) == 2


@pytest.mark.parametrize("histogram", [{10: 1000, 4000: 3}, {1: 9000}, {4096: 5}, {2049: 7, 2047: 7}, {}])
def test_pack_histogram_places_all(histogram):
    patterns = packing.pack_histogram(histogram)
    placed = {}
    for often, pattern in patterns:
        assert sum(a * b for a, b in pattern) <= 4096
        for length, many in pattern:
            placed[length] = placed.get(length, 0) + often * many
    assert placed == histogram


def test_quality_held_out_accuracy(spark, odd_docs):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op2_quality(spark, sf).collect()}
    labels = rows_of("labels", "doc_id, quality", sf)
    held = [(got[d].predicted, y) for d, y in labels if held_out(d)]
    assert all(got[d].held_out == held_out(d) for d, _ in labels)
    assert sum(a == b for a, b in held) / len(held) > 0.97
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (7, 0)], "doc_id long, quality int")
    odd = quality.quality_scores(odd_docs, labels).collect()
    assert len(odd) == 10 and all(0 <= r.score <= 1 for r in odd)
    assert all(r.score == 0.5 for r in quality.quality_scores(odd_docs, labels.limit(0)).collect())
