import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from spanveil.llm import decontam, language, pii, queries, rlindex, toxicity

from .brute import held_out

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, keep_id string, n int"


def rows_of(name, columns, sf=SF):
    return duckdb.sql(f"select {columns} from '{sf}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(1, "Some Text", "x", 1), (2, "some text", None, 2), (2, "some text", "y", None), (3, None, "z", 1), (4, "", "z", 1), (None, "same text", "q", 0), (None, None, "q", 0), (5, "É", "", 1), (6, "12 34 +!", "", 1), (7, "word " * 50_000, "", 1)]
    return spark.createDataFrame(rows, DOCS)


def brute_repeats(docs, length=200):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    for d, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        yield d, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()


def test_suffix_order():
    rng = random.Random(1)
    for text in (b"banana", b"a" * 300, bytes(rng.choice(b"ab") for _ in range(400)), b"\0ab\0ab\0", b"x", b"\xff\0\xff\xff\0"):
        assert rlindex.suffix_order(np.frombuffer(text, np.uint8)).tolist() == sorted(range(len(text)), key=lambda k: text[k:])


def test_run_length_index_matching_statistics():
    rng = random.Random(2)
    one, two = (bytes(rng.choice(b"abcd") for _ in range(30)) for _ in range(2))
    # a part that holds what two others make with a NUL between them
    assert [x.tolist() for x in rlindex.repeated_windows([one, two, one[10:] + b"\0" + two[:20]], 12)][2] == [*range(9), *range(21, 30)]
    for alphabet in (b"abc", b"a\0") * 15:
        base = bytes(rng.choice(alphabet) for _ in range(40))
        parts = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(30))) + base[rng.randrange(20) :] for _ in range(5)]
        seen = Counter(p[k : k + 12] for p in parts for k in range(len(p) - 11))
        want = [[k for k in range(len(p) - 11) if seen[p[k : k + 12]] > 1] for p in parts]
        assert [x.tolist() for x in rlindex.repeated_windows(parts, 12)] == want


@pytest.mark.parametrize("hot", [4096, 3])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(rlindex, "ANCHOR_SEGMENTS", hot)
    rng = random.Random(3)
    words = ["alpha", "béta", "γ", "delta", "e", "zeta!", "eta\n"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(n))
    passage, docs = text(60), []
    for _ in range(40):
        docs.append(text(rng.randrange(120)) + (passage[rng.randrange(90) :] if rng.random() < 0.5 else "") + text(rng.randrange(60)))
    docs += [docs[0], docs[1] + "x", "a" * 450, "ab" * 120, docs[2][:150], "a" * 199, None, "", docs[3] + docs[3]]
    docs = list(enumerate(docs))
    got = rlindex.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), with_text=True).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(brute_repeats(docs))


def test_suffix_dedup_real_long_and_odd_rows(spark, odd_docs, monkeypatch):
    docs = rows_of("documents", "doc_id, text")
    assert sorted(map(tuple, queries.op1_suffix_dedup(spark, SF).collect())) == sorted(brute_repeats(docs))
    odd = {(r.doc_id, r.n_bytes): r for r in rlindex.remove_repeats(odd_docs).collect()}
    assert len(odd) == 9 and odd[7, 250_000].n_removed == 250_000 and odd[3, 0].n_spans == 0
    assert rlindex.remove_repeats(odd_docs.limit(0)).count() == 0
    monkeypatch.setattr(rlindex, "STRETCH", 500)
    assert sorted(map(tuple, rlindex.remove_repeats(spark.createDataFrame(docs[:60], "doc_id long, text string")).collect())) == sorted(brute_repeats(docs[:60]))


def test_decontamination_matches_brute_force(spark):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    items = rows_of("benchmark", "item_id, text")
    docs = dict(rows_of("documents", "doc_id, text"))
    rng = random.Random(4)
    for k in range(40):  # planted, some with changes
        own = words(items[k % len(items)][1])
        for _ in range(k % 4):
            own[rng.randrange(len(own))] = "changed"
        docs[10_000 + k] = " ".join(words(docs[k])[:80] + own + ["tail"] * (k % 3))
    docs |= {20_000: None, 20_001: "", 20_002: items[3][1], 20_003: " ".join(words(items[4][1])[:-2])}
    want = {}
    for d, t in docs.items():
        w = words(t)
        for i, item in items:
            own = grams(words(item))
            n = len(words(item))
            if not w or sum(g in own for g in grams(w)) < 3:
                continue
            for s in range(max(1, len(w) - n + 1)):
                got = grams(w[s : s + n])
                shared = sum((got & own).values())
                sim = shared / (got.total() + own.total() - shared)
                if sim >= 0.75 and sim > want.get((d, i), (0,))[0]:
                    want[d, i] = (sim, s, min(n, len(w)))
    df = spark.createDataFrame([*docs.items(), (None, items[0][1])], "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as words")
    bench = spark.createDataFrame([*items, (None, "a b c d e f"), (99_999, None)], "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_words) for r in decontam.contaminated_windows(df, bench).collect()}
    assert got == want and len(want) > 15
    assert decontam.contaminated_windows(df.limit(0), bench).count() == 0 and decontam.contaminated_windows(df, bench.limit(0)).count() == 0


def test_short_items_are_found_within_texts(spark):
    items = [(1, "capital of France"), (2, "42"), (3, "x y z w"), (4, "one two three four five six")]
    docs = [(1, "the Capital of france is"), (2, "it is 42, 42"), (3, "x y z"), (4, "x y z w"), (5, ""), (6, None), (7, "one two three four five six")]
    found = decontam.contaminated_windows(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.similarity, r.start, r.n_words) for r in found} == {(1, 1, 1.0, 1, 3), (2, 2, 1.0, 2, 1), (4, 3, 1.0, 0, 4), (7, 4, 1.0, 0, 6)}


def test_decontamination_plan_is_native(spark):
    df = queries.op4_decontamination(spark, SF)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_decontamination_plan_stays_small(spark):
    """The driver plans a query anew after each of its stages: 64 sums and conditions in the last one took its memory."""
    name = "spark.sql.debug.maxToStringFields"
    spark.conf.set(name, "100000")
    try:
        assert len(queries.op4_decontamination(spark, SF)._jdf.queryExecution().optimizedPlan().toString()) < 8000
    finally:
        spark.conf.unset(name)


def test_fingerprints_match_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, rng.getrandbits(64) - (1 << 63), rng.choice([1, 1, 2, 2**20])) for k in range(20) for _ in range(rng.choice([1, 2, 7, 40]))]
    rows += [(20, -1, 1), (20, 0, 1), (21, -1, 2**31 - 1), (22, 1 << 31, 3), (22, -(1 << 63), 2), (23, 0, 5)]
    want = {}
    for key in {k for k, _, _ in rows}:
        own = [(s, w) for k, s, w in rows if k == key]
        value = sum(1 << b for b in range(64) if sum(w if s >> b & 1 else -w for s, w in own) > 0)
        want[key] = value - (value >> 63 << 64)
    got = decontam.fingerprints(spark.createDataFrame(rows, "k long, shingle long, weight long"), ["k"])
    assert {r.k: r.fingerprint for r in got.collect()} == want


def test_language_held_out(spark, odd_docs):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op6_language(spark, sf).collect()}
    rows = rows_of("documents", "doc_id, lang, text", sf)
    held = [(got[d].lang_pred, lang) for d, lang, _ in rows if held_out(d)]
    assert sum(a == b for a, b in held) / len(held) > 0.97 and len(got) == len(rows)
    assert all(got[d].held_out == held_out(d) and 0 <= got[d].score <= 1 for d, _, _ in rows)
    odd = language.identify(odd_docs.selectExpr("*", "case when doc_id <> 3 then 'aa' end as lang")).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in odd if r.doc_id in (1, 3, 4, 6)) == [(1, "aa"), (3, "und"), (4, "und"), (6, "und")]
    assert all(r.lang_pred == "und" for r in language.identify(odd_docs.selectExpr("*", "cast(null as string) as lang")).collect())
    assert language.identify(odd_docs.limit(0).selectExpr("*", "'a' as lang")).count() == 0


def test_language_parts_have_few_texts():
    import pyarrow as pa

    texts = [None, ""] + [f"t{k}" for k in range(3000)] + ["x" * (1 << 21)] + ["y"] * 5
    parts = list(language._parts(pa.array(texts)))
    assert [t for _, _, own in parts for t in own] == [t or "" for t in texts] and max(hi - lo for lo, hi, _ in parts) <= language.TEXTS
    assert [lo for lo, _, _ in parts] == [0, *(hi for _, hi, _ in parts[:-1])]


def test_language_vectors_match_definition():
    texts = ["Ab, c", "", "ééa"]
    codes, row, trigram, count, known = language.trigram_counts(texts)
    got = language.bundle(language.Letters(), codes, row, trigram, count, 3)
    vector = lambda c, turn: np.roll(language.letter_vector(ord(c)), turn)
    for k, t in enumerate((" ab c ", "", " ééa ")):
        want = sum((vector(t[i], 2) * vector(t[i + 1], 1) * vector(t[i + 2], 0) for i in range(len(t) - 2)), np.zeros(language.DIMENSIONS))
        assert np.array_equal(got[k], want)
    assert known.tolist() == [True, False, True]


def test_levenshtein_automaton_matches_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            new = [row[0] + 1]
            for k, y in enumerate(b):
                new.append(min(new[-1] + 1, row[k + 1] + 1, row[k] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(7)
    lexicon = {"".join(rng.choice("abc") for _ in range(rng.randrange(5, 9))): 1.0 for _ in range(60)}
    trie = toxicity.LexiconTrie(lexicon, {}, frozenset(lexicon))
    for _ in range(500):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(3, 10)))
        near = [w for w in lexicon if distance(word, w) <= 1]
        best = min(near, key=lambda w: (distance(word, w), w), default=None)
        assert trie.near(word) == best
        assert (trie.find(word) is not None) == (best is not None and (len(word) >= toxicity.FUZZY_LENGTH or word in lexicon))


def test_toxicity_held_out_misspelled_and_odd(spark, odd_docs):
    sf = "/root/testdata/sf0.1"
    labels = rows_of("labels", "doc_id, toxic", sf)
    got = {r.doc_id: r for r in queries.op8_toxicity(spark, sf).collect()}
    held = [(got[d].predicted, y) for d, y in labels if held_out(d)]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    docs, table = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, table)
    bad, fixed, clean = model.scores(["you pathetc idiott", "you pathetic idiot", "the thing on the other"])
    assert bad > 0.5 and fixed > 0.5 and clean < 0.5
    quoted, direct = model.features('he said "idiot" to them'), model.features("you idiot!")
    assert quoted[2] > direct[2] and direct[3] > quoted[3]
    assert {r.kind for r in toxicity.explain(spark.createDataFrame([(1, "x idiott"), (2, None)], "doc_id long, text string"), model).collect()} == {"fuzzy"}
    odd = toxicity.toxicity_scores(odd_docs, spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int")).collect()
    assert len(odd) == 10 and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.toxicity_scores(odd_docs.limit(0), table.limit(0)).count() == 0


def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0
    for kind, pattern, ok in ((2, r"[0-9]([\x20-]?[0-9])+", lambda d: 12 <= len(d) <= 19 and luhn(d)), (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda d: 9 <= len(d) <= 15)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if ok(re.sub("[^0-9]", "", m[0]))]
    return sorted(out)


def test_pii_long_runs(spark):
    zeros = "0" * 5000
    text = f"{zeros}1.2.3.4 and {zeros}9.{zeros}300.1.1 " + "a@b.cc " * 3000
    spans = pii.base_spans(text)
    assert spans[0] == (0, 1, 5007) and len(spans) == 3001
    assert pii.personal_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().n_ip == 1


def test_pii_base_matches_patterns(spark):
    rng = random.Random(8)
    pieces = ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111-1111 1111", "+1 (555) 222-3333", "x", " ", "-", "12", "é", "..", "%+", "a@b", "0", "+", "1.2.3.4.5.6.7.8"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == brute_base(text), text
    got = {r.doc_id: r for r in queries.op10_pii(spark, "/root/testdata/sf0.01").collect()}
    for d, text in rows_of("documents", "doc_id, text", "/root/testdata/sf0.01"):
        own = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_base(text))
        assert got[d].base_sha256 == hashlib.sha256(own.encode()).hexdigest() and set(filter(None, own.split(","))) <= set(got[d].spans.split(","))


def test_pii_terms_disclose(spark, odd_docs):
    rng = random.Random(9)
    filler = lambda n: " ".join(f"common{chr(97 + rng.randrange(20))}" for _ in range(n))
    docs = [(k, f"{filler(12)} zanzibar clockmaker {filler(2)} jo@x.org {filler(9)}") for k in range(6)] + [(k, filler(30)) for k in range(6, 60)]
    docs += [(60 + k, f"{filler(9)} k{k}@x.org {filler(4)}") for k in range(5)] + [(70, "+1 555 222 3333 +1 555 222 3333"), (71, "a +1 555 222 3333")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_spans(df).collect()}
    for d, text in docs[:6]:
        at = text.index("zanzibar")
        assert f"term:{at}:{at + 8}" in got[d].spans and "common" not in {text[int(s):int(e)][:6] for _, s, e in (x.split(":") for x in got[d].spans.split(","))}
    assert all(got[d].spans == got[d].base for d in got if d >= 6)
    clean = {r.doc_id: r.sanitised for r in pii.sanitise(df.withColumn("spans", df.doc_id)).collect()}
    assert "<TERM> <TERM>" in clean[0] and "<EMAIL>" in clean[0] and "zanzibar" not in clean[0] and clean[7] == dict(docs)[7]
    assert "<TERM>" not in {r.sanitised for r in pii.sanitise(df, remove_terms=True).collect()}.pop()
    twice = spark.createDataFrame([(None, "mail jo@x.org"), (1, "to ann@yy.org now"), (1, "call +1 555 222 3333"), (1, "call +1 555 222 3333"), (2, None)], "doc_id long, text string").selectExpr("*", "1 as span_id", "2 as span_list")
    assert sorted(r.sanitised for r in pii.sanitise(twice, disclosure=2.0).collect()) == ["", "call <PHONE>", "call <PHONE>", "mail <EMAIL>", "to <EMAIL> now"]
    assert pii.personal_spans(odd_docs).count() == 10 and pii.personal_spans(odd_docs.limit(0)).count() == 0


def test_pii_terms_of_entities_in_one_or_two_texts(spark):
    rng = random.Random(11)
    filler = lambda n: " ".join(f"common{chr(97 + rng.randrange(20))}" for _ in range(n))
    docs = [(0, f"Zanzibar {filler(60)} jo@x.org {filler(60)} clockmaker zanzibar"), (1, f"{filler(50)} lighthouse {filler(20)} 10.1.2.3 {filler(30)}"), (2, f"10.1.2.3 {filler(70)} lighthouse"), (3, f"{filler(40)} saddler@y.org saddler")]
    docs += [(k, filler(40)) for k in range(4, 60)]
    got = {r.doc_id: r for r in pii.personal_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    terms = {d: [text[int(s) : int(e)] for k, s, e in (x.split(":") for x in filter(None, got[d].spans.split(","))) if k == "term"] for d, text in docs}
    assert terms == {d: {0: ["Zanzibar", "clockmaker", "zanzibar"], 1: ["lighthouse"], 2: ["lighthouse"], 3: ["saddler"]}.get(d, []) for d, _ in docs}


def test_toxicity_misspelled_terms_of_a_small_table(spark):
    docs, table = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, table)
    assert {"trash", "idiot", "scum", "clown"} <= model.firm
    assert [[(k, kind) for k, kind, _ in model.hits(t)] for t in ("you idiott", "a clwn", "you scumm", "scm", "the thing")] == [[(4, "fuzzy")], [(2, "fuzzy")], [(4, "fuzzy")], [(0, "fuzzy")], []]
    bad, clean = model.scores(["you pathetc idiott", "the thing on the other"])
    assert bad > 0.5 > clean


def test_decontamination_of_items_that_repeat_a_phrase(spark):
    item = "one two three four five " * 6 + "red green blue white black grey pink gold teal plum"
    own = item.split()
    docs = [(1, " ".join(["tail"] * 30 + own[:-4] + ["w1", "w2", "w3", "w4"])), (2, " ".join(own)), (3, " ".join(own[:12] + ["x"] * 28))]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {(r.doc_id, r.similarity, r.start) for r in decontam.contaminated_windows(*frames).collect()}
    assert got == {(1, 32 / 40, 26), (2, 1.0, 0)}


def test_pii_terms_match_brute_force(spark):
    import math

    docs = rows_of("documents", "doc_id, text")
    held = {d: {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t or "")} for d, t in docs}
    n_texts = Counter(w for own in held.values() for w in own)
    surface = lambda k, s: s.lower() if k == 0 else s if k == 1 else re.sub("[^0-9]", "", s)
    entities = {d: {(k, surface(k, t[s:e])) for s, k, e in brute_base(t or "")} for d, t in docs}
    n_entity = Counter(e for own in entities.values() for e in own)
    n_both = Counter((e, w) for d, own in entities.items() for e in own for w in held[d])
    tells = lambda e, w: 1 - math.log(min(1, n_both[e, w] / n_texts[w])) / math.log(min(0.5, n_entity[e] / len(docs))) >= 0.9 - 1e-12
    got = {r.doc_id: r.spans for r in pii.personal_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = 0
    for d, t in docs:
        base = brute_base(t or "")
        told = {w for w in held[d] if any(tells(e, w) for e in entities[d])}
        terms = [(m.start(), 4, m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t or "") if m[0].lower() in told and not any(s < m.end() and m.start() < e for s, _, e in base)]
        found += len(terms)
        want = ",".join(f"{(*pii.KINDS, 'term')[k]}:{s}:{e}" for s, k, e in sorted(base + terms))
        assert got[d] == want, d
    assert found > 1000
