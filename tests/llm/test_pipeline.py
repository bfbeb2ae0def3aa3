"""Each stage of the pipeline against brute force, on rows with null and repeated ids, and the whole of it."""

import random
import re
from collections import Counter

import corpus_pipeline
import duckdb
import pytest

from spanveil.llm import quality

from .brute import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, __row string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, f"l{k}", "x") for k, (d, t) in enumerate(rows)], DOCS)


def kept(df):
    assert df.columns == ["doc_id", "text", "lang", "__row"]
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()
    rng = random.Random(3)
    more = [(5, "same"), (9, "Same"), (5, "unique text"), (7, "twin"), (7, "twin"), (None, "SAME"), (None, "alone here"), (None, None), (3, None), (4, ""), (8, "w " * 60_000)]
    near = []
    for d, t in docs[:12]:
        words = (t or "").split()
        if len(words) > 60:
            words[rng.randrange(len(words))] = "changed"
            near.append((rng.choice([None, 2000 + d]), " ".join(words)))
    return docs + more + near


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_dedup_stage(spark, rows):
    best = {}
    for d, t in rows:
        low = lowered(t)
        if low not in best or (d is not None and (best[low] is None or d > best[low])):
            best[low] = d
    got = kept(corpus_pipeline.exact_dedup_stage(spark, frame(spark, rows), SF))
    assert sorted(((d, lowered(t)) for d, t in got), key=str) == sorted(((d, low) for low, d in best.items()), key=str)
    assert (5, "unique text") in got and sum(t == "twin" for _, t in got) == 1


def test_near_dedup_stage(spark, rows):
    rows = list(dict.fromkeys(rows))
    by = components(list(enumerate(t for _, t in rows)))
    groups = {}
    for k, (d, t) in enumerate(rows):
        groups.setdefault(by[k][1], []).append((d is None, d or 0, t))
    got = kept(corpus_pipeline.near_dedup_stage(spark, frame(spark, rows), SF))
    assert len(got) == len(groups) < len(rows)
    firsts = {(min(g)[:2]) for g in groups.values()}
    assert {(d is None, d or 0) for d, _ in got} == firsts and set(got) <= set(rows)


def test_decontamination_stage(spark, rows):
    items = [t for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet' order by item_id").fetchall()]
    planted = [(None, "start " + items[0] + " end"), (5, items[1])]
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))

    def bad(t):
        w = words(t)
        seen = set(grams(w))
        for item in items:
            own = grams(words(item))
            n = len(words(item))
            if sum(own[g] for g in own if g in seen) < 0.75 * own.total():
                continue
            for s in range(max(1, len(w) - n + 1)):
                got = grams(w[s : s + n])
                shared = sum((got & own).values())
                if shared >= 0.75 * (got.total() + own.total() - shared):
                    return True
        return False

    every = rows + planted
    got = kept(corpus_pipeline.decontamination_stage(spark, frame(spark, every), SF))
    assert got == sorted(((d, t) for d, t in every if not bad(t)), key=str) and len(got) < len(every) - 1


def test_quality_stage(spark, rows):
    docs = frame(spark, rows)
    model = quality.QualityModel.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    import numpy as np
    import pyarrow as pa

    scores = quality.score_texts(pa.array([t for _, t in rows]), np.asarray(model.weights))
    got = kept(corpus_pipeline.quality_stage(spark, docs, SF))
    assert got == sorted((r for r, s in zip(rows, scores, strict=True) if s >= 0.3), key=str)


def test_empty_and_whole(spark):
    nothing = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0, name
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    assert len(pieces) > 50 and pieces.groupby("sequence_id").length.sum().max() <= 4096
