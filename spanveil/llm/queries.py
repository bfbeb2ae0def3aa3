"""The registered queries of the operators, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cuckoo, decontam, language, packing, parity, pii, quality, rlindex, toxicity, warc
from .common import scratch_path

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlindex.remove_repeats(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the payloads as they stand in the records that the archive gives back; a revisit's is the one it refers to."""
    path = warc.write_archive(_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    back = warc.read_archive(spark, path)
    heads = F.length("warc_header") + F.length("http_header")
    inside = F.substring("record", heads + 1, F.length("record") - heads - 4)
    body = F.when(F.col("record_type") == "response", inside).otherwise(F.col("payload"))
    return back.select("page_id", F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"), "record_type", "refers_to")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_windows(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.similar_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_spans(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_quality, op3_warc, op4_decontamination, op5_parity_join, op6_language, op7_packing, op8_toxicity, op9_exact_dedup, op10_pii)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    # every window of 200 bytes, as hex, told apart by its digest
    "op1_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        s AS (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS k FROM d WHERE length(h) >= 400),
        m AS (SELECT r, k, md5(substr(h, 2 * k + 1, 400)) AS w FROM s),
        g AS (SELECT r, k FROM m QUALIFY count(*) OVER (PARTITION BY w) > 1),
        i AS (SELECT *, CASE WHEN k > lag(k) OVER (PARTITION BY r ORDER BY k) + 200 THEN 1 ELSE 0 END AS new FROM g),
        j AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM i),
        u AS (SELECT r, run, min(k) AS lo, max(k) + 200 AS hi FROM j GROUP BY r, run),
        p AS (SELECT u.r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY u.r ORDER BY lo), 0) AS past FROM u),
        k AS (SELECT p.r, sum(hi - lo) AS gone, count(*) AS n, string_agg(substr(h, 2 * past + 1, 2 * (lo - past)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept FROM p JOIN d ON d.r = p.r GROUP BY p.r)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM d LEFT JOIN k ON d.r = k.r""",
    # every window of an item's length in the texts that hold enough of its shingles; all items have five words or more
    "op4_decontamination": r"""
        WITH d AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
        dg AS (SELECT doc_id, k - 1 AS place, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d)),
        ig AS (SELECT item_id, array_to_string(w[k:k + 4], ' ') AS s, count(*) AS weight FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM b) GROUP BY 1, 2),
        i AS (SELECT item_id, any_value(len(w)) AS n, any_value(len(w)) - 4 AS total FROM b GROUP BY 1),
        h AS (SELECT doc_id, item_id, sum(weight) AS held FROM (SELECT DISTINCT doc_id, item_id, s, weight FROM dg JOIN ig USING (s)) GROUP BY 1, 2),
        p AS (SELECT h.doc_id, h.item_id, i.n, i.total, len(d.w) AS words, unnest(range(0, greatest(len(d.w) - i.n, 0) + 1)) AS start FROM h JOIN i USING (item_id) JOIN d USING (doc_id) WHERE held >= 0.75 * i.total),
        g AS (SELECT p.doc_id, p.item_id, p.n, p.total, p.words, p.start, dg.s, count(*) AS weight FROM p JOIN dg ON dg.doc_id = p.doc_id AND dg.place BETWEEN p.start AND p.start + p.n - 5 GROUP BY ALL),
        m AS (SELECT g.doc_id, g.item_id, g.n, g.total, g.words, g.start, sum(g.weight) AS own, sum(least(g.weight, coalesce(ig.weight, 0))) AS shared FROM g LEFT JOIN ig ON ig.item_id = g.item_id AND ig.s = g.s GROUP BY ALL)
        SELECT doc_id, item_id, shared / (own + total - shared) AS similarity, CAST(start AS INTEGER) AS start, CAST(least(words, n) AS INTEGER) AS n_words
        FROM m WHERE shared >= 0.75 * (own + total - shared) QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1""",
    # all pairs of texts with a shingle in common, and what their links reach
    "op5_parity_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        e AS (SELECT DISTINCT doc_id, md5(CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[k:k + 4], ' ') END) AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS k FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY 1),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
        g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a)
        SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, coalesce(min(r.b), w.doc_id) AS component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id""",
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
            CASE WHEN strlen(html) >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN strlen(html) >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
        FROM p""",
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
            doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY t)""",
}
