"""The registered queries of the engine's operators, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import CUES
from ..operators import context, evaluate, intervals, known, roles, rules
from ..sources import loaders
from .engine import Engine, contributions, release_view, statistics
from .policy import Config


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return loaders.from_turns(_read(spark, d, "conversations"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("conv_id"), F.coalesce("text", F.lit("")).alias("text"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events as intervals of ten minutes, in seconds, of a user."""
    start = F.unix_timestamp("ts")
    return _read(spark, d, "events").select(F.col("user_id").alias("conv_id"), start.alias("start"), (start + 600).alias("end"), F.col("event_type").alias("entity"), F.col("event_id").alias("ord"), "value")


def turn_offsets(spark, d):
    return _turns(spark, d).select("conv_id", "turn_idx", "speaker", "char_start", "char_end")


def flat_texts(spark, d):
    flat = loaders.flat_text(_turns(spark, d))
    return flat.select("conv_id", F.size("turns").alias("n_turns"), F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def rendered_turns(spark, d):
    flat = loaders.flat_text(_turns(spark, d))
    return flat.select("conv_id", F.sha2(loaders.render_turns(F.col("turns")), 256).alias("sha256"))


def role_cues(spark, d):
    turns = _turns(spark, d)
    cue = lambda role: sum((F.regexp_count("text", F.lit(rx)) * w for rx, w in CUES[role]), F.lit(0.0))
    return turns.groupBy("conv_id", "speaker").agg(*[F.sum(cue(r)).alias(r) for r in CUES])


def speaker_roles(spark, d):
    return roles.assign_roles(_turns(spark, d)).select("conv_id", "speaker", "role").distinct()


def rule_offsets(spark, d):
    """Places of the matches of four rules in documents."""
    found = rules.detect_rules(_docs(spark, d), names=["email", "us_ssn", "date_iso", "phone_intl"])
    return found.select("conv_id", F.col("raw_label").alias("rule"), "start", "end", "surface")


def rule_counts(spark, d):
    return rules.detect_rules(_docs(spark, d)).groupBy("raw_label", "entity").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_docs"))


def context_counts(spark, d):
    flat = loaders.flat_text(_turns(spark, d)).select("conv_id", "text")
    return context.detect_context(flat).groupBy("raw_label", "entity").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_convs"))


def asof_turns(spark, d):
    turns = _turns(spark, d)
    ends = turns.groupBy("conv_id").agg(F.max("char_end").alias("n"))
    points = ends.select("conv_id", F.explode(F.sequence(F.lit(0), F.col("n"), F.lit(100))).alias("start"))
    return intervals.turn_at(points, turns).select("conv_id", "start", "turn_idx", "speaker")


def interval_clusters(spark, d):
    return intervals.clusters(_events(spark, d)).groupBy("conv_id", "cluster").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def merged_islands(spark, d):
    return intervals.islands(_events(spark, d), ["conv_id"], 300)


def interval_overlaps(spark, d):
    e = _events(spark, d)
    a, b = e.where("entity = 'purchase'"), e.where("entity = 'click'").select("conv_id", "start", "end", "ord")
    return intervals.overlaps(a, b).select("conv_id", "ord", "b_ord", "lo", "hi")


def containment_anti(spark, d):
    e = _events(spark, d)
    inner = e.where("entity = 'purchase'").select("conv_id", "ord", (F.col("start") + 200).alias("start"), (F.col("start") + 300).alias("end"))
    return intervals.not_inside(inner, e.where("entity = 'click'").select("conv_id", "start", "end"))


def interval_coverage(spark, d):
    e = _events(spark, d)
    return intervals.covered(e.where("entity = 'purchase'").select("conv_id", "ord", "start", "end"), e.where("entity <> 'purchase'"))


def band_nearest(spark, d):
    e = _events(spark, d)
    return intervals.nearest_within(e.where("entity = 'purchase'").select("conv_id", "ord", "start"), e.where("entity = 'click'"), 3600)


def first_appearance_labels(spark, d):
    """Pseudonym numbers by first appearance, where names are linked exactly; ranks in two steps, so that a label with most rows is no one task's."""
    first = _events(spark, d).groupBy("entity", "conv_id").agg(F.min(F.struct("start", "ord")).alias("f"))
    n = evaluate.rank_within(first, "entity", F.col("f.start"), "f")
    return n.select("entity", "conv_id", F.format_string("<%s_%02d>", F.upper("entity"), F.col("rank")).alias("label"))


def _gold_pred(spark, d):
    e = _events(spark, d).select("conv_id", F.floor(F.col("start") / 60).alias("start"), "ord", F.when(F.col("ord") % 2 == 0, "EMAIL").when(F.col("ord") % 3 == 0, "CITY").otherwise("CHILD_NAME").alias("entity"))
    e = e.withColumn("end", F.col("start") + 5)
    shift = F.when(F.col("ord") % 5 == 0, 1).otherwise(0)
    return e.drop("ord"), e.where("ord % 7 <> 0").select("conv_id", "entity", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"))


def exact_match_metrics(spark, d):
    return evaluate.summary(evaluate.exact_counts(*_gold_pred(spark, d)))


def partial_match_metrics(spark, d):
    return evaluate.summary(evaluate.partial_counts(*_gold_pred(spark, d)))


def span_leakage(spark, d):
    return evaluate.leakage(*_gold_pred(spark, d))


def latency_percentiles(spark, d):
    return evaluate.percentiles(_read(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


def fuzzy_names(spark, d):
    n = _read(spark, d, "nation").select("n_name", "n_regionkey")
    both = n.join(n.select(F.col("n_name").alias("other"), F.col("n_regionkey").alias("r")), F.col("n_regionkey") == F.col("r"))
    return both.where("n_name < other").select("n_name", "other", F.round(T.similarity(F.col("n_name"), F.col("other")), 6).alias("similarity"), T.phonetic_key(F.col("n_name")).alias("key"))


def age_buckets(spark, d):
    return _read(spark, d, "lineitem").groupBy(T.age_bucket(F.col("l_quantity").cast("int")).alias("bucket")).agg(F.count("*").alias("n"))


def dayparts(spark, d):
    clock = F.date_format("ts", "HH:mm")
    return _read(spark, d, "events").groupBy(T.daypart(clock).alias("part")).agg(F.count("*").alias("n"))


def stable_offsets(spark, d):
    return _read(spark, d, "customer").select("c_custkey", T.stable_offset(F.col("c_name")).alias("stable_offset"))


def normalized_tokens(spark, d):
    return _docs(spark, d).select("conv_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"), F.sha2(T.normalize(F.col("text")), 256).alias("sha256"))


def _known(spark, d):
    """Known values: the distinct capitalised openings of conversations."""
    first = _read(spark, d, "conversations").select(F.regexp_extract("text", r"^(\p{Lu}[\p{L}]{5,12})", 1).alias("value")).where("value <> ''").select("value").distinct()
    return first.select(F.lit(None).cast("string").alias("conv_id"), F.lit("CHILD_NAME").alias("entity"), "value")


def known_value_hits(spark, d):
    flat = loaders.flat_text(_turns(spark, d)).select("conv_id", "text")
    return known.count_known(flat, _known(spark, d))


def known_value_exact(spark, d):
    """Places where a known value stands exactly, accents and case aside."""
    flat = loaders.flat_text(_turns(spark, d)).select("conv_id", "text")
    return known.detect_known(flat, _known(spark, d), exact=True).select("conv_id", "start", "end", "surface")


def _own_known(spark, d):
    """Known values of each conversation: the capitalised openings of its own turns."""
    first = _read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), F.regexp_extract("text", r"^(\p{Lu}[\p{L}]{5,12})", 1).alias("value"))
    return first.where("value <> ''").distinct().select("conv_id", F.lit("CHILD_NAME").alias("entity"), "value")


def _deidentified(spark, d, **settings):
    return Engine(spark, Config().with_(**settings)).deidentify(_turns(spark, d), _own_known(spark, d))


def deid_results(spark, d):
    """Results without text: how each conversation fared."""
    return _deidentified(spark, d).select("conv_id", "status", "risk", "stats")


def deidentified(spark, d):
    return release_view(_deidentified(spark, d), allow_review=True)


def deid_statistics(spark, d):
    return statistics(_deidentified(spark, d))


def deid_findings(spark, d):
    out = _deidentified(spark, d)
    return out.select("status", F.explode_outer("findings").alias("f")).groupBy("status", "f.check", "f.severity").count()


def detector_contribution(spark, d):
    return contributions(_deidentified(spark, d))


def pseudonym_inventory(spark, d):
    out = _deidentified(spark, d).select("conv_id", F.explode("stats.pseudonym_pools").alias("prefix", "n"))
    return out.groupBy("prefix").agg(F.sum("n").cast("long").alias("referents"))


ALL = (turn_offsets, flat_texts, rendered_turns, role_cues, speaker_roles, rule_offsets, rule_counts, context_counts, asof_turns, interval_clusters, merged_islands, interval_overlaps, containment_anti, interval_coverage, band_nearest, first_appearance_labels, exact_match_metrics, partial_match_metrics, span_leakage, latency_percentiles, fuzzy_names, age_buckets, dayparts, stable_offsets, normalized_tokens, known_value_hits, known_value_exact, deidentified, deid_statistics, deid_findings, detector_contribution, pseudonym_inventory)
QUERIES = {f.__name__: f for f in ALL}

_TURNS = r"""turns AS (
    SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(row_number() OVER w - 1 AS INTEGER) AS turn_idx, speaker, text,
        CAST(coalesce(sum(length(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS char_start
    FROM (SELECT conv_id, turn, coalesce(role, 'SPEAKER_UNKNOWN') AS speaker, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text FROM conversations)
    WHERE text <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn, speaker, text))"""
_EVENTS = "e AS (SELECT user_id AS conv_id, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + 600 AS \"end\", event_type AS entity, event_id AS ord, value FROM events)"


#: What the four rules find, written for this engine: no look-around, and words in any script.
_RULE_SQL = {
    "email": r"[\p{L}\p{N}_.!#$%&''*+/=?^`{|}~-]*[\p{L}\p{N}_][.!#$%&''*+/=?^`{|}~-]*@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+",
    "us_ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "date_iso": r"\b(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\b",
    "phone_intl": r"\+[0-9]{1,3}[\s.-]?(?:\(?[0-9]{1,4}\)?[\s.-]?){2,5}[0-9]{2,4}\b",
}


def _rule_sql(name: str) -> str:
    rx = _RULE_SQL[name]
    return f"""SELECT CAST(doc_id AS VARCHAR) AS conv_id, '{name}' AS rule, m, string_split_regex(coalesce(text, ''), '(?i){rx}') AS g
        FROM (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '(?i){rx}') AS m FROM documents) WHERE len(m) > 0"""


_GOLD = """g AS (SELECT user_id AS conv_id, CAST(floor(epoch(ts)) AS BIGINT) // 60 AS start, CAST(floor(epoch(ts)) AS BIGINT) // 60 + 5 AS "end", event_id AS ord,
        CASE WHEN event_id % 2 = 0 THEN 'EMAIL' WHEN event_id % 3 = 0 THEN 'CITY' ELSE 'CHILD_NAME' END AS entity FROM events),
    p AS (SELECT conv_id, entity, start + CASE WHEN ord % 5 = 0 THEN 1 ELSE 0 END AS start, "end" + CASE WHEN ord % 5 = 0 THEN 1 ELSE 0 END AS "end" FROM g WHERE ord % 7 <> 0)"""
_RATES = """r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS re
        FROM (SELECT entity, tier, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM t GROUP BY GROUPING SETS ((entity), (tier), ())))
    SELECT entity, tier, tp, fp, fn, round(pr, 4) AS precision, round(re, 4) AS recall,
        CASE WHEN pr + re > 0 THEN round(2 * pr * re / (pr + re), 4) ELSE 0.0 END AS f1,
        CASE WHEN 4 * pr + re > 0 THEN round(5 * pr * re / (4 * pr + re), 4) ELSE 0.0 END AS f2 FROM r"""
_CUES = {r: " + ".join(f"len(regexp_extract_all(text, '{rx.replace(chr(39), chr(39) * 2)}')) * {w}" for rx, w in cues) for r, cues in CUES.items()}
#: Rewrites and codes of the sound key, and words of roles, restated for SQL.
_SOUND = "regexp_replace(lower(n_name), '[ _]', '', 'g')"
for _a, _b in (x.split(">") for x in "ough>F ph>F gh>K ck>K sch>SK sh>X ch>X tch>X th>0 wr>R kn>N gn>N wh>W qu>KW dg>J ee>I ea>I ie>I ei>I oo>U ou>U aa>A ah>A".split()):
    _SOUND = f"replace({_SOUND}, '{_a}', '{_b}')"
_SOUND = f"(CASE WHEN regexp_matches({_SOUND}, '^[aeiouyAIU]') THEN 'A' ELSE '' END || translate(regexp_replace({_SOUND}, '[aeiouyhAIU]', '', 'g'), 'bcdfgjklmnpqrstvwxz', 'BKTFKJKLMNPKRSTFW#S'))"
for _a in "ABFJKLMNPRSTWX0123456789":
    _SOUND = f"regexp_replace({_SOUND}, '{_a}+', '{_a}', 'g')"
_SOUND = f"replace({_SOUND}, '#', 'KS')"

ORACLE_SQL = {
    "speaker_roles": f"""WITH {_TURNS}, c AS (SELECT conv_id, speaker, {', '.join(f'sum({c}) AS {r}' for r, c in _CUES.items())} FROM turns GROUP BY 1, 2),
        b AS (SELECT conv_id, speaker, CASE WHEN greatest(child, parent, clinician) < 2 THEN 'unknown' WHEN child >= parent AND child >= clinician THEN 'child' WHEN parent >= clinician THEN 'parent' ELSE 'clinician' END AS role FROM c),
        o AS (SELECT *, count(*) OVER w AS n, CASE WHEN count(*) OVER w = 2 THEN list(role) OVER w END AS roles FROM b WINDOW w AS (PARTITION BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        SELECT conv_id, speaker, CASE WHEN role = 'unknown' AND n = 2 AND list_contains(roles, 'child') THEN 'parent' WHEN role = 'unknown' AND n = 2 AND list_contains(roles, 'parent') THEN 'child' ELSE role END AS role FROM o""",
    "fuzzy_names": f"""SELECT a.n_name, b.n_name AS other, round(1 - levenshtein(lower(a.n_name), lower(b.n_name)) / greatest(length(a.n_name), length(b.n_name)), 6) AS similarity, a.key
        FROM (SELECT *, {_SOUND} AS key FROM nation) a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name""",
    "span_leakage": f"""WITH {_GOLD}, r AS (SELECT *, max("end") OVER (PARTITION BY conv_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
        c AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM r),
        u AS (SELECT conv_id, min(start) AS s, max("end") AS t FROM c GROUP BY conv_id, i),
        d AS (SELECT conv_id, count(*) AS n, sum(CASE WHEN EXISTS (SELECT 1 FROM u WHERE u.conv_id = g.conv_id AND u.s <= g.start AND g."end" <= u.t) THEN 0 ELSE 1 END) AS leaks FROM g WHERE entity <> 'CITY' GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS direct_spans, CAST(sum(leaks) AS BIGINT) AS leaked_spans, round(avg(CASE WHEN leaks > 0 THEN 1.0 ELSE 0.0 END), 4) AS conversation_leakage FROM d""",
    "normalized_tokens": """WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS conv_id, trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^\\p{L}\\p{N}_\\s'']', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)
        SELECT conv_id, CASE WHEN t = '' THEN 0 ELSE CAST(length(t) - length(replace(t, ' ', '')) + 1 AS INTEGER) END AS n_tokens, sha256(t) AS sha256 FROM t""",
    "turn_offsets": f"WITH {_TURNS} SELECT conv_id, turn_idx, speaker, char_start, CAST(char_start + length(text) AS INTEGER) AS char_end FROM turns",
    "flat_texts": f"WITH {_TURNS} SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, CAST(length(string_agg(text, chr(10) ORDER BY turn_idx)) AS INTEGER) AS n_chars, sha256(string_agg(text, chr(10) ORDER BY turn_idx)) AS text_sha256 FROM turns GROUP BY 1",
    "rendered_turns": f"WITH {_TURNS} SELECT conv_id, sha256(string_agg(speaker || ': ' || text, chr(10) ORDER BY turn_idx)) AS sha256 FROM turns GROUP BY 1",
    "role_cues": f"WITH {_TURNS} SELECT conv_id, speaker, {', '.join(f'CAST(sum({c}) AS DOUBLE) AS {r}' for r, c in _CUES.items())} FROM turns GROUP BY 1, 2",
    "rule_offsets": f"""WITH f AS ({' UNION ALL '.join(map(_rule_sql, _RULE_SQL))}), k AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM f),
        s AS (SELECT *, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS start FROM k)
        SELECT conv_id, rule, start, CAST(start + length(m[k]) AS INTEGER) AS "end", m[k] AS surface FROM s""",
    "asof_turns": f"""WITH {_TURNS}, n AS (SELECT conv_id, max(char_start + length(text)) AS n FROM turns GROUP BY 1),
        p AS (SELECT conv_id, CAST(unnest(range(0, n + 1, 100)) AS INTEGER) AS start FROM n)
        SELECT p.conv_id, p.start, min(t.turn_idx) AS turn_idx, arg_min(t.speaker, t.turn_idx) AS speaker FROM p JOIN turns t ON p.conv_id = t.conv_id AND t.char_start <= p.start AND p.start <= t.char_start + length(t.text) GROUP BY 1, 2""",
    "interval_clusters": f"""WITH {_EVENTS}, r AS (SELECT *, max("end") OVER (PARTITION BY conv_id ORDER BY start, "end" DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
        c AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY start, "end" DESC, ord ROWS UNBOUNDED PRECEDING) AS INTEGER) AS cluster FROM r)
        SELECT conv_id, cluster, min(start) AS start, max("end") AS "end", count(*) AS n FROM c GROUP BY 1, 2""",
    "merged_islands": f"""WITH {_EVENTS}, r AS (SELECT *, max("end") OVER (PARTITION BY conv_id ORDER BY start, "end", ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
        c AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 300 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY start, "end", ord ROWS UNBOUNDED PRECEDING) AS i FROM r)
        SELECT conv_id, min(start) AS start, max("end") AS "end", count(*) AS n FROM c GROUP BY conv_id, i""",
    "interval_overlaps": f"""WITH {_EVENTS} SELECT a.conv_id, a.ord, b.ord AS b_ord, greatest(a.start, b.start) AS lo, least(a."end", b."end") AS hi FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.start < b."end" AND a."end" > b.start
        WHERE a.entity = 'purchase' AND b.entity = 'click'""",
    "containment_anti": f"""WITH {_EVENTS} SELECT conv_id, ord, start + 200 AS start, start + 300 AS "end" FROM e a WHERE entity = 'purchase'
        AND NOT EXISTS (SELECT 1 FROM e b WHERE b.entity = 'click' AND b.conv_id = a.conv_id AND b.start <= a.start + 200 AND a.start + 300 <= b."end")""",
    "interval_coverage": f"""WITH {_EVENTS}, o AS (SELECT * FROM e WHERE entity <> 'purchase'), r AS (SELECT *, max("end") OVER (PARTITION BY conv_id ORDER BY start, "end", ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
        c AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY start, "end", ord ROWS UNBOUNDED PRECEDING) AS i FROM r),
        u AS (SELECT conv_id, min(start) AS s, max("end") AS t FROM c GROUP BY conv_id, i)
        SELECT conv_id, ord, start, "end", EXISTS (SELECT 1 FROM u WHERE u.conv_id = e.conv_id AND u.s <= e.start AND e."end" <= u.t) AS covered FROM e WHERE entity = 'purchase'""",
    "band_nearest": f"""WITH {_EVENTS}, j AS (SELECT a.conv_id, a.ord, a.start, b.start AS nearest, abs(a.start - b.start) AS distance FROM e a JOIN e b ON a.conv_id = b.conv_id WHERE a.entity = 'purchase' AND b.entity = 'click' AND abs(a.start - b.start) <= 3600)
        SELECT conv_id, ord, start, nearest, distance FROM j QUALIFY row_number() OVER (PARTITION BY ord ORDER BY distance, nearest) = 1""",
    "first_appearance_labels": f"""WITH {_EVENTS}, f AS (SELECT entity, conv_id, min(start) AS s, arg_min(ord, (start, ord)) AS o FROM e GROUP BY 1, 2)
        SELECT entity, conv_id, '<' || upper(entity) || '_' || CASE WHEN n < 10 THEN '0' ELSE '' END || n || '>' AS label FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY s, o) AS n FROM f)""",
    "exact_match_metrics": f"""WITH {_GOLD}, a AS (SELECT conv_id, entity, start, "end", count(*) AS n FROM g GROUP BY ALL), b AS (SELECT conv_id, entity, start, "end", count(*) AS m FROM p GROUP BY ALL),
        t AS (SELECT entity, CASE entity WHEN 'CITY' THEN 'quasi' ELSE 'direct' END AS tier, least(coalesce(n, 0), coalesce(m, 0)) AS tp, greatest(coalesce(m, 0) - coalesce(n, 0), 0) AS fp, greatest(coalesce(n, 0) - coalesce(m, 0), 0) AS fn
            FROM a FULL JOIN b USING (conv_id, entity, start, "end")), {_RATES}""",
    # spans of one length in order of their starts: the first free one that overlaps is the next that does not end too early
    "partial_match_metrics": f"""WITH RECURSIVE {_GOLD}, a AS (SELECT conv_id, entity, list(start ORDER BY start) AS gs FROM g GROUP BY ALL), b AS (SELECT conv_id, entity, list(start ORDER BY start) AS ps FROM p GROUP BY ALL),
        z AS (SELECT conv_id, entity, coalesce(gs, []) AS gs, coalesce(ps, []) AS ps FROM a FULL JOIN b USING (conv_id, entity)),
        s AS (SELECT conv_id, entity, 1 AS i, 1 AS j, 0 AS tp FROM z UNION ALL
            SELECT conv_id, entity, i + CASE WHEN ps[j] + 5 <= gs[i] THEN 0 ELSE 1 END, j + CASE WHEN gs[i] + 5 <= ps[j] THEN 0 ELSE 1 END, tp + CASE WHEN ps[j] + 5 <= gs[i] OR gs[i] + 5 <= ps[j] THEN 0 ELSE 1 END
            FROM s JOIN z USING (conv_id, entity) WHERE i <= len(gs) AND j <= len(ps)),
        m AS (SELECT conv_id, entity, max(tp) AS tp FROM s GROUP BY ALL),
        t AS (SELECT entity, CASE entity WHEN 'CITY' THEN 'quasi' ELSE 'direct' END AS tier, tp, len(ps) - tp AS fp, len(gs) - tp AS fn FROM m JOIN z USING (conv_id, entity)), {_RATES}""",
    "latency_percentiles": "WITH v AS (SELECT event_type, list_sort(list(value)) AS l FROM events GROUP BY 1) SELECT event_type, l[CAST(floor((len(l) - 1) * 0.5) AS INTEGER) + 1] AS p50, l[CAST(floor((len(l) - 1) * 0.95) AS INTEGER) + 1] AS p95 FROM v",
    "age_buckets": "SELECT printf('<AGE_%d_%d>', CAST(l_quantity AS INTEGER) // 3 * 3, CAST(l_quantity AS INTEGER) // 3 * 3 + 2) AS bucket, count(*) AS n FROM lineitem GROUP BY 1",
    "dayparts": """WITH h AS (SELECT CASE WHEN hour(ts) <= 7 THEN hour(ts) + 12 ELSE hour(ts) END AS h FROM events)
        SELECT CASE WHEN h < 5 THEN 'NIGHT' WHEN h < 12 THEN 'MORNING' WHEN h < 17 THEN 'AFTERNOON' WHEN h < 21 THEN 'EVENING' ELSE 'NIGHT' END AS part, count(*) AS n FROM h GROUP BY 1""",
    "stable_offsets": "SELECT c_custkey, CAST('0x' || substr(sha256(c_name), 1, 6) AS BIGINT) AS stable_offset FROM customer",
}
