"""Content-addressed WARC archive.

An archive is a folder of two Parquet tables.  ``payloads`` holds the bytes of
each distinct payload once, under its SHA-256.  ``records`` holds, for each
record, the exact bytes of its WARC and HTTP header blocks and the SHA-256 of
its payload.  Joined, they give back every original record byte for byte.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads of fewer bytes are always written as responses.
REVISIT_BYTES = 1000
_CRLF = "\r\n"
_NO_ID = -(2**63)


def _warc_header(kind: Column, page_id: Column, url: Column, sha1: Column, refers_to: Column, block: Column, date: str) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_CRLF))
    record_id = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1" + _CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_id(page_id)),
        line("WARC-Date", F.lit(date)),
        # a line break in a URL would end its header early
        F.coalesce(line("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]", "")), F.lit("")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + _CRLF)).otherwise(""),
        F.when(revisit, line("WARC-Refers-To", record_id(refers_to))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block),
        F.lit(_CRLF),
    )


def write_archive(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, date: str | None = None) -> str:
    """Writes ``pages`` (page_id, url, html) to the archive at ``path`` and returns the path.

    ``date`` (UTC, as 2026-01-31T00:00:00Z) is when the records were made: now, if not given.

    Of records with equal payloads of at least ``revisit_bytes`` bytes, that
    with the largest page_id is a response and the others revisit it; smaller
    ones are responses.  Null html is an empty payload; a null url leaves its
    header out; a null page_id ranks below all others.  Rows that repeat a
    page_id and payload are records of one role.  Other columns are ignored; an
    empty table gives an empty archive.  Payloads move once, to the task that
    keeps their digest; a digest's copies within a task go first.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    facts = {"sha256": F.sha2("payload", 256), "sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long"), "rank": F.coalesce("page_id", F.lit(_NO_ID))}
    rows = rows.withColumns(facts)
    # payloads take no part in choosing keepers, and copies are summed before they move
    groups = rows.groupBy("sha256").agg(F.max("rank").alias("keeper"))
    heads = rows.select("page_id", "rank", "url", "sha256", "sha1", "payload_bytes").join(groups, "sha256")
    revisits = (F.col("payload_bytes") >= revisit_bytes) & (F.col("rank") != F.col("keeper"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + _CRLF + "Content-Type: text/html; charset=utf-8" + _CRLF + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_CRLF * 2))
    heads = heads.withColumns({"record_type": F.when(revisits, "revisit").otherwise("response"), "refers_to": F.when(revisits, F.col("keeper")), "http_header": http})
    block = F.length("http_header") + F.when(revisits, F.lit(0)).otherwise(F.col("payload_bytes"))
    heads = heads.withColumn("warc_header", _warc_header(F.col("record_type"), F.col("page_id"), F.col("url"), F.col("sha1"), F.col("refers_to"), block, date))
    heads.select(
        "page_id", F.col("warc_header").cast("binary").alias("warc_header"), F.col("http_header").cast("binary").alias("http_header"), "sha256", "record_type", "refers_to"
    ).write.parquet(f"{path}/records", compression="zstd")
    keepers = groups.withColumnRenamed("keeper", "rank")
    kept = rows.select("sha256", "rank", "payload").join(keepers, ["sha256", "rank"], "left_semi")
    # rows that repeat a page already share a partition here
    kept.dropDuplicates(["sha256", "rank"]).select("sha256", "payload").write.parquet(f"{path}/payloads", compression="zstd")
    return path


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of an archive, each with its full payload's facts and, with ``payloads``, its bytes.

    Stored payloads are verified against their SHA-256 as they are read; a
    mismatch stops the read.  Columns: page_id, payload_bytes, payload_digest
    (SHA-1), record_type, refers_to, warc_header, http_header[, payload, record].
    """
    records = spark.read.parquet(f"{path}/records")
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("corrupt payload "), F.col("sha256"))))
    stored = stored.select(sound.alias("sha256"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), *(["payload"] if payloads else []))
    out = records.join(stored, "sha256")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "warc_header", "http_header"]
    if not payloads:
        return out.select(*columns)
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return out.select(*columns, "payload", F.concat("warc_header", "http_header", body, F.lit((_CRLF * 2).encode())).alias("record"))


def export_warc(spark: SparkSession, archive: str, path: str) -> None:
    """Writes an archive's records as gzipped WARC files, one a task."""
    text = F.regexp_replace(F.col("record").cast("string"), r"\r\n\z", "")
    read_archive(spark, archive).select(text.alias("value")).write.text(path, compression="gzip", lineSep=_CRLF)
