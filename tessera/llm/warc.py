"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; exact record headers are
stored apart from them, and original records come back by joining the two on
the digest.  Everything runs inside the JVM.

Layout below the archive's path::

    payloads/  digest string, payload binary          one row per distinct payload
    headers/   page_id long, header string, digest string

Rules: of records with equal payloads of at least ``revisit_from`` bytes, that
with the smallest ``page_id`` is the response and the others revisit it.
Smaller payloads are all responses (their bytes are stored once all the same).

Defined results: a null payload is empty; a null ``page_id`` never is the
smallest, so such a row revisits a sibling that has an id and is a response if
no sibling has one; rows that repeat the smallest id are all responses; an
empty table gives an empty archive; further input columns are ignored; a null
url leaves out the header ``WARC-Target-URI``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_columns

REVISIT_FROM = 100
WARC_DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = REVISIT_FROM, date: str = WARC_DATE) -> None:
    """Write one WARC record for each row of ``pages`` below ``path``."""
    ensure_columns(pages, id_col, url_col, payload_col)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})

    # One row per digest: partial aggregation keeps one payload per task and digest before the shuffle.
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")

    slim = rows.drop("payload")
    firsts = slim.where(F.col("size") >= revisit_from).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    named = slim.join(firsts, "digest", "left")
    revisit = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat_ws(
        "",
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, line("WARC-Profile", F.lit(REVISIT_PROFILE))),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("first_id")))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit(CRLF),
    )
    named.select("page_id", header.alias("header"), "digest").write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records: headers joined to verified payloads.

    Returns page_id, header, payload (the full one, also for revisits), digest
    (computed again from the stored bytes), record_type, refers_to and record,
    the exact bytes of the WARC record.  A stored payload that does not have
    its digest, or a header without payload, fails the job.
    """
    headers = spark.read.schema("page_id long, header string, digest string").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    checked = payloads.withColumn("actual", F.sha2("payload", 256)).withColumn(
        "payload", F.when(F.col("actual") == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("archive is damaged: payload of "), F.col("digest"))))
    )
    joined = headers.join(checked, "digest", "left")
    payload = F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("archive lacks the payload "), F.col("digest"))))
    kind = F.regexp_extract("header", "(?m)^WARC-Type: (\\w+)$", 1)
    refers = F.regexp_extract("header", "(?m)^WARC-Refers-To: <urn:page:(-?\\d+)>$", 1)
    body = F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select(
        "page_id",
        "header",
        payload.alias("payload"),
        F.col("actual").alias("digest"),
        kind.alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
        F.concat(F.encode("header", "UTF-8"), body, F.encode(F.lit(CRLF * 2), "UTF-8")).alias("record"),
    )
