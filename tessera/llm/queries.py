"""The registered queries over the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audio, langid, mixing, neardup, packing, quality, repeats, urls, warc
from .common import Scratch

URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~out))
    return langid.identify(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "audio") as scratch:
        figures = audio.media_features(_table(spark, sf_dir, "documents"), scratch.path())
        return scratch.keep(figures.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "warc") as scratch:
        path = scratch.path()
        warc.write_archive(_table(spark, sf_dir, "pages"), path)
        back = warc.read_archive(spark, path)
        return scratch.keep(back.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"))


def op7_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good are documents of label quality 1; one in five labelled documents (by hash of its id) is not learnt from."""
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    held_out = lambda: F.pmod(F.xxhash64(F.lit("held out"), F.col("doc_id")), F.lit(5)) == 0
    model = quality.fit(docs.where(~held_out()), labels.where(~held_out()))
    scored = quality.score(docs.withColumn("held_out", held_out()), model)
    return scored.select("doc_id", "held_out", "text_score", "meta_score", "quality_score", (F.col("quality_score") >= 0.5).alias("kept"))


def op8_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled through the document number at the end of their path."""
    pages = _table(spark, sf_dir, "pages")
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("_quality"), F.max("toxic").alias("_toxic"))
    number = F.expr("try_cast(regexp_extract(_path, '/([0-9]+)[^/0-9]*$', 1) AS bigint)")
    named = pages.withColumn("_path", urls.path_of(F.col("url"))).withColumn("_number", number)
    labelled = named.join(labels.withColumnRenamed("doc_id", "_label_id"), F.col("_number") == F.col("_label_id"), "left")
    bad = (F.col("_quality") == 0) | (F.col("_toxic") == 1)
    return urls.judge(labelled, URL_RULES, bad=bad).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


OP6_SQL = """
WITH r AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first_id FROM r WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, r.d AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id > first_id THEN first_id END AS refers_to
FROM r LEFT JOIN f ON r.d = f.d
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source
), w AS (SELECT *, (rank % 3) + 1 AS weight FROM s),
o AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_before,
         sum(weight) OVER (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from,
         3 * source_size / weight AS ratio
  FROM w
), c AS (SELECT *, CAST(left_before AS DOUBLE) * weight / weight_from > 3 * source_size AS over FROM o),
rest AS (SELECT min(ratio) FILTER (WHERE NOT over) AS at, sum(weight) FILTER (WHERE NOT over) AS ws,
                sum(source_size) - coalesce(sum(3 * source_size) FILTER (WHERE over), 0) AS remaining FROM c),
t AS (
  SELECT source, source_size, rank,
         CASE WHEN over THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(remaining AS DOUBLE) * weight / ws END AS target
  FROM c, rest
), q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rank, d.k,
         sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT q.*, CAST(x.epoch * source_size + cum AS DOUBLE) / target AS v
  FROM q, (VALUES (0), (1), (2)) AS x(epoch) WHERE size > 0 AND target > 0
), g AS (
  SELECT *, sum(size) OVER (ORDER BY v, rank ROWS UNBOUNDED PRECEDING) AS spent FROM e
), n AS (
  SELECT doc_id, k, count(*) AS times FROM g WHERE spent <= (SELECT sum(source_size) FROM t) GROUP BY doc_id, k
)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, q.target, CAST(coalesce(n.times, 0) * q.size AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.doc_id IS NOT DISTINCT FROM n.doc_id AND q.k = n.k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_minhash_neardup": op3_minhash_neardup,
        "op4_language_id": op4_language_id,
        "op5_audio_features": op5_audio_features,
        "op6_warc_archive": op6_warc_archive,
        "op7_cotrained_quality": op7_cotrained_quality,
        "op8_collision_ann": op8_collision_ann,
        "op9_source_mix": op9_source_mix,
        "op10_url_templates": op10_url_templates,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_warc_archive": OP6_SQL, "op9_source_mix": OP9_SQL}
