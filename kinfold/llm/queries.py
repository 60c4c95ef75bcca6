"""The queries of these operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import ann, bpe, embedding_dedup, fixity, html_main, langid, mixing, quality, simhash, spans
from kinfold.llm.common import stash


def _table(name: str, apply: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: apply(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _fixity(pages: DataFrame) -> DataFrame:
    """Audit of a damaged replica of the pages' archives: of every 97 page ids one is altered in place, one is gone, one is not in the reference."""
    # One byte of the header differs.
    laid = fixity.page_records(pages, lambda record: F.concat(F.lit("W@RC"), F.substring(record, 5, 1 << 30)))
    laid = stash(laid, "fixity-records").withColumn("kind", F.coalesce(F.pmod("page_id", F.lit(97)), F.lit(50)))
    reference = laid.where("kind <> 2").select("archive", "offset", "length", "digest")
    replica = laid.where("kind <> 1").select("archive", "offset", "length", F.when(F.col("kind") == 0, F.col("damaged_digest")).otherwise(F.col("digest")).alias("digest"))
    return fixity.audit(reference, replica)


FIXITY_SQL = """
WITH r AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '')
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR)
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec,
    coalesce(((page_id % 97) + 97) % 97, 50) AS kind,
    'pages-' || coalesce(CAST(page_id // 1000 AS VARCHAR), 'none-' || substr(md5(coalesce(url, '') || chr(10) || coalesce(html, '')), 1, 3)) || '.warc' AS archive
  FROM pages
), o AS (
  SELECT *, CAST(sum(strlen(rec)) OVER (PARTITION BY archive ORDER BY page_id, sha256(rec) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - strlen(rec) AS BIGINT) AS off, 'W@RC' || substr(rec, 5) AS bad FROM r
)
SELECT archive, off AS "offset", CASE kind WHEN 0 THEN 'corrupt' WHEN 1 THEN 'missing' ELSE 'extra' END AS status,
  CASE WHEN kind <> 2 THEN CAST(strlen(rec) AS BIGINT) END AS length, CASE WHEN kind <> 2 THEN sha256(rec) END AS digest,
  CASE WHEN kind <> 1 THEN CAST(strlen(rec) AS BIGINT) END AS replica_length,
  CASE kind WHEN 0 THEN sha256(bad) WHEN 2 THEN sha256(rec) END AS replica_digest, CAST(1 AS BIGINT) AS copies
FROM o WHERE kind IN (0, 1, 2)
"""


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _mix(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_fixity": _table("pages", _fixity),
        "op2_span_dedup": _table("documents", lambda d: spans.remove_repeats(d).select("doc_id", "kept_text", "sentences_removed", "changed")),
        "op3_quality": _quality,
        "op4_main_text": _table("pages", html_main.extract),
        "op5_learned_partitions": _table("embeddings", ann.every_twentieth),
        "op6_simhash": _table("documents", simhash.simhash_near_duplicates),
        "op7_byte_bpe": _table("documents", bpe.digests),
        "op8_embedding_dedup": _table("embeddings", embedding_dedup.link),
        "op9_language_id": _table("documents", langid.predict_language),
        "op10_source_mix": _table("documents", _mix),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_fixity": FIXITY_SQL}
