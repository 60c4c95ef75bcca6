"""What the operators share: written tables that cut lineage, batches of texts, and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.components import connected_components
from kinfold.plans.staging import staged

#: Runs of these bytes' complement are the words of a text (ASCII white space only).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch of texts, at most: a batch is held by the JVM and by Python at once, and texts can be long.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``BATCH_ROWS`` rows inside the block; the caller's setting holds again after it."""
    before = spark.conf.get(_BATCH)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: it is computed once and survives lost executors."""
    return staged(df, name)


def stash_texts(df: DataFrame, name: str) -> DataFrame:
    """:func:`stash` for a plan in which Python reads whole texts: small batches, and each text goes through Python once."""
    with _small_batches(df.sparkSession):
        return staged(df, name)


def whole_row(df: DataFrame) -> Column:
    """The caller's row as one struct, so that no name of its columns meets one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def row_keys(text: str = "text") -> list[Column]:
    """``none, id, th``, never null: a document by its id, null or not, and its text's hash; rows equal in both are one document."""
    return [F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64(text).alias("th")]


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``(node, root)`` per node of ``edges(a long, b long)``, root the smallest node reachable; no edges, no rows. ``rows``: about how many edges."""
    return connected_components(edges.select("a", "b"), rows)
