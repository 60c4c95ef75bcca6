"""Streaming forms: records resolved batch by batch, and event aggregates with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.operators.records import Source
from kinfold.operators.resolve import Resolution, extend, resolve
from kinfold.sources.repository import Repository


def resolve_stream(stream: DataFrame, as_source: Callable[[DataFrame, int], Source], publish: Callable[[Resolution, int], None], checkpoint: str, store: Repository, earlier: Resolution | None = None) -> StreamingQuery:
    """Resolve each micro-batch together with all records before it and publish the result.

    What came before lies in ``store`` under the batch's number, not in the driver: a restarted query goes on from
    there, and a batch that is delivered again is resolved against the state before it, so ``publish`` must replace,
    not add. ``earlier`` counts where the store holds nothing. A batch's own rows are normalised once, and the clusters
    of the stored records are grown by them (see :func:`matching.grown_clusters`).
    """

    def batch(df: DataFrame, number: int) -> None:
        before = store.kept(number + 1) or earlier
        source = as_source(df, number)
        now = resolve([source]) if before is None else extend(before, [source])
        store.keep(now, number + 1)
        publish(now, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def _watermarked(stream: DataFrame, at: str, late: str) -> DataFrame:
    """A watermark needs a time with a zone; one without is taken in the session's."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def distinct_events(stream: DataFrame, key: str = "event_id", at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Events once each, if their repeats come within the watermark."""
    return _watermarked(stream, at, late).dropDuplicatesWithinWatermark([key])


def windowed_activity(stream: DataFrame, at: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events, users and sums per window and type; windows close when the watermark passes them."""
    grouped = _watermarked(stream, at, late).groupBy(F.window(at, width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n_events"), F.sum("value").alias("sum_value")).select(F.col("w.start").alias("window_start"), "event_type", "n_events", "sum_value")


def sessions(stream: DataFrame, at: str = "ts", late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: runs of events with no gap longer than ``gap``."""
    return _watermarked(stream, at, late).groupBy(F.session_window(at, gap).alias("s"), "user_id").agg(F.count("*").alias("n_events")).select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "user_id", "n_events")
