"""Repository statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def system_statistics(members: DataFrame, edges: DataFrame | None = None, quality: DataFrame | None = None) -> DataFrame:
    """One row of counts over entities: records, entities, linked and single entities, edges, average cluster size and quality (1.0 if empty).

    ``edges`` is one row with ``total_edges``, which needs no edge log (see :func:`matching.edge_count`).
    """
    sizes = members.groupBy("entity_id").agg(F.count("*").alias("n"))
    out = sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"), F.count("*").alias("total_entities"), F.count_if(F.col("n") > 1).alias("linked_entities"), F.count_if(F.col("n") == 1).alias("single_entities"),
        F.coalesce(F.round(F.avg("n"), 2), F.lit(1.0)).alias("average_cluster_size"),
    )
    if edges is not None:
        out = out.crossJoin(edges.select("total_edges"))
    if quality is not None:
        out = out.crossJoin(quality.agg(F.coalesce(F.round(F.avg("entity_quality_score"), 2), F.lit(1.0)).alias("average_quality")))
    return out


def dedup_kpis(stats: DataFrame) -> DataFrame:
    """Duplicates resolved, the reduction in per cent (0 if empty), and matched rows, which are those of linked entities."""
    resolved: Column = F.greatest(F.lit(0), F.col("total_records") - F.col("total_entities"))
    share = F.when(F.col("total_records") > 0, F.round(resolved / F.col("total_records") * 100, 1)).otherwise(0.0)
    return stats.select(resolved.alias("duplicates_resolved"), share.alias("reduction_pct"), (F.col("total_records") - F.col("single_entities")).alias("matched_rows"))


def unmatched_flags(records: DataFrame, members: DataFrame) -> DataFrame:
    """``records`` with ``is_unmatched``: no other record is in their entity."""
    return records.join(members.select("seq", (F.col("cluster_size") == 1).alias("is_unmatched")), "seq")


def manifest(records: DataFrame) -> DataFrame:
    """Rows and mapped columns per source."""
    return records.groupBy("source_id").agg(F.count("*").alias("n_rows"), F.max(F.size("columns")).alias("mapped_columns"))


def shared_identifiers(index: DataFrame) -> DataFrame:
    """``(source_a, source_b, identifier_type, shared_values)`` for every pair of sources that share a value.

    Values are counted per source first, so a value of very many records is one row per source.
    """
    held = index.select("source_id", "identifier_type", "identifier_value").distinct()
    a, b = held.alias("a"), held.alias("b")
    same = (F.col("a.identifier_type") == F.col("b.identifier_type")) & (F.col("a.identifier_value") == F.col("b.identifier_value")) & (F.col("a.source_id") < F.col("b.source_id"))
    return a.join(b, same).groupBy(F.col("a.source_id").alias("source_a"), F.col("b.source_id").alias("source_b"), F.col("a.identifier_type").alias("identifier_type")).agg(F.count("*").alias("shared_values"))
