"""Consecutive numbers over a global order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.plans.staging import staged


def numbered(df: DataFrame, order: list[Column | str], out: str = "seq") -> DataFrame:
    """``df`` with ``out``: 1, 2, … in the given order.

    Rows are dealt by ranges of the order and sorted inside each; a range's first number is the sum of the
    sizes before it. The dealt table is written once, since another run could cut the ranges elsewhere.
    Ties are numbered in an arbitrary order, so the order should be total.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = staged(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    # The low 33 bits of the id count the rows of the partition.
    within = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(before, "_part").withColumn(out, (F.col("_before") + within + 1).cast("long")).drop("_part", "_row", "_before")


def tagged(prefix: str, width: int, c: Column) -> Column:
    """``PREFIX_000…n``; numbers longer than ``width`` are not cut."""
    text = c.cast("string")
    return F.concat(F.lit(f"{prefix}_"), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))
