"""Numbers of rows in a global order, from range partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import cut_lineage


def numbered(df: DataFrame, order: Sequence[Column], into: str) -> DataFrame:
    """``df`` with the 0-based number of each row in ascending ``order`` (or descending, where a column says so).

    Rows are written once, so that neither sampling the ranges nor ranking
    evaluates ``df`` again; then each range partition is sorted and starts from
    the number of rows before it.  Values held by many rows are spread by the
    later columns of ``order``, which should tell all rows apart.
    """
    ranged = cut_lineage(df).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("_row", F.monotonically_increasing_id()))
    part = F.expr("shiftright(_row, 33)")
    # a row for each partition, whose number is set by the session
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
        .select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    )
    return placed.join(F.broadcast(starts), part == F.col("_part")).select(
        *df.columns, (F.col("_row") + F.col("_shift")).alias(into)
    )
