"""Exact ranks, running sums and quantiles without a single-partition sort.

A global ordered window puts every row into one task.  Here the ordered
column is cut into buckets at approximate quantiles; each bucket is scanned
on its own and starts from the total of the buckets before it.  The cut
points only balance the work: results do not depend on where they fall.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.ranges import numbered

BUCKETS = 256  # a power of two
ACCURACY = 10_000


def _cut_points(column: Column, buckets: int) -> Column:
    return F.percentile_approx(column, [i / buckets for i in range(1, buckets)], ACCURACY)


def _place(df: DataFrame, value: str, cuts: Column, bucket: str, buckets: int) -> DataFrame:
    """Add the number of cut points below ``value`` (0 for null).

    A binary search unrolled into one small projection per halving, so that it
    stays in generated code.  The result is never null: a nullable join key
    would be tested before the counting aggregate, once per input row.
    """
    placed = df.withColumn(bucket, F.lit(0))
    step = buckets // 2
    while step:
        above = F.get(cuts, F.col(bucket) + (step - 1)) < F.col(value)
        placed = placed.withColumn(bucket, F.col(bucket) + F.when(above, step).otherwise(0))
        step //= 2
    return placed


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``n`` rows per (group, value), null values included."""
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def prefix_sums(
    df: DataFrame,
    value: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    buckets: int = BUCKETS,
    bounded_groups: bool = False,
    needed: Column | None = None,
) -> DataFrame:
    """Add ``cum_<s>``, ``total_<s>`` for each of ``sums``, and ``next_value``.

    ``df`` holds one row per (by, value) with non-null ``by``.  Sums run in the
    order of ``value`` inside each group and include the row itself;
    ``next_value`` is the following value in that order.  ``bounded_groups``
    states that the number of groups is set by the caller and not by the data
    (columns, splits); the small tables per group are then broadcast.
    ``needed`` limits the result to buckets meeting a condition on
    ``_before_<s>``, ``_part_<s>`` and ``total_<s>``; the others are neither
    shuffled nor sorted.
    """
    by = list(by)

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if bounded_groups or not by else table

    # The condition is always true.  It makes this branch read the same
    # columns as the others, so that Spark runs the aggregate behind `df` once.
    present = sum((F.col(s) for s in sums), F.lit(0)) >= 0
    cut = _cut_points(F.when(present, F.col(value)), buckets)
    if by:
        placed = df.join(small(df.groupBy(*by).agg(cut.alias("_cuts"))), by)
    else:
        placed = df.withColumn("_cuts", df.agg(cut.alias("_cuts")).scalar())
    placed = _place(placed, value, F.col("_cuts"), "_bucket", buckets).drop("_cuts")

    def ordered(column: str) -> Column:
        return F.desc(column) if descending else F.asc(column)

    # At most `buckets` rows per group from here to the join.
    edge = F.max(value) if descending else F.min(value)
    parts = placed.groupBy(*by, "_bucket").agg(
        *[F.sum(s).alias(f"_part_{s}") for s in sums], edge.alias("_edge")
    )
    group = Window.partitionBy(*by)
    sequence = group.orderBy(ordered("_bucket"))
    before = sequence.rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *by,
        "_bucket",
        *[f"_part_{s}" for s in sums],
        *[F.coalesce(F.sum(f"_part_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_part_{s}").over(group).alias(f"total_{s}") for s in sums],
        F.lead("_edge").over(sequence).alias("_next_edge"),
    )

    if needed is not None:
        offsets = offsets.where(needed)
    inside = Window.partitionBy(*by, "_bucket").orderBy(ordered(value))
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(small(offsets), [*by, "_bucket"]).select(
        *df.columns,
        *[(F.col(f"_before_{s}") + F.sum(s).over(running)).alias(f"cum_{s}") for s in sums],
        *[f"total_{s}" for s in sums],
        F.coalesce(F.lead(value).over(inside), F.col("_next_edge")).alias("next_value"),
    )


def quantiles_of_counts(
    counts: DataFrame,
    value: str,
    probabilities: Mapping[str, float],
    by: Sequence[str] = (),
    buckets: int = BUCKETS,
    bounded_groups: bool = False,
) -> DataFrame:
    """Linearly interpolated quantiles per group from ``value_counts``.

    Exact, nulls ignored; a group without values has no row.  Repeated values
    cost one row each, and only the buckets that hold a wanted rank are sorted.
    """
    by = list(by)
    valid = counts.withColumn("n", F.when(F.col(value).isNull(), 0).otherwise(F.col("n")))
    ranks = {}
    for i, p in enumerate(probabilities.values()):
        position = (F.col("total_n") - 1) * F.lit(float(p))
        ranks[f"_low{i}"], ranks[f"_high{i}"] = F.floor(position), F.ceil(position)
    inside = [(F.col("_before_n") <= r) & (r < F.col("_before_n") + F.col("_part_n")) for r in ranks.values()]
    ranked = prefix_sums(
        valid,
        value,
        ["n"],
        by,
        buckets=buckets,
        bounded_groups=bounded_groups,
        needed=reduce(lambda one, other: one | other, inside),
    )
    picks = [F.min(F.when(F.col("cum_n") > r, F.col(value))).alias(name) for name, r in ranks.items()]
    results = []
    for i, (name, p) in enumerate(probabilities.items()):
        position = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        results.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return ranked.groupBy(*by).agg(*picks, F.max("total_n").alias("_n")).select(*by, *results)


def global_rank(df: DataFrame, score: str, key: str, rank: str = "rank_desc") -> DataFrame:
    """1-based rank by descending ``score``, ties by ascending unique ``key``; null scores come last.

    Rows are range-partitioned by score and key, so rows that share a score are
    spread by their keys.  The key is of any type that Spark can order.
    """
    placed = numbered(df, [F.desc(score), F.asc(key)], "_place")
    return placed.select(*df.columns, (F.col("_place") + 1).alias(rank))
