"""Profiles and hard gates over pipeline tables.

Profiles return small tables.  Each gate exists as a table of violations and
as an ``assert_*`` form that raises ``QualityError``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class QualityError(ValueError):
    """A table breaks a rule that later stages rely on."""


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), parts)


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


# --- profiles ---------------------------------------------------------------


def object_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per named table, ordered by name."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("obj"), "n") for name, df in tables.items()]
    return union_all(parts).orderBy("obj")


def key_profile(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Rows, distinct keys and null keys per named table."""
    parts = []
    for name, df in tables.items():
        # one row per key first: the distinct count is then a plain sum
        per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
        parts.append(
            per_key.agg(
                F.coalesce(F.sum("rows"), F.lit(0)).alias("n"),
                F.count(key).alias("n_distinct"),
                F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("rows"))), F.lit(0)).alias("n_null"),
            ).select(F.lit(name).alias("obj"), "n", "n_distinct", "n_null")
        )
    return union_all(parts).orderBy("obj")


def counts_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count per value combination, ordered."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(*columns)


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``n`` and ``<column>_null_rate`` with four decimals."""
    rates = [F.round(F.avg(F.col(c).isNull().cast("int")), 4).alias(f"{c}_null_rate") for c in columns]
    return df.agg(F.count(F.lit(1)).alias("n"), *rates)


def missing_ranking(df: DataFrame, columns: Sequence[str], top: int = 20) -> DataFrame:
    """Raw missing rate per column, highest first."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing_rate")) for c in columns])
    return wide.select(F.inline(pairs)).orderBy(F.desc("missing_rate"), "feature").limit(top)


def split_rule_profile(df: DataFrame, driver: str) -> DataFrame:
    """Range of the split driver and row count per split."""
    return (
        df.groupBy("split")
        .agg(
            F.min(driver).alias(f"min_{driver}"),
            F.max(driver).alias(f"max_{driver}"),
            F.count(F.lit(1)).alias("n"),
        )
        .orderBy("split")
    )


def prevalence(df: DataFrame, label: str, by: Sequence[str] = ("split",)) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(label).alias("prevalence"), F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Class counts, positive weight, and balanced weight of each class."""
    positive, n = F.sum(label), F.count(F.lit(1))
    return df.agg(positive.alias("n_pos"), (n - positive).alias("n_neg")).select(
        "n_pos",
        "n_neg",
        (F.col("n_neg") / F.greatest(F.lit(1), F.col("n_pos"))).alias("pos_weight"),
        F.try_divide(F.col("n_pos") + F.col("n_neg"), 2 * F.col("n_neg")).alias("balanced_0"),
        F.try_divide(F.col("n_pos") + F.col("n_neg"), 2 * F.col("n_pos")).alias("balanced_1"),
    )


def vital_coverage(features: DataFrame, missing: Sequence[str], stays: DataFrame, entity: str) -> DataFrame:
    """Share of entities with any and with no vital: overall and by stay status."""
    owners = stays.select(entity).where(F.col(entity).isNotNull()).distinct().withColumn("_owner", F.lit(1))
    status = F.when(F.col("_owner") == 1, "with_stay").otherwise("without_stay")
    rows = features.join(owners, entity, "left").select(
        F.explode(F.array(F.lit("all"), status)).alias("cohort"),
        F.least(*[F.col(c) for c in missing]).alias("none"),
    )
    return rows.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(1 - F.col("none")).alias("any_rate"),
        F.avg("none").alias("none_rate"),
    )


def sample_rows(df: DataFrame, columns: Sequence[str], key: str, n: int = 10) -> DataFrame:
    """First ``n`` rows by key."""
    return df.select(*columns).orderBy(key).limit(n)


# --- gates ------------------------------------------------------------------


def presence(spark: SparkSession, names: Sequence[str]) -> dict[str, bool]:
    return {name: spark.catalog.tableExists(name) for name in names}


def assert_tables_exist(spark: SparkSession, names: Sequence[str]) -> None:
    absent = [name for name, there in presence(spark, names).items() if not there]
    if absent:
        raise QualityError("missing tables: " + ", ".join(absent))


def row_count_violations(base: DataFrame, features: DataFrame, split: DataFrame) -> DataFrame:
    """Adjacent stages whose row counts differ; counted in one job."""
    counts = union_all(
        [
            df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), "n")
            for stage, df in (("base", base), ("features", features), ("split", split))
        ]
    )
    wide = counts.agg(
        *[F.max(F.when(F.col("stage") == s, F.col("n"))).alias(s) for s in ("base", "features", "split")]
    )
    pairs = F.array(
        F.struct(F.lit("features<>base").alias("check"), F.col("features").alias("n"), F.col("base").alias("expected")),
        F.struct(F.lit("split<>features").alias("check"), F.col("split").alias("n"), F.col("features").alias("expected")),
    )
    return wide.select(F.inline(pairs)).where(F.col("n") != F.col("expected"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def invalid_labels(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNull() | ~F.col(label).isin(0, 1))


def entities_with_stay(df: DataFrame, stays: DataFrame, entity: str) -> DataFrame:
    """Rows of a supposed no-stay cohort that do have a stay."""
    return df.join(stays.select(entity).distinct(), entity, "left_semi").select(entity)


def unknown_error_groups(df: DataFrame) -> DataFrame:
    return df.where(F.col("error_group") == "UNKNOWN")


def assert_none(violations: DataFrame, message: str) -> None:
    """Raise with a few example rows when there are violations."""
    examples = violations.limit(5).collect()
    if examples:
        raise QualityError(f"{message}: e.g. {[row.asDict() for row in examples]}")


def assert_row_counts_match(base: DataFrame, features: DataFrame, split: DataFrame) -> None:
    assert_none(row_count_violations(base, features, split), "row counts differ")


def assert_unique_key(df: DataFrame, keys: Sequence[str]) -> None:
    assert_none(duplicate_keys(df, keys), f"duplicate {list(keys)}")


def assert_label_valid(df: DataFrame, label: str) -> None:
    assert_none(invalid_labels(df, label), f"{label} must be 0 or 1")


def assert_no_stay(df: DataFrame, stays: DataFrame, entity: str) -> None:
    assert_none(entities_with_stay(df, stays, entity), "no-stay cohort contains stays")


def assert_known_error_group(df: DataFrame) -> None:
    assert_none(unknown_error_groups(df), "rows without a TP/FP/FN/TN group")


def nonfinite_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the number of null or NaN values per column."""
    return df.agg(*[_count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns])


def assert_vectors_finite(prepared: DataFrame, columns: Sequence[str], raw: DataFrame, raw_columns: Sequence[str]) -> None:
    """After preprocessing no input may be null or NaN."""
    bad = {c: n for c, n in nonfinite_counts(prepared, columns).first().asDict().items() if n}
    if bad:
        worst = [tuple(row) for row in missing_ranking(raw, raw_columns).collect()]
        raise QualityError(f"not finite after preprocessing: {bad}; highest raw missing rates: {worst}")
