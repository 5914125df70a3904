"""Scored rows: prediction columns, error groups and what sets them apart."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import no_nan
from tidemark.functions.prefix import global_rank
from tidemark.functions.quantiles import exact_quantiles

GROUPS = ("TP", "FP", "FN", "TN")
# which group is set against which
CONTRASTS = (("FP", "TN"), ("FN", "TP"))


def add_prediction_columns(scored: DataFrame, score: str, key: str) -> DataFrame:
    """``y_pred_proba``, its label at 0.5, and the rank by descending score."""
    flagged = scored.withColumn("y_pred_proba", F.col(score).cast("double")).withColumn(
        "y_pred_label_05", (F.col("y_pred_proba") >= 0.5).cast("int")
    )
    return global_rank(flagged, "y_pred_proba", key)


def _number(column: str):
    """Numeric reading of a column; what is no number is null."""
    return no_nan(F.col(column).try_cast("double"))


def error_groups(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Adds ``error_group``: TP, FP, FN, TN, or UNKNOWN for unreadable labels."""
    y, p = _number(label), _number(predicted)
    group = (
        F.when((y == 1) & (p == 1), "TP")
        .when((y == 0) & (p == 1), "FP")
        .when((y == 1) & (p == 0), "FN")
        .when((y == 0) & (p == 0), "TN")
        .otherwise("UNKNOWN")
    )
    return df.withColumn("error_group", group)


def error_group_counts(
    df: DataFrame, label: str, predicted: str, entity: str = "hadm_id", stay: str = "stay_id"
) -> DataFrame:
    """One row: size, rates, counts per group, distinct entities and stays."""
    keys = {key: name for key, name in ((entity, "n_unique_entity"), (stay, "n_unique_stay")) if key in df.columns}
    label_value, predicted_value = _number(label), _number(predicted)
    sums = {
        "n_total": F.count(F.lit(1)),
        "_labels": F.count(label_value),
        "_label": F.sum(label_value),
        "_predictions": F.count(predicted_value),
        "_predicted": F.sum(predicted_value),
        **{f"n_{g.lower()}": F.count_if(F.col("error_group") == g) for g in GROUPS},
    }
    # rows of an entity and stay are combined first; all counts, the distinct ones too, come from these
    each = df.groupBy(*keys).agg(*[c.alias(name) for name, c in sums.items()])
    total = each.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) if name.startswith("n_") else F.sum(name).alias(name) for name in sums],
        *[F.count_distinct(F.col(key)).alias(name) for key, name in keys.items()],
    )
    out = total.select(
        "n_total",
        F.try_divide("_label", "_labels").alias("label_prevalence"),
        F.try_divide("_predicted", "_predictions").alias("pred_positive_rate_05"),
        *[f"n_{g.lower()}" for g in GROUPS],
        *keys.values(),
    )
    if entity in keys:
        out = out.withColumn("n_duplicate_rows", F.col("n_total") - F.col("n_unique_entity"))
    return out


def top_false_positives(df: DataFrame, score: str, key: str, n: int = 200) -> DataFrame:
    """The ``n`` false positives with the highest scores."""
    return df.where(F.col("error_group") == "FP").orderBy(F.desc(score), F.asc(key)).limit(n)


def all_false_negatives(df: DataFrame, score: str, key: str) -> DataFrame:
    """Every false negative, highest score first (a range-partitioned sort)."""
    return df.where(F.col("error_group") == "FN").orderBy(F.desc(score), F.asc(key))


def _grouped_numbers(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``group`` and the numbers of graded rows; absent columns are skipped."""
    present = [c for c in columns if c in df.columns]
    if not present:
        raise ValueError("none of the columns to summarize is present")
    numbers = df.where(F.col("error_group").isin(*GROUPS)).select(
        F.col("error_group").alias("group"), *[_number(c).alias(c) for c in present]
    )
    return numbers, present


def _by_feature(rows: DataFrame, columns: Sequence[str], measures: Mapping[str, Callable[[str], Column]]) -> DataFrame:
    """``group, feature`` and the measures, from one aggregate over all columns."""
    wide = rows.groupBy("group").agg(
        *[measure(c).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, measure in measures.items()]
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), *[F.col(f"{name}_{i}").alias(name) for name in measures])
            for i, c in enumerate(columns)
        ]
    )
    return wide.select("group", F.inline(entries))


def _missing_rate(column: str) -> Column:
    return 1 - F.count(column) / F.count(F.lit(1))


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per (group, feature): non-missing count, missing rate, mean and quartiles.

    ``df`` is read four times, so a long plan is best written before.
    """
    rows, present = _grouped_numbers(df, columns)
    moments = _by_feature(rows, present, {"n_nonmissing": F.count, "missing_rate": _missing_rate, "mean": F.avg})
    quartiles = exact_quantiles(rows, present, {"median": 0.5, "p25": 0.25, "p75": 0.75}, ["group"])
    return moments.join(F.broadcast(quartiles), ["group", "feature"], "left")


def binary_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per (group, flag): non-missing count, missing rate, rate and count of 1."""
    rows, present = _grouped_numbers(df, columns)
    measures = {
        "n_nonmissing": F.count,
        "missing_rate": _missing_rate,
        "rate_1": F.avg,
        "count_1": lambda c: F.count_if(F.col(c) == 1),
    }
    return _by_feature(rows, present, measures)


def contrast(summary: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Differences of group summaries per feature: FP minus TN, FN minus TP."""
    picked = []
    for m in measures:
        for g in GROUPS:
            picked.append(F.max(F.when(F.col("group") == g, F.col(m))).alias(f"{g}_{m}"))
    wide = summary.groupBy("feature").agg(*picked)
    rows = F.array(
        *[
            F.struct(
                F.lit(f"{left}-{right}").alias("contrast"),
                *[(F.col(f"{left}_{m}") - F.col(f"{right}_{m}")).alias(f"diff_{m}") for m in measures],
            )
            for left, right in CONTRASTS
        ]
    )
    return wide.select("feature", F.inline(rows))
