"""Reports that belong together: scenarios of a model, its coefficients, and the analysis of its errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import curves, errors, train


def scenario_report(
    scored: DataFrame, score: str, label: str, features_used: Sequence[str], **options: object
) -> dict[str, DataFrame]:
    """``scenarios``, and ``summary``: size, prevalence, ranking metrics and the inputs of the model."""
    curve = curves.score_curve(scored, score, label)
    summary = curves.ranking_metrics(curve).select(
        F.col("n").alias("n_valid"),
        F.col("prevalence").alias("prevalence_valid"),
        "auroc",
        "auprc",
        F.lit(len(features_used)).cast("long").alias("n_features_used"),
        F.array(*[F.lit(c) for c in features_used]).cast("array<string>").alias("features_used"),
    )
    return {"scenarios": curves.scenario_table(scored, score, label, **options), "summary": summary}


def coefficient_report(models: Sequence[train.FittedModel], spark: SparkSession, top: int = 10) -> dict[str, DataFrame]:
    """``coefficients`` of all linear models by version, and a ``summary`` row for each with its intercept."""
    tables = [train.coefficients(m, spark).select(F.lit(m.details["version"]).alias("version"), "*") for m in models]
    return {"coefficients": train.union_all(tables), "summary": train.coefficient_summary(models, spark, top)}


def error_report(
    graded: DataFrame,
    label: str,
    predicted: str,
    score: str,
    key: str,
    numbers: Sequence[str],
    flags: Sequence[str],
    top: int = 200,
    stay: str = "stay_id",
) -> dict[str, DataFrame]:
    """What tells the errors of a model apart: counts, its worst false positives, all
    false negatives, summaries of numbers and flags by group, and their contrasts.

    ``graded`` has an ``error_group`` and is read several times; write it before.
    """
    numeric = errors.numeric_summary(graded, numbers)
    binary = errors.binary_rates(graded, flags)
    contrasts = errors.contrast(numeric, ["mean", "median"]).unionByName(
        errors.contrast(binary, ["rate_1"]), allowMissingColumns=True
    )
    return {
        "cohort_counts": errors.error_group_counts(graded, label, predicted, key, stay),
        "top_false_positives": errors.top_false_positives(graded, score, key, top),
        "all_false_negatives": errors.all_false_negatives(graded, score, key),
        "numeric_summary": numeric,
        "binary_rates": binary,
        "contrasts": contrasts,
    }
