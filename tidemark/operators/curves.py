"""Ranking metrics over distinct scores: exact under ties, any number of rows.

Everything here starts from one map-side combined count per distinct score.
``by`` computes each result per group, e.g. per period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.prefix import BUCKETS, prefix_sums

EPS = 1e-12


def score_counts(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and positives per distinct score."""
    return (
        scored.select(*by, F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("_y"))
        .groupBy(*by, "score")
        .agg(F.sum("_y").alias("pos"), F.count(F.lit(1)).alias("n"))
    )


def score_curve(
    scored: DataFrame,
    score: str,
    label: str,
    by: Sequence[str] = (),
    buckets: int = BUCKETS,
    bounded_groups: bool = False,
) -> DataFrame:
    """Per distinct score: counts at ``score >= threshold``, precision, recall, F1.

    ``cum_pos`` and ``cum_n`` are true positives and alerts; ``next_value`` is
    the next lower distinct score.
    """
    counts = score_counts(scored, score, label, by)
    summed = prefix_sums(
        counts, "score", ["pos", "n"], by, descending=True, buckets=buckets, bounded_groups=bounded_groups
    )
    precision = F.col("cum_pos") / F.col("cum_n")
    # without positives every threshold has full recall
    recall = F.when(F.col("total_pos") > 0, F.try_divide("cum_pos", "total_pos")).otherwise(1.0)
    curve = summed.withColumns({"precision": precision, "recall": recall})
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPS)
    return curve.withColumn("f1", f1)


def _negatives() -> Column:
    return F.col("total_n") - F.col("total_pos")


def _auroc_terms() -> Column:
    """Negatives at a score, each beaten by the positives above and half the ties."""
    return (F.col("n") - F.col("pos")) * (F.col("cum_pos") - F.col("pos") / 2.0)


def ranking_metrics(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``n, prevalence, auroc, auprc``; an undefined metric is null."""
    sums = curve.groupBy(*by).agg(
        F.max("total_n").alias("n"),
        F.max("total_pos").alias("_p"),
        F.max(_negatives()).alias("_q"),
        F.sum(_auroc_terms()).alias("_wins"),
        F.sum(F.col("pos") * F.col("precision")).alias("_steps"),
    )
    return sums.select(
        *by,
        "n",
        (F.col("_p") / F.col("n")).alias("prevalence"),
        F.try_divide(F.col("_wins"), F.col("_p").cast("double") * F.col("_q")).alias("auroc"),
        F.try_divide(F.col("_steps"), F.col("_p")).alias("auprc"),
    )


def auroc(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half."""
    return ranking_metrics(score_curve(scored, score, label, by), by).select(*by, "auroc")


def average_precision(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of precision over recall steps; no interpolation between points."""
    return ranking_metrics(score_curve(scored, score, label, by), by).select(*by, "auprc")


def pr_curve(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall per threshold and the closing point (1, 0)."""
    points = curve.select(*by, F.col("score").alias("threshold"), "precision", "recall")
    groups = curve.select(*by).distinct() if by else curve.agg(F.max("total_n").alias("_n")).where("_n > 0")
    closing = groups.select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(closing)


# --- thresholds -------------------------------------------------------------
#
# Three alignments of curve points and thresholds are offered.
#   step_below  the point's next lower score; the lowest point is not a candidate
#   clamped     the point's next lower score, or the lowest score itself
#   exact       the point's own score


def best_f1(align: str = "step_below") -> Column:
    """Aggregate over a curve: threshold of the largest F1, ties to the lowest score."""
    order = F.struct(F.col("f1"), -F.col("score"))
    if align == "exact":
        best = F.max_by("score", order)
    elif align == "clamped":
        best = F.max_by(F.coalesce("next_value", "score"), order)
    elif align == "step_below":
        best = F.max_by("next_value", F.when(F.col("next_value").isNotNull(), order))
    else:
        raise ValueError(f"unknown alignment {align}")
    return F.coalesce(best, F.min("score"), F.lit(0.5))


def for_recall(target: float, align: str = "step_below") -> Column:
    """Aggregate over a curve: threshold that reaches a recall target.

    No qualifying point gives the lowest score, no scores at all 0.5.
    """
    if align not in ("step_below", "exact"):
        raise ValueError(f"unknown alignment {align}")
    if target <= 0:
        return F.coalesce(F.max("score"), F.lit(0.5))
    source = "next_value" if align == "step_below" else "score"
    reached = F.max(F.when(F.col("recall") >= target, F.col(source)))
    return F.coalesce(reached, F.min("score"), F.lit(0.5))


def for_top_k(k: int) -> Column:
    """Aggregate over a curve: score at rank ``k``; equal scores may add alerts."""
    if k <= 0:
        return F.lit(1.0)
    at_rank = F.max(F.when(F.col("cum_n") >= k, F.col("score")))
    return F.when(F.coalesce(F.max("total_n"), F.lit(0)) <= k, 0.0).otherwise(at_rank)


def confusion_columns(tp: Column, alerts: Column, positives: Column, n: Column) -> list[Column]:
    """PPV, recall, specificity, F1, alerts and the four counts."""
    fp, fn = alerts - tp, positives - tp
    tn = n - alerts - fn
    ppv, recall = tp / (tp + fp + EPS), tp / (tp + fn + EPS)
    return [
        ppv.alias("ppv"),
        recall.alias("recall"),
        (tn / (tn + fp + EPS)).alias("specificity"),
        (2 * ppv * recall / (ppv + recall + EPS)).alias("f1"),
        alerts.alias("alerts"),
        tn.alias("tn"),
        fp.alias("fp"),
        fn.alias("fn"),
        tp.alias("tp"),
    ]


def threshold_report(scored: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts and rates at fixed thresholds, all in one aggregate."""
    y, s = F.col(label), F.col(score)
    counts = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(y), F.lit(0)).alias("p")]
    for i, t in enumerate(thresholds):
        counts.append(F.count(F.when(s >= float(t), 1)).alias(f"a{i}"))
        counts.append(F.count(F.when((s >= float(t)) & (y == 1), 1)).alias(f"tp{i}"))
    rows = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("_tp"), F.col(f"a{i}").alias("_alerts"))
            for i, t in enumerate(thresholds)
        ]
    )
    long = scored.agg(*counts).select("n", "p", F.inline(rows))
    return long.select(
        "threshold", *confusion_columns(F.col("_tp"), F.col("_alerts"), F.col("p"), F.col("n"))
    )


def scenario_columns(
    recalls: Sequence[float], budgets: Sequence[int], align: str = "step_below"
) -> dict[str, Column]:
    """Named threshold aggregates: best F1, recall targets, alert budgets."""
    named = {"F1_best": best_f1(align)}
    named.update({f"Recall_{int(r * 100)}%": for_recall(r, align) for r in recalls})
    named.update({f"Top{k}": for_top_k(k) for k in budgets})
    return named


def summarize_scenarios(curve: DataFrame, scenarios: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """One row per (group, scenario): its threshold and what happens at it."""
    by = list(by)
    fields = [f"t{i}" for i in range(len(scenarios))]
    chosen = curve.groupBy(*by).agg(*[c.alias(f) for f, c in zip(fields, scenarios.values())])
    if by:
        rows = curve.join(chosen, by)
    else:
        packed = chosen.select(F.struct(*fields).alias("_t"))
        rows = curve.withColumn("_t", packed.scalar()).select("*", *[F.col(f"_t.{f}").alias(f) for f in fields])
    counts = [F.max("total_n").alias("n"), F.max("total_pos").alias("p")]
    for f in fields:
        reached = F.col("score") >= F.col(f)
        counts += [
            F.max(f).alias(f),
            F.coalesce(F.sum(F.when(reached, F.col("pos"))), F.lit(0)).alias(f"{f}_tp"),
            F.coalesce(F.sum(F.when(reached, F.col("n"))), F.lit(0)).alias(f"{f}_alerts"),
        ]
    long = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                F.col(f).alias("threshold"),
                F.col(f"{f}_tp").alias("_tp"),
                F.col(f"{f}_alerts").alias("_alerts"),
            )
            for name, f in zip(scenarios, fields)
        ]
    )
    flat = rows.groupBy(*by).agg(*counts).where(F.col("n").isNotNull()).select(*by, "n", "p", F.inline(long))
    return flat.select(
        *by,
        "scenario",
        "threshold",
        *confusion_columns(F.col("_tp"), F.col("_alerts"), F.col("p"), F.col("n")),
    )


def scenario_table(
    scored: DataFrame,
    score: str,
    label: str,
    recalls: Sequence[float] = (0.4, 0.5, 0.6),
    budgets: Sequence[int] = (1000, 3000),
    align: str = "step_below",
    by: Sequence[str] = (),
) -> DataFrame:
    """Decision scenarios side by side."""
    curve = score_curve(scored, score, label, by)
    return summarize_scenarios(curve, scenario_columns(recalls, budgets, align), by)


def scenario_comparison(
    scored: DataFrame,
    score: str,
    label: str,
    by: Sequence[str] = ("model", "version", "cohort"),
    recalls: Sequence[float] = (0.4, 0.5, 0.6),
    budgets: Sequence[int] = (1000, 3000),
    align: str = "step_below",
) -> DataFrame:
    """Every scenario of every scored run, with the run's size, prevalence and ranking metrics.

    ``by`` tells the runs apart, whose number is set by the caller.  One curve
    serves them all.
    """
    curve = score_curve(scored, score, label, by, bounded_groups=True)
    scenarios = summarize_scenarios(curve, scenario_columns(recalls, budgets, align), by)
    return scenarios.join(F.broadcast(ranking_metrics(curve, by)), list(by))


def generic_report(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Ranking metrics with the summaries at 0.5 and at the best F1, one row each."""
    curve = score_curve(scored, score, label)
    at = summarize_scenarios(curve, {"at_0_5": F.lit(0.5), "at_best_f1": best_f1("clamped")})
    packed = ranking_metrics(curve).select(F.struct("n", "prevalence", "auroc", "auprc").alias("_m"))
    return at.withColumn("_m", packed.scalar()).select("*", "_m.*").drop("_m")


def metrics_by_period(
    scored: DataFrame, score: str, label: str, period: str, budget: int, few_periods: bool = False
) -> DataFrame:
    """Prevalence, AUROC, AUPRC and PPV at a fixed alert budget per period.

    ``few_periods`` states that their number does not grow with the data, as
    that of years does not; the small tables of each period are then broadcast.
    """
    curve = score_curve(scored, score, label, [period], bounded_groups=few_periods)
    at_budget = summarize_scenarios(curve, {"budget": for_top_k(budget)}, [period])
    return ranking_metrics(curve, [period]).join(
        at_budget.select(period, "threshold", "ppv", "alerts"), period
    )


def score_histogram(scored: DataFrame, score: str, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins from the lowest to the highest score.

    The last bin is closed; empty bins are kept; equal scores get a unit range.
    """
    ends = scored.agg(F.struct(F.min(score).cast("double").alias("lo"), F.max(score).cast("double").alias("hi")))
    flat = F.col("_e.lo") == F.col("_e.hi")
    rows = scored.where(F.col(score).isNotNull()).select(
        F.col(score).cast("double").alias("s"), ends.scalar().alias("_e")
    )
    rows = rows.select(
        "s",
        F.when(flat, F.col("_e.lo") - 0.5).otherwise(F.col("_e.lo")).alias("lo"),
        F.when(flat, F.col("_e.hi") + 0.5).otherwise(F.col("_e.hi")).alias("hi"),
    )
    # divide by the width first so that a bin's lower edge falls into it
    slot = F.floor((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    counted = (
        rows.withColumn("bin", F.least(slot, F.lit(bins - 1)).cast("int"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
