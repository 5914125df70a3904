"""Model runs: class-weighted linear and boosted-tree models on Spark MLlib."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.util import inheritable_thread_target

from tidemark.operators.assemble import require_columns, select_candidates, split_rows
from tidemark.operators.boosting import BoostedTrees
from tidemark.operators.checks import assert_vectors_finite, union_all
from tidemark.operators.curves import ranking_metrics, score_curve
from tidemark.operators.prep import Preprocessor, drop_all_missing, fit_preprocessor
from tidemark.operators.trees import best_size, first_trees, node_table, precision_by_size
from tidemark.session import cut_lineage, shared_folder
from tidemark.specs import FAMILIES, VERSIONS, FeatureSet, Study, feature_set

PREDICTION = "y_pred_proba"
# Boosting rounds at most, and rounds without a better validation score that end the choice.
MAX_TREES, PATIENCE = 1000, 50
# Rounds before the first look at the validation rows; more follow until the patience ends the choice.
FIRST_TREES = 100
# Fits of one run that go on side by side.
FITS_AT_ONCE = 6


@dataclass
class FittedModel:
    """Preprocessing constants with the fitted MLlib pipeline."""

    prep: Preprocessor
    pipeline: PipelineModel
    label: str
    details: dict = field(default_factory=dict)

    @property
    def classifier(self):
        return self.pipeline.stages[-1]

    def score(self, df: DataFrame) -> DataFrame:
        """Adds the probability of class 1.

        Only the model's own inputs are read, so ids, times, label and split
        can never leak into the score.
        """
        require_columns(df, self.prep.inputs)
        scored = self.pipeline.transform(self.prep.apply(df))
        return scored.select(*df.columns, vector_to_array("probability")[1].alias(PREDICTION))


def fit_linear(prepared: DataFrame, n: int, n_pos: int, params: Mapping | None = None) -> LogisticRegressionModel:
    """L2 logistic regression with balanced classes and unit inverse strength.

    MLlib averages the weighted loss where the usual formulation sums it, so
    the penalty is divided by the total weight, which for balanced weights is
    the row count.  Inputs are already on their final scale.
    """
    settings = dict(
        featuresCol="features",
        labelCol="_y",
        weightCol="_w",
        regParam=1.0 / n,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=4000,
        tol=1e-6,
    )
    settings.update(params or {})
    weight = F.when(F.col("_y") == 1, n / (2.0 * n_pos)).otherwise(n / (2.0 * (n - n_pos)))
    fitted = LogisticRegression(**settings).fit(prepared.withColumn("_w", weight))
    # as fitted, a model keeps the session in its training summary, which tasks cannot carry once the session observes metrics
    place = f"{shared_folder(prepared.sparkSession)}/linear-{uuid.uuid4().hex}"
    fitted.write().save(place)
    return LogisticRegressionModel.load(place)


def fit_tree(vectors: DataFrame, n: int, n_pos: int, params: Mapping | None = None):
    """Boosted trees with weighted positives, as many as the validation rows ask for.

    MLlib can stop by the loss only, and at the first round that is no better.
    So every number of trees is judged on the validation rows, and the best one
    is kept that ``patience`` further rounds do not beat.  Rounds are seeded one
    by one, so a longer fit begins with the trees of a shorter one, and goes on
    from them: further rounds (``more_rounds``), ``maxIter`` at most, follow until
    the patience ends the choice, which is that of ``maxIter`` rounds at once.
    The trees beyond the best number are cut off the saved model; no round is
    fitted twice.
    """
    settings = dict(
        featuresCol="features",
        labelCol="_y",
        weightCol="_w",
        maxDepth=4,
        stepSize=0.05,
        subsamplingRate=0.8,
        featureSubsetStrategy="0.8",
        maxBins=64,
        maxIter=MAX_TREES,
        seed=42,
    )
    settings.update(params or {})
    patience = settings.pop("patience", PATIENCE)
    weight = F.when(F.col("_y") == 1, (n - n_pos) / max(1, n_pos)).otherwise(1.0)
    train = split_rows(vectors, "train").withColumn("_w", weight)
    most = settings["maxIter"]
    rounds = min(most, max(FIRST_TREES, 2 * patience))
    boosting: GBTClassifier = BoostedTrees(**settings)
    try:
        while True:
            fitted = boosting.setMaxIter(rounds).fit(train)
            place = f"{shared_folder(vectors.sparkSession)}/trees-{uuid.uuid4().hex}"
            fitted.write().save(place)
            nodes = node_table(vectors.sparkSession, place)
            precision = precision_by_size(split_rows(vectors, "valid"), nodes, list(fitted.treeWeights))
            size = best_size(precision, patience)
            if rounds == most or size + patience <= len(precision):
                break
            rounds = min(most, more_rounds(rounds, size, patience))
    finally:
        boosting.release()
    return first_trees(fitted, place, size) if size < fitted.getNumTrees else fitted


def more_rounds(rounds: int, best: int, patience: int) -> int:
    """Rounds in all up to the next look, as ``rounds`` of them left the choice open.

    Twice as many while the last round is the best.  Otherwise what the patience
    asks of the best round so far, and a quarter more rounds at least, so that
    few looks follow one another.
    """
    return 2 * rounds if best == rounds else max(best + patience, rounds + rounds // 4)


def train_model(
    df: DataFrame,
    features: FeatureSet,
    label: str,
    *,
    drop_all_missing_train: bool = False,
    check_finite: bool = False,
    params: Mapping | None = None,
    written: bool = False,
) -> FittedModel:
    """Fit one model on the train rows of a split table.

    Candidates absent from the table are ignored.  Columns without any train
    value are dropped on request by the linear family and always by the tree
    family, and reported.  ``params`` override the estimator's settings.  A linear
    fit reads a ``written`` table where it is, without a copy of its columns.
    """
    require_columns(df, ["split", label])
    picked = select_candidates(df, features.columns)
    # The raw columns are read by several fits; compute them once.
    raw = df.select(label, "split", *picked)
    # what a boosted fit samples follows from how its rows lie in files, so trees keep a table of their own
    if not (written and features.family == "linear"):
        raw = cut_lineage(raw)
    train = split_rows(raw, "train")

    sizes = {
        row["split"]: (row["n"], row["pos"])
        for row in raw.groupBy("split")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("int")).alias("pos"))
        .where(F.col("split").isin("train", "valid"))
        .collect()
    }
    if set(sizes) != {"train", "valid"}:
        raise ValueError("train or valid split is empty")
    n, n_pos = sizes["train"]
    if n_pos in (0, n):
        raise ValueError("train split holds a single class")

    kept, dropped = picked, []
    if drop_all_missing_train or features.family == "tree":
        kept, dropped = drop_all_missing(train, picked)
    used = replace(
        features,
        continuous=[c for c in dict.fromkeys(features.continuous) if c in kept],
        binary=[c for c in dict.fromkeys(features.binary) if c in kept],
        categorical=[c for c in dict.fromkeys(features.categorical) if c in kept],
    )
    if not used.columns:
        raise ValueError("no usable columns")

    prep = fit_preprocessor(train, used)
    prepared = prep.apply(raw).withColumn("_y", F.col(label).cast("double"))
    if check_finite:
        assert_vectors_finite(split_rows(prepared, "train"), prep.number_columns, train, used.columns)
    stages = prep.stages(df.sparkSession)
    # without the encoder's attributes trees treat all inputs as numbers, and need no name for each category
    features_only = F.col("features").alias("features", metadata={})
    vectors = PipelineModel(stages).transform(prepared).select("_y", "split", features_only)
    if features.family == "linear":
        fitted = fit_linear(split_rows(vectors, "train"), n, n_pos, params)
    else:
        fitted = fit_tree(vectors, n, n_pos, params)

    details = {
        "version": features.version,
        "family": features.family,
        "label": label,
        "features_used": used.columns,
        "continuous_used": list(used.continuous),
        "binary_used": list(used.binary),
        "categorical_used": list(used.categorical),
        "dropped_all_missing_train": dropped,
        "dropped_by_kind": {
            kind: [c for c in dict.fromkeys(names) if c in dropped]
            for kind, names in (
                ("continuous", features.continuous), ("binary", features.binary), ("categorical", features.categorical)
            )
        },
    }
    if features.family == "tree":
        details["positive_weight"] = (n - n_pos) / max(1, n_pos)
        details["best_iteration"] = fitted.getNumTrees
    model = FittedModel(prep, PipelineModel([*stages, fitted]), label, details)
    metrics = training_metrics(model, raw).collect()
    details["metrics"] = {row["split"]: row.asDict() for row in metrics}
    if features.family == "tree":
        # sizes are compared on binned scores; what is reported is exact
        details["best_score"] = details["metrics"]["valid"]["auprc"]
    return model


def training_metrics(model: FittedModel, df: DataFrame) -> DataFrame:
    """``n, prevalence, auroc, auprc`` for train and valid."""
    scored = model.score(df.where(F.col("split").isin("train", "valid")))
    return ranking_metrics(score_curve(scored, PREDICTION, model.label, ["split"], bounded_groups=True), ["split"])


def metrics_report(models: Sequence[FittedModel], spark: SparkSession) -> DataFrame:
    """One row per (run, split) from the metrics stored on each model."""
    rows = [
        (m.details["version"], m.details["family"], split, v["n"], v["prevalence"], v["auroc"], v["auprc"])
        for m in models
        for split, v in sorted(m.details["metrics"].items())
    ]
    schema = "version string, family string, split string, n long, prevalence double, auroc double, auprc double"
    return spark.createDataFrame(rows, schema)


def train_by_version(
    splits: Mapping[str, DataFrame],
    study: Study,
    families: Sequence[str] = FAMILIES,
    params: Mapping[str, Mapping] | None = None,
    at_once: int = FITS_AT_ONCE,
    written: bool = False,
) -> dict[tuple[str, str], FittedModel]:
    """Every version with a split table, in each family, several fits at once.

    A fit is a long row of short jobs, so fits side by side fill the cores that
    each leaves idle.  Each has a scheduler pool of its own, which shares the
    cores fairly where the session's scheduler is fair.  Each split table is read
    by several fits and is best written before (``FeaturePlan.written_splits``);
    ``written`` says that all are.
    A fit that fails ends the run with its error.
    """
    runs = [(v, f) for f in sorted(families, reverse=True) for v in reversed(VERSIONS) if v in splits]

    def fit(run: tuple[str, str]) -> FittedModel:
        version, family = run
        spark = splits[version].sparkSession
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{version}-{family}")
        try:
            return train_model(
                splits[version],
                feature_set(study, version, family),
                study.label,
                drop_all_missing_train=True,
                check_finite=version == "V6",
                params=(params or {}).get(family),
                written=written,
            )
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        # trees take longest and are started first
        started = {run: pool.submit(inheritable_thread_target(fit), run) for run in runs}
        try:
            done = {run: future.result() for run, future in started.items()}
        except BaseException:
            pool.shutdown(cancel_futures=True)
            raise
    return {(v, f): done[v, f] for v in VERSIONS if v in splits for f in families}


def scored_runs(
    models: Mapping[tuple[str, str], FittedModel], splits: Mapping[str, DataFrame], key: str, cohorts: Mapping[str, str]
) -> DataFrame:
    """``model, version, cohort, key``, label and score of every run on the validation rows of its version.

    ``cohorts`` names the cohort of a version where it is not all entities.
    """
    parts = []
    for (version, family), model in models.items():
        scored = model.score(split_rows(splits[version], "valid"))
        tags = {"model": family, "version": version, "cohort": cohorts.get(version, "all")}
        parts.append(scored.select(*[F.lit(v).alias(c) for c, v in tags.items()], key, model.label, PREDICTION))
    return union_all(parts)


def coefficients(model: FittedModel, spark: SparkSession) -> DataFrame:
    """``feature, type, coef, odds_ratio, abs_coef``, largest first."""
    if not hasattr(model.classifier, "coefficients"):
        raise TypeError("coefficients exist for linear models only")
    values = [(i, float(v)) for i, v in enumerate(model.classifier.coefficients)]
    named = len(model.prep.numbers) + sum(model.prep.sizes.values())
    if named != len(values):
        raise ValueError(f"{named} names for {len(values)} coefficients")
    rows = model.prep.input_names(spark).join(spark.createDataFrame(values, "input long, coef double"), "input")
    return rows.select(
        "feature", "type", "coef", F.exp("coef").alias("odds_ratio"), F.abs("coef").alias("abs_coef")
    ).orderBy(F.desc("abs_coef"), "feature")


def coefficient_summary(models: Sequence[FittedModel], spark: SparkSession, top: int = 10) -> DataFrame:
    """One row per linear model: intercept, its odds, number of inputs by kind, and the ``top`` largest coefficients."""
    parts = []
    for model in models:
        table = coefficients(model, spark)
        entry = F.struct("abs_coef", "feature", "type", "coef", "odds_ratio")
        largest = F.slice(F.sort_array(F.collect_list(entry), asc=False), 1, top)
        kinds = [F.count_if(F.col("type") == k).alias(f"n_{name}") for k, name in (("cont", "continuous"), ("bin", "binary"), ("cat", "categories"))]
        named = table.orderBy(F.desc("abs_coef"), "feature").limit(top).agg(largest.alias("top_features"))
        counts = table.agg(F.count(F.lit(1)).alias("n_total_features"), *kinds)
        parts.append(
            counts.select(
                F.lit(model.details["version"]).alias("version"),
                F.lit(intercept(model)).alias("intercept"),
                F.exp(F.lit(intercept(model))).alias("odds_at_zero"),
                "*",
                named.scalar().alias("top_features"),
            )
        )
    return union_all(parts)


def linear_probability(df: DataFrame, weights: Mapping[str, float], bias: float) -> DataFrame:
    """Probability of class 1 from known coefficients, as one expression."""
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(bias))
    return df.withColumn(PREDICTION, 1.0 / (1.0 + F.exp(-total)))


def intercept(model: FittedModel) -> float:
    return float(model.classifier.intercept)


def top_by(df: DataFrame, magnitude: str, name: str, n: int) -> DataFrame:
    """The ``n`` rows of largest magnitude, ties by name."""
    return df.orderBy(F.desc(magnitude), F.asc(name)).limit(n)


def compare_models(reports: Mapping[tuple[str, str, str], DataFrame]) -> DataFrame:
    """Stack evaluation tables; keys are (model, version, cohort)."""
    parts = []
    for (model, version, cohort), df in reports.items():
        tags = [F.lit(model).alias("model"), F.lit(version).alias("version"), F.lit(cohort).alias("cohort")]
        parts.append(df.select(*tags, "*"))
    return union_all(parts)
