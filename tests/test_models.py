from itertools import combinations
from math import factorial, log

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import attributions, train
from tidemark.operators.curves import ranking_metrics, score_curve
from tidemark.plans.clinical import CLINICAL
from tidemark.plans.star import STAR, star_plan
from tidemark.sources import artifacts
from tidemark.specs import FAMILIES, VERSIONS, FeatureSet, feature_set


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 1500
    a, b = rng.normal(size=n), rng.normal(size=n)
    flag = rng.integers(0, 2, n)
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(1.5 * a - 1.0 * flag - 0.5)))).astype(int)
    frame = pd.DataFrame({"hadm_id": np.arange(n), "a": a, "b": b, "flag": flag, "y": y, "gone": np.nan, "split": np.where(np.arange(n) % 3, "train", "valid")})
    frame.loc[::17, "a"] = np.nan
    return spark.createDataFrame(frame).repartition(4)


@pytest.fixture(scope="module")
def linear(table):
    return train.train_model(table, FeatureSet("T", "linear", ["a", "b"], ["flag"]), "y", check_finite=True)


@pytest.fixture(scope="module")
def tree(table):
    return train.train_model(table, FeatureSet("T", "tree", ["a", "b", "flag", "gone"]), "y", params={"maxIter": 6, "maxDepth": 3})


def test_linear_learns_signs_and_ranks(linear, spark):
    table = {r["feature"]: r for r in train.coefficients(linear, spark).collect()}
    assert table["a"]["coef"] > 0.8 and table["flag"]["coef"] < -0.5 and abs(table["b"]["coef"]) < 0.3
    assert table["a"]["odds_ratio"] == pytest.approx(np.exp(table["a"]["coef"]))
    assert [r["feature"] for r in train.top_by(train.coefficients(linear, spark), "abs_coef", "feature", 1).collect()] == ["a"]
    metrics = linear.details["metrics"]
    assert metrics["valid"]["auroc"] > 0.75 and metrics["train"]["n"] == 1000


def test_linear_matches_gradient_of_its_objective(linear, table):
    """At the optimum the balanced, penalised gradient vanishes (C = 1)."""
    rows = linear.prep.apply(table.where("split = 'train'")).select("y", *linear.prep.number_columns).toPandas()
    x, y = rows[linear.prep.number_columns].to_numpy(), rows["y"].to_numpy()
    w = np.array(linear.classifier.coefficients)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    residual = weight * (1 / (1 + np.exp(-(x @ w + train.intercept(linear)))) - y)
    assert np.allclose(x.T @ residual + w, 0, atol=1e-2) and abs(residual.sum()) < 1e-2


def test_closed_form_for_one_category(spark):
    """One-hot input without penalty: differences are weighted log-odds ratios."""
    data = [("u", 1)] * 30 + [("u", 0)] * 10 + [("v", 1)] * 5 + [("v", 0)] * 45
    df = spark.createDataFrame([(c, y, s) for c, y in data for s in ("train", "valid")], "cat string, y int, split string")
    model = train.train_model(df, FeatureSet("T", "linear", [], [], ["cat"]), "y", params={"regParam": 1e-9, "tol": 1e-12})
    coef = {r["feature"]: r["coef"] for r in train.coefficients(model, spark).collect()}
    assert coef["cat_u"] - coef["cat_v"] == pytest.approx(log(30 / 10) - log(5 / 45), abs=1e-3)


def test_expression_score_equals_model_score(linear, table):
    prep = linear.prep
    weights = dict(zip(prep.number_columns, map(float, linear.classifier.coefficients)))
    plain = train.linear_probability(prep.apply(table), weights, train.intercept(linear)).select("hadm_id", train.PREDICTION)
    both = plain.join(linear.score(table).select("hadm_id", train.PREDICTION).withColumnRenamed(train.PREDICTION, "m"), "hadm_id")
    assert both.selectExpr(f"max(abs({train.PREDICTION} - m)) AS d").first()["d"] < 1e-9


def test_score_ignores_other_columns(linear, table, rows):
    narrow = table.select("hadm_id", "a", "b", "flag")
    assert linear.score(narrow).columns == [*narrow.columns, train.PREDICTION]
    changed = narrow.join(table.selectExpr("hadm_id", "1 - y AS y", "'x' AS split"), "hadm_id")
    assert rows(linear.score(narrow), "hadm_id", train.PREDICTION) == rows(linear.score(changed), "hadm_id", train.PREDICTION)
    with pytest.raises(ValueError, match="flag"):
        linear.score(narrow.drop("flag"))


def test_tree_reports_dropped_and_weight(tree, table):
    assert tree.details["dropped_all_missing_train"] == ["gone"] and tree.details["features_used"] == ["a", "b", "flag"]
    n = table.where("split = 'train'").count()
    pos = table.where("split = 'train' AND y = 1").count()
    assert tree.details["positive_weight"] == pytest.approx((n - pos) / pos)
    assert 1 <= tree.details["best_iteration"] <= 6 and tree.details["metrics"]["valid"]["auroc"] > 0.7


def test_refusals(table, spark, tree):
    chosen = FeatureSet("T", "linear", ["a"])
    with pytest.raises(ValueError, match="split"):
        train.train_model(table.drop("split"), chosen, "y")
    with pytest.raises(ValueError, match="candidate"):
        train.train_model(table, FeatureSet("T", "linear", ["nope"]), "y")
    with pytest.raises(ValueError, match="empty"):
        train.train_model(table.where("split = 'train'"), chosen, "y")
    with pytest.raises(ValueError, match="single class"):
        train.train_model(table.where("y = 1"), chosen, "y")
    with pytest.raises(TypeError):
        train.coefficients(tree, spark)


def test_save_and_load(linear, table, spark, tmp_path, rows):
    place = f"file://{tmp_path}/models"
    with pytest.raises(FileNotFoundError):
        artifacts.load_model(spark, place)
    artifacts.save_model(spark, linear, place, stamp="20260101_000000", latest=False)
    artifacts.save_model(spark, linear, place, stamp="20260102_000000", latest=False)
    assert artifacts.model_stamps(spark, place) == ["20260101_000000", "20260102_000000"]
    loaded = artifacts.load_model(spark, place)
    assert rows(loaded.score(table), "hadm_id", train.PREDICTION) == rows(linear.score(table), "hadm_id", train.PREDICTION)
    assert loaded.details["features_used"] == ["a", "b", "flag"] and loaded.label == "y"
    artifacts.save_model(spark, linear, place)
    assert "latest" in artifacts.model_stamps(spark, place)


def brute_shapley(leaves, x, players):
    """Shapley values of the leaf-product game by its definition."""

    def worth(coalition):
        total = 0.0
        for leaf in leaves:
            term = leaf["value"]
            for j, (low, high, share) in leaf["path"].items():
                term *= float(low < x[j] <= high) if j in coalition else share
            total += term
        return total

    out = []
    for i in range(players):
        rest = [j for j in range(players) if j != i]
        value = 0.0
        for size in range(players):
            weight = factorial(size) * factorial(players - size - 1) / factorial(players)
            value += weight * sum(worth({*s, i}) - worth(set(s)) for s in combinations(rest, size))
        out.append(value)
    return out, worth(set())


def test_contributions_are_shapley_values_and_add_up(tree, table, spark, tmp_path):
    sample = attributions.seeded_sample(table, "hadm_id", n=40)
    assert sample.count() == 40
    again = attributions.seeded_sample(table.repartition(9), "hadm_id", n=40)
    assert {r["hadm_id"] for r in sample.collect()} == {r["hadm_id"] for r in again.collect()}
    long = attributions.attributions(tree, sample, "hadm_id", f"file://{tmp_path}")
    sums = long.groupBy("hadm_id").agg({"contribution": "sum"}).join(attributions.margins(tree, sample, "hadm_id"), "hadm_id")
    gap = sums.selectExpr("max(abs(`sum(contribution)` - log_odds)) AS gap").first()["gap"]
    assert gap < 1e-9
    leaves = attributions.leaf_paths(attributions.node_table(spark, f"file://{tmp_path}/classifier"), list(tree.classifier.treeWeights))
    x = np.array(tree.prep.apply(sample).select(*tree.prep.number_columns).limit(5).collect(), dtype=float)
    values, bias = attributions.contributions(leaves, x)
    for row, got in zip(x, values):
        expected, base = brute_shapley(leaves, row, 3)
        assert np.allclose(got, expected) and bias == pytest.approx(base)
    ranking = attributions.attribution_ranking(long).collect()
    assert ranking[0]["feature"] == "a" and "<bias>" not in {r["feature"] for r in ranking}


def test_probability_is_logistic_in_log_odds(tree, table):
    rows = attributions.margins(tree, table, "hadm_id").join(tree.score(table), "hadm_id")
    gap = rows.selectExpr("max(abs(1 / (1 + exp(-log_odds)) - y_pred_proba)) AS gap").first()["gap"]
    assert gap < 1e-9


def test_training_metrics_equal_curve(linear, table):
    got = {r["split"]: r for r in train.training_metrics(linear, table).collect()}
    part = linear.score(table.where("split = 'valid'"))
    alone = ranking_metrics(score_curve(part, train.PREDICTION, "y")).first()
    assert got["valid"]["auroc"] == pytest.approx(alone["auroc"])


def test_runs_by_version(spark):
    plan = star_plan(spark, "/root/testdata/sf0.001")
    splits = {"V1": plan.split("V1"), "V2": plan.split("V2")}
    runs = train.train_by_version(splits, STAR, params={"tree": {"maxIter": 2, "maxDepth": 2}, "linear": {"maxIter": 5}})
    assert set(runs) == {(v, f) for v in splits for f in FAMILIES}
    report = train.metrics_report(list(runs.values()), spark)
    assert report.count() == 8 and report.where("auroc BETWEEN 0 AND 1").count() == 8


SIZES = {"V1": (6, 0, 6), "V2": (16, 14, 30), "V3": (16, 31, 47), "V4": (34, 37, 70), "V5": (34, 33, 67), "V6": (16, 28, 44)}


@pytest.mark.parametrize("version", VERSIONS)
def test_feature_set_sizes(version):
    linear, tree = (feature_set(CLINICAL, version, f) for f in FAMILIES)
    assert (len(linear.continuous), len(linear.binary), len(tree.continuous)) == SIZES[version]
    assert len(set(linear.columns)) == len(linear.columns)


def test_trees_are_chosen_by_precision_with_patience():
    from tidemark.operators.trees import best_size

    assert best_size([0.1, 0.3, 0.2, 0.2, 0.9], patience=2) == 2
    assert best_size([0.1, 0.3, 0.2, 0.2, 0.9], patience=5) == 5
    assert best_size([0.5], patience=1) == 1


def test_boosting_goes_on_past_a_round_without_gain(spark):
    """A strong signal under default settings needs many small steps."""
    rows = spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 4 == 0, "valid").otherwise("train").alias("split"),
        *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)) / 1000.0).alias(c) for c in "abc"],
    )
    noise = F.pmod(F.xxhash64("id", F.lit("n")), F.lit(1000)) / 1000.0
    rows = rows.withColumn("y", (F.col("a") + F.col("b") * F.col("c") + 0.5 * noise > 1.2).cast("int"))
    model = train.train_model(rows, FeatureSet("T", "tree", ["a", "b", "c"]), "y", params={"maxIter": 25})
    assert model.details["best_iteration"] > 10
    assert model.details["best_score"] == pytest.approx(model.details["metrics"]["valid"]["auprc"], abs=0.02)


def test_growing_fits_choose_as_one_long_fit(table, monkeypatch):
    """Patience ends the choice, neither the first fit's rounds nor a cap."""
    from tidemark.operators import trees

    sizes = []

    def rising_then_flat(valid, nodes, weights, **names):
        sizes.append(len(weights))
        return [min(i, 13) / 100 for i in range(len(weights))]

    monkeypatch.setattr(train, "FIRST_TREES", 4)
    spec, params = FeatureSet("T", "tree", ["a", "flag"]), {"maxIter": 24, "maxDepth": 2, "patience": 3}
    grown = train.train_model(table, spec, "y", params=params).details
    monkeypatch.setattr(train, "FIRST_TREES", 24)
    whole = train.train_model(table, spec, "y", params=params).details
    assert (grown["best_iteration"], grown["best_score"]) == (whole["best_iteration"], whole["best_score"])
    assert trees.best_size(rising_then_flat(None, None, range(24)), 3) == 14
    sizes.clear()
    monkeypatch.setattr(train, "FIRST_TREES", 4)
    monkeypatch.setattr(train, "precision_by_size", rising_then_flat)
    assert train.train_model(table, spec, "y", params=params).details["best_iteration"] == 14
    assert sizes == [6, 12, 24]


def test_first_trees_equal_a_shorter_fit(table, spark, tmp_path):
    """Cut off the saved model, the first trees score as a fit of so many rounds does."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    from tidemark.operators.trees import first_trees

    prep = train.fit_preprocessor(table.where("split = 'train'"), FeatureSet("T", "tree", ["a", "b", "flag"]))
    rows = prep.stages(spark)[-1].transform(prep.apply(table)).select("hadm_id", F.col("y").cast("double").alias("_y"), "features")
    settings = dict(featuresCol="features", labelCol="_y", maxDepth=3, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
    longer = GBTClassifier(**settings, maxIter=9).fit(rows)
    longer.write().save(f"file://{tmp_path}/longer")
    cut = first_trees(longer, f"file://{tmp_path}/longer", 4)
    again = GBTClassifier(**settings, maxIter=4).fit(rows)
    assert cut.getNumTrees == 4 and cut.treeWeights == again.treeWeights

    def scores(model):
        return {r[0]: r[1] for r in model.transform(rows).select("hadm_id", vector_to_array("probability")[1]).collect()}

    assert scores(cut) == scores(again) != scores(longer)
    cut.write().save(f"file://{tmp_path}/saved")
    assert scores(type(cut).load(f"file://{tmp_path}/saved")) == scores(again)


def test_trees_are_fitted_once(table, monkeypatch):
    calls = []
    fit = train.GBTClassifier.fit

    def counted(self, *rows):
        calls.append(self.getMaxIter())
        return fit(self, *rows)

    monkeypatch.setattr(train.GBTClassifier, "fit", counted)
    model = train.train_model(table, FeatureSet("T", "tree", ["a", "flag"]), "y", params={"maxIter": 8, "maxDepth": 4})
    assert calls == [8] and model.details["best_iteration"] <= 8
    assert model.details["best_score"] == model.details["metrics"]["valid"]["auprc"]


def test_categories_reach_trees_and_attributions(spark, tmp_path, rows):
    """A category that a tree asks for is named; the others are not listed."""
    n = 1200
    df = spark.range(n).select(
        F.col("id").alias("hadm_id"),
        F.concat(F.lit("c"), (F.col("id") % 40).cast("string")).alias("cat"),
        (F.col("id") % 7).cast("double").alias("a"),
        F.when(F.col("id") % 3 == 0, "valid").otherwise("train").alias("split"),
        (F.col("id") % 40 == 5).cast("int").alias("y"),
    )
    model = train.train_model(df, FeatureSet("T", "tree", ["a"], [], ["cat"]), "y", params={"maxIter": 2, "maxDepth": 2})
    assert model.details["metrics"]["valid"]["auroc"] == 1.0
    valid = df.where("split = 'valid'")
    long = attributions.attributions(model, valid, "hadm_id", f"file://{tmp_path}/scratch")
    names = {r["feature"] for r in long.select("feature").distinct().collect()}
    assert {"a", "cat_c5", "<bias>"} <= names and len(names) < 10
    sums = long.groupBy("hadm_id").agg(F.sum("contribution").alias("s")).join(attributions.margins(model, valid, "hadm_id"), "hadm_id")
    assert sums.selectExpr("max(abs(s - log_odds)) AS gap").first()["gap"] < 1e-9
    artifacts.save_model(spark, model, f"file://{tmp_path}/models")
    loaded = artifacts.load_model(spark, f"file://{tmp_path}/models")
    assert rows(loaded.score(valid), "hadm_id", train.PREDICTION) == rows(model.score(valid), "hadm_id", train.PREDICTION)


def test_bundles_count_while_they_write_and_leave_models_usable(spark, table, tmp_path):
    """Observed metrics in a session must not keep a fitted model from being sent to tasks."""
    from tidemark.plans import reports

    place = f"file://{tmp_path}/bundle"
    manifest = artifacts.write_bundle(spark, {"one": table, "none": table.where("false")}, place)
    assert {r["name"]: r["rows"] for r in manifest.collect()} == {"one": 1500, "none": 0}
    assert artifacts.read_bundle(spark, place)["one"].count() == 1500
    model = train.train_model(table, FeatureSet("T", "linear", ["a"], ["flag"]), "y")
    parts = reports.coefficient_report([model], spark, top=1)
    artifacts.write_bundle(spark, parts, f"file://{tmp_path}/coefficients")
    (row,) = artifacts.read_bundle(spark, f"file://{tmp_path}/coefficients")["summary"].collect()
    assert row["n_total_features"] == 2 and row["top_features"][0]["feature"] == "a"
    scored = model.score(table.where("split = 'valid'"))
    record = reports.scenario_report(scored, train.PREDICTION, "y", model.details["features_used"])["summary"].first()
    assert record["features_used"] == ["a", "flag"] and record["auroc"] == pytest.approx(model.details["metrics"]["valid"]["auroc"])


def test_summary_has_intercept_and_counts(linear, spark):
    (row,) = train.coefficient_summary([linear], spark, top=2).collect()
    assert row["intercept"] == pytest.approx(train.intercept(linear)) and row["odds_at_zero"] == pytest.approx(np.exp(row["intercept"]))
    assert (row["n_total_features"], row["n_continuous"], row["n_binary"], row["n_categories"]) == (3, 2, 1, 0)
    assert [t["feature"] for t in row["top_features"]] == ["a", "flag"]


def test_a_failing_fit_ends_the_run(spark):
    plan = star_plan(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError, match="single class"):
        train.train_by_version({"V1": plan.split("V1").where("y_inhosp_death = 1")}, STAR)


def test_written_splits_equal_lazy_ones(spark, rows):
    plan = star_plan(spark, "/root/testdata/sf0.001")
    written = plan.written_splits()
    assert set(written) == set(VERSIONS)
    for version, table in written.items():
        assert rows(table) == rows(plan.split(version)), version


def test_runs_compare_by_scenario(spark):
    from tidemark.operators.curves import scenario_comparison, scenario_table

    plan = star_plan(spark, "/root/testdata/sf0.001")
    splits = {"V1": plan.written_splits()["V1"]}
    models = train.train_by_version(splits, STAR, ["linear"], params={"linear": {"maxIter": 5}})
    scored = train.scored_runs(models, splits, "hadm_id", {})
    got = scenario_comparison(scored, train.PREDICTION, STAR.label)
    assert got.count() == 6 and {r["scenario"] for r in got.collect()} >= {"Recall_50%", "Top1000"}
    alone = {r["scenario"]: r["alerts"] for r in scenario_table(scored, train.PREDICTION, STAR.label).collect()}
    assert {r["scenario"]: r["alerts"] for r in got.collect()} == alone


def test_catalog_fits_trees_without_a_cap_of_rounds(spark, monkeypatch):
    from tidemark.plans import catalog

    seen = []

    def no_fit(vectors, n, n_pos, params=None):
        seen.append(dict(params or {}))
        raise InterruptedError

    monkeypatch.setattr(train, "fit_tree", no_fit)
    with pytest.raises(InterruptedError):
        catalog.fitted(spark, "/root/testdata/sf0.001", "V3", "tree")
    assert seen == [{}] and train.MAX_TREES >= 10 * train.PATIENCE


def test_segment_fits_read_no_events(spark, monkeypatch):
    """Only orders and customers make the flags; no feature of the version is computed beside them."""
    from tidemark.plans import catalog

    class Seen(Exception):
        pass

    def look(df, features, label, **options):
        raise Seen(sorted({f.split("/")[-1] for f in df.select(label, "split", *features.columns).inputFiles()}))

    monkeypatch.setattr(train, "train_model", look)
    for family in FAMILIES:
        with pytest.raises(Seen) as seen:
            catalog.fitted_segments(spark, "/root/testdata/sf0.001//", family)
        assert seen.value.args[0] == ["customer.parquet", "orders.parquet"]


def test_split_of_a_version_is_written_once(spark, monkeypatch):
    from tidemark.plans import catalog

    first = catalog.kept_split(spark, "/root/testdata/sf0.001//", "V1")
    monkeypatch.setattr(catalog, "star_plan", None)
    again = catalog.kept_split(spark, "/root/testdata/sf0.001//", "V1")
    assert sorted(again.inputFiles()) == sorted(first.inputFiles()) and again.count() == first.count() > 0


def test_tables_of_leaves_add_up_as_leaf_by_leaf():
    """Leaves in shared tables, of few tests and of many, give what each leaf gives by itself."""
    rng = np.random.default_rng(3)

    def leaf(tests):
        path = {}
        for j in rng.permutation(6)[:tests]:
            low, high = np.sort(rng.normal(size=2))
            path[int(j)] = (low if rng.uniform() < 0.5 else -np.inf, high, rng.uniform(0.2, 0.9))
        return {"value": float(rng.normal()), "path": path}

    leaves = [leaf(n) for n in (1, 2, 2, 6, 6, 3, 0, 1)]
    x = rng.normal(size=(20, 6))
    tables = attributions.leaf_tables(leaves)
    assert 1 < len(tables) < len(leaves) and any(isinstance(t, dict) for t in tables)
    values, bias = attributions.contributions(leaves, x)
    for row, got in zip(x, values):
        expected, base = brute_shapley(leaves, row, 6)
        assert np.allclose(got, expected) and bias == pytest.approx(base)


def test_next_fit_takes_what_the_patience_asks():
    assert train.more_rounds(150, 150, 50) == 300
    assert train.more_rounds(150, 148, 50) == 198
    assert train.more_rounds(150, 101, 50) == 187


def test_linear_fit_reads_a_written_split_in_place(spark, monkeypatch):
    """No copy of a split that the query has written; the fit is that on a copy."""
    from tidemark.plans import catalog

    copies, cut = [], train.cut_lineage
    monkeypatch.setattr(train, "cut_lineage", lambda df: copies.append(df.columns) or cut(df))
    folder = "/root/testdata/../testdata/sf0.001"  # no other test has fitted this one
    fitted = catalog.fitted(spark, folder, "V3", "linear")
    assert not copies
    split = {"V3": catalog.kept_split(spark, folder, "V3")}
    copied = train.train_by_version(split, STAR, ["linear"])["V3", "linear"]
    assert len(copies) == 1
    assert np.allclose(fitted.classifier.coefficients.toArray(), copied.classifier.coefficients.toArray(), atol=1e-6)


@pytest.mark.parametrize("many", [False, True])
def test_boosted_trees_are_those_of_mllib(spark, tmp_path, monkeypatch, many):
    """Same draws, thresholds and splits from several partitions; with flags that share a byte only sums differ in the last digits."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from tidemark.operators import boosting

    if many:
        monkeypatch.setattr(boosting, "MANY_ROWS", 0)
        monkeypatch.setattr(boosting, "BLOCK_CELLS", 1000)
        monkeypatch.setattr(boosting, "TASK_CELLS", 8000)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(11000, 9))
    x[:, 2:7] = x[:, 2:7] > 0.3
    x[:, 8] = 0.0
    y = rng.uniform(size=len(x)) < 1 / (1 + np.exp(1 - x[:, 0] * x[:, 1] - x[:, 3]))
    frame = pd.DataFrame(x, columns=list("abcdefghi")).assign(_y=y.astype(float), _w=np.where(y, 2.3, 1.0))
    table = VectorAssembler(inputCols=list("abcdefghi"), outputCol="features").transform(spark.createDataFrame(frame).repartition(3))
    table.select("_y", "_w", "features").write.parquet(f"file://{tmp_path}/rows")
    rows = spark.read.parquet(f"file://{tmp_path}/rows")
    settings = dict(labelCol="_y", weightCol="_w", maxDepth=3, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", maxBins=64, seed=42)
    ours = boosting.BoostedTrees(**settings)
    ours.setMaxIter(2).fit(rows)
    first = list(ours._grown.trees)
    grown = ours.setMaxIter(11).fit(rows)
    assert all(a is b for a, b in zip(first, ours._grown.trees)) and len(ours._grown.trees) == 11
    ours.release()

    def saved(model, name):
        model.write().save(f"file://{tmp_path}/{name}")
        return [(r.treeID, r.nodeData) for r in spark.read.parquet(f"file://{tmp_path}/{name}/data").orderBy("treeID", "nodeData.id").collect()]

    theirs = GBTClassifier(**settings, maxIter=11).fit(rows)
    got, expected = saved(grown, "ours"), saved(theirs, "theirs")
    assert [(t, n.id, n.split, n.rawCount, n.leftChild, n.rightChild) for t, n in got] == [(t, n.id, n.split, n.rawCount, n.leftChild, n.rightChild) for t, n in expected]
    for column in ("prediction", "impurity", "gain", "impurityStats"):
        assert np.allclose([n[column] for _, n in got], [n[column] for _, n in expected], rtol=1e-9, atol=1e-9)
    assert grown.treeWeights == theirs.treeWeights and grown.numFeatures == theirs.numFeatures


def test_no_round_is_fitted_twice(table, monkeypatch):
    """Looks at the validation rows go on from the trees there are."""
    from tidemark.operators import boosting

    grown, one = [], boosting.Growing.grown_tree
    monkeypatch.setattr(boosting.Growing, "grown_tree", lambda self: grown.append(len(self.trees)) or one(self))
    monkeypatch.setattr(train, "FIRST_TREES", 4)
    monkeypatch.setattr(train, "precision_by_size", lambda valid, nodes, weights, **names: [min(i, 13) / 100 for i in range(len(weights))])
    model = train.train_model(table, FeatureSet("T", "tree", ["a", "flag"]), "y", params={"maxIter": 24, "maxDepth": 2, "patience": 3})
    assert grown == list(range(24)) and model.details["best_iteration"] == 14
