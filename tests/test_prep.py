import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import prep
from tidemark.specs import FeatureSet


@pytest.fixture
def train(spark):
    return spark.createDataFrame(
        [
            (1.0, 5.0, None, 1, "b", "x"),
            (2.0, 5.0, None, None, "a", None),
            (None, 5.0, None, 0, "a", "y"),
            (float("nan"), 5.0, None, 1, "b", "y"),
            (10.0, 5.0, None, None, None, "x"),
        ],
        "num double, flat double, gone double, flag int, tie string, cat string",
    )


def test_median_interpolates_and_skips_missing(train):
    got = {r["feature"]: r["median"] for r in prep.fit_medians(train, ["num", "flat", "gone"]).collect()}
    assert got == {"num": 2.0, "flat": 5.0}
    even = {r["feature"]: r["median"] for r in prep.fit_medians(train.where("num < 5 OR num IS NULL"), ["num"]).collect()}
    assert even == {"num": 1.5}


def test_mode_ties_take_the_smallest(train):
    got = {r["feature"]: r["mode"] for r in prep.fit_modes(train, ["tie", "cat"]).collect()}
    assert got == {"tie": "a", "cat": "x"}


def test_drop_all_missing_reports(train):
    kept, dropped = prep.drop_all_missing(train, ["num", "gone", "nowhere", "flag"])
    assert kept == ["num", "flag"] and dropped == ["gone", "nowhere"]
    only_nan = train.where("isnan(num)")
    assert prep.drop_all_missing(only_nan, ["num"]) == ([], ["num"])


def vectors(fitted, df):
    """Rows of the assembled vectors."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    made = PipelineModel(fitted.stages(df.sparkSession)).transform(fitted.apply(df))
    return [tuple(r[0]) for r in made.select(vector_to_array("features")).collect()]


def named(fitted, spark):
    return [(r["feature"], r["type"]) for r in fitted.input_names(spark).orderBy("input").collect()]


def test_linear_preprocessing(spark, train):
    features = FeatureSet("V0", "linear", ["num", "flat"], ["flag"], ["cat"])
    fitted = prep.fit_preprocessor(train, features)
    values = np.array([1, 2, 2, 2, 10.0])
    assert named(fitted, spark) == [("num", "cont"), ("flat", "cont"), ("flag", "bin"), ("cat_x", "cat"), ("cat_y", "cat")]
    assert fitted.scales["flat"] == (5.0, 1.0)
    out = fitted.apply(train).select(*fitted.number_columns).toPandas()
    assert np.allclose(out["_x0"], (values - values.mean()) / values.std())
    assert np.allclose(out["_x1"], 0) and list(out["_x2"]) == [1, 0, 0, 1, 0]
    assert [row[3:] for row in vectors(fitted, train)] == [(1, 0), (1, 0), (0, 1), (0, 1), (1, 0)]
    unseen = spark.createDataFrame([(None, None, None, "zzz")], "num double, flat double, flag int, cat string")
    assert vectors(fitted, unseen)[0][2:] == (0.0, 0.0, 0.0)


def test_categories_of_several_columns(spark, train):
    fitted = prep.fit_preprocessor(train, FeatureSet("V0", "linear", [], [], ["tie", "gone", "cat"]))
    assert [n for n, _ in named(fitted, spark)] == ["tie_a", "tie_b", "cat_x", "cat_y"]
    assert vectors(fitted, train)[0] == (0, 1, 1, 0) and vectors(fitted, train)[4] == (1, 0, 1, 0)
    assert fitted.first_input("cat") == 2 and fitted.encoded == {"tie": "_k0", "cat": "_k2"}


def test_tree_preprocessing_fills_flags_with_the_median(train):
    fitted = prep.fit_preprocessor(train, FeatureSet("V0", "tree", ["num", "flag"]))
    out = fitted.apply(train).select(*fitted.number_columns).toPandas()
    assert list(out["_x1"]) == [1, 1, 0, 1, 1] and list(out["_x0"]) == [1, 2, 2, 2, 10]


def test_all_missing_number_is_refused(train):
    with pytest.raises(ValueError, match="gone"):
        prep.fit_preprocessor(train, FeatureSet("V0", "linear", ["num", "gone"]))


def test_constants_survive_json(train):
    fitted = prep.fit_preprocessor(train, FeatureSet("V0", "linear", ["num"], ["flag"], ["cat"]))
    again = prep.Preprocessor.from_json(fitted.to_json())
    assert again == fitted


def test_fit_on_many_categories(spark):
    """No column, literal or driver list for a category; coefficients are named."""
    from tidemark.operators import train as models

    n = 50_000
    rows = spark.range(4 * n).select(
        F.col("id"),
        F.concat(F.lit("c"), F.format_string("%05d", F.col("id") % n)).alias("cat"),
        F.when(F.col("id") < 2 * n, "train").otherwise("valid").alias("split"),
        ((F.col("id") % n) % 3 == 0).cast("int").alias("y"),
    )
    spec = FeatureSet("T", "linear", [], [], ["cat"])
    model = models.train_model(rows, spec, "y", params={"maxIter": 8})
    assert model.prep.sizes == {"cat": n} and model.classifier.numFeatures == n
    named = {r["feature"]: r["coef"] for r in models.coefficients(model, spark).collect()}
    assert len(named) == n and named["cat_c00000"] > 0 > named["cat_c00001"] and named["cat_c49998"] > 0
    assert model.details["metrics"]["valid"]["auroc"] > 0.99
    plan = model.prep.apply(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "c00001" not in plan
    unseen = spark.createDataFrame([("new",), (None,), ("c00003",)], "cat string")
    scores = [r[models.PREDICTION] for r in model.score(unseen).collect()]
    assert scores[2] > scores[0]
