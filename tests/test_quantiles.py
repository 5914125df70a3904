import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import quantiles
from tidemark.functions.quantiles import exact_quantiles

RNG = np.random.default_rng(3)
SHAPES = {
    "spread": RNG.normal(size=12_000),
    "ties": RNG.integers(0, 6, 9_000).astype(float),
    "one hot value": np.r_[np.full(4_000, 0.5), RNG.uniform(size=5_000)],
    "all equal": np.full(50, 2.0),
    "skewed": np.exp(RNG.normal(size=2_001) * 5),
    "few": RNG.normal(size=7),
    "two": np.array([1.0, 4.0]),
    "single": np.array([3.0]),
    "beyond": np.array([-np.inf, 1.0, 2.0, np.inf]),
}
PROBS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p100": 1.0}


def check(found, shapes):
    for name, values in shapes.items():
        for column, p in PROBS.items():
            want = np.quantile(values, p)
            if np.isfinite(want):
                assert found[name][column] == pytest.approx(want, rel=1e-12), (name, column)


@pytest.mark.parametrize("most_inside", [2_000_000, 1])
def test_columns_match_numpy(spark, most_inside):
    longest = max(map(len, SHAPES.values()))
    frame = pd.DataFrame({k: pd.Series(v).reindex(range(longest)) for k, v in SHAPES.items()})
    df = spark.createDataFrame(frame.sample(frac=1, random_state=1)).repartition(5)
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns], F.lit(None).cast("double").alias("none"))
    got = {r["feature"]: r for r in exact_quantiles(df, df.columns, PROBS, most_inside=most_inside).collect()}
    assert set(got) == set(SHAPES)
    check(got, SHAPES)


@pytest.mark.parametrize("most_inside, plan_groups", [(2_000_000, 16), (40, 16), (2_000_000, 1)])
def test_groups_match_numpy(spark, monkeypatch, most_inside, plan_groups):
    monkeypatch.setattr(quantiles, "PLAN_GROUPS", plan_groups)
    frame = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in SHAPES.items()])
    df = spark.createDataFrame(frame).union(spark.createDataFrame([("empty", None), (None, 1.0), (None, 2.0)], "g string, v double"))
    rows = exact_quantiles(df.repartition(4), ["v"], PROBS, ["g"], most_inside=most_inside).collect()
    got = {r["g"]: r for r in rows}
    assert set(got) == {*SHAPES, None} and got[None]["p50"] == 1.5
    check(got, SHAPES)


def test_a_sketch_that_is_off_is_caught(spark, monkeypatch):
    """Brackets that miss their ranks are widened: the sketch only guides."""
    monkeypatch.setattr(quantiles, "WIDTHS", (1e-9, 1e-8, 1e-7, 0.25))
    monkeypatch.setattr(quantiles, "ACCURACY", 20)
    values = RNG.normal(size=20_000)
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(7)
    (row,) = exact_quantiles(df, ["v"], PROBS).collect()
    check({"v": row}, {"v": values})


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert exact_quantiles(df, ["v"], PROBS).collect() == []
    assert exact_quantiles(df, ["v"], PROBS, ["g"]).collect() == []


def test_only_values_inside_are_shuffled(spark):
    """No unpivot, and few rows leave the scan."""
    df = spark.range(200_000).select(F.rand(1).alias("a"), F.rand(2).alias("b"))
    plan = exact_quantiles(df, ["a", "b"], {"m": 0.5})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in text and text.count("Exchange hashpartitioning") <= 3
