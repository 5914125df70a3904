import pytest
from pyspark.sql import functions as F

from tidemark.operators import checks
from tidemark.operators.gates import write_checked

ROWS = [(1, "train", 1, 1.0, None), (2, "train", 0, 2.0, "x"), (3, "valid", 0, 3.0, "y"), (4, "valid", 0, 4.0, None)]
SCHEMA = "k long, split string, y int, a double, t string"


def test_counts_and_no_violation(spark, tmp_path, rows):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = write_checked(df, f"{tmp_path}/t", ["k"], label="y", finite=["a"], nulls=["t", "a"])
    assert got.require(rows=4).rows == 4 and rows(got.table) == rows(df) and got.table.columns == df.columns
    assert got.counts["outcome:train:1"] == 1 and got.counts["outcome:valid:0"] == 2 and got.counts["outcome:valid:1"] == 0
    assert got.null_rate("t") == 0.5 and got.null_rate("a") == 0
    assert dict(map(tuple, got.profile(spark).collect())) == got.counts


@pytest.mark.parametrize(
    "row, broken",
    [
        ((1, "train", 1, 1.0, None), {"repeated_key": 1}),
        ((None, "train", 1, 1.0, None), {"null_key": 1}),
        ((5, "train", 2, 1.0, None), {"invalid_label": 1}),
        ((5, "train", None, float("nan"), None), {"invalid_label": 1, "not_finite:a": 1}),
        ((5, "train", 1, float("-inf"), None), {"not_finite:a": 1}),
        ((5, "train", 1, None, None), {"not_finite:a": 1}),
    ],
)
def test_violations_raise(spark, tmp_path, row, broken):
    got = write_checked(spark.createDataFrame([*ROWS, row], SCHEMA).repartition(3), f"{tmp_path}/t", ["k"], label="y", finite=["a"])
    assert got.violations() == broken
    with pytest.raises(checks.QualityError, match=next(iter(broken))):
        got.require()
    with pytest.raises(checks.QualityError, match="rows"):
        got.require(rows=4)


def test_the_input_is_evaluated_once_and_the_table_not_read(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.createDataFrame(ROWS, SCHEMA).mapInPandas(watched, SCHEMA)
    group = "gates-test"
    spark.sparkContext.setJobGroup(group, "")
    got = write_checked(df, f"{tmp_path}/t", ["k"], label="y", finite=["a"], nulls=["t"])
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    got.require(rows=4)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == jobs
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen.value == len(ROWS)


def test_partitioned_by_key_needs_no_further_shuffle(spark):
    from pyspark.sql import Window

    left = spark.range(100).select(F.col("id").alias("k"))
    joined = left.hint("merge").join(spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("b")), "k", "left")
    plain = joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    numbered = joined.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("k")))
    assert numbered._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == plain


def test_empty_tables(spark, tmp_path):
    got = write_checked(spark.createDataFrame([], SCHEMA), f"{tmp_path}/t", ["k"], label="y", nulls=["t"])
    assert got.rows == 0 and got.null_rate("t") is None and got.require().table.count() == 0
    with pytest.raises(checks.QualityError):
        got.require(empty=False)


def test_checked_splits_raise_on_a_broken_label(spark):
    from tidemark.plans.features import FeaturePlan
    from tidemark.plans.star import STAR, star_plan

    plan = star_plan(spark, "/root/testdata/sf0.001")
    assert plan.written_splits()["V4"].count() > 0
    twice = FeaturePlan(STAR, {**plan.tables, "admissions": plan.tables["admissions"].union(plan.tables["admissions"].limit(5))})
    with pytest.raises(checks.QualityError, match="repeated_key"):
        twice.written_splits()
