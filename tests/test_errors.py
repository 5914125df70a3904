import numpy as np
import pandas as pd
import pytest

from tidemark.operators import assemble, checks, errors
from tidemark.plans.features import FeaturePlan
from tidemark.plans.star import STAR, star_plan
from tidemark.session import cut_lineage
from tidemark.sources import artifacts
from tidemark.sources.tables import LazyTables, load_tables, materialize_bucketed


@pytest.fixture(scope="module")
def graded(spark):
    frame = pd.DataFrame(
        {
            "hadm_id": [1, 2, 3, 4, 5, 6, 6],
            "stay_id": [1, 1, 2, 3, None, 4, 4],
            "y": ["1", "1", "0", "0", "1", "0", "0"],
            "yhat": [1, 0, 1, 0, 0, 1, 1],
            "p": [0.9, 0.2, 0.8, 0.1, 0.4, 0.8, 0.7],
            "lab": [1.0, np.nan, 3.0, 4.0, 6.0, 8.0, None],
            "flag": [1, 0, None, 1, 0, 1, 1],
        }
    )
    return errors.error_groups(spark.createDataFrame(frame), "y", "yhat")


def test_groups_and_counts(graded, rows):
    assert rows(graded, "hadm_id", "error_group") == [(1, "TP"), (2, "FN"), (3, "FP"), (4, "TN"), (5, "FN"), (6, "FP"), (6, "FP")]
    counts = errors.error_group_counts(graded, "y", "yhat").first().asDict()
    assert (counts["n_tp"], counts["n_fp"], counts["n_fn"], counts["n_tn"], counts["n_total"]) == (1, 3, 2, 1, 7)
    assert (counts["n_unique_entity"], counts["n_duplicate_rows"], counts["n_unique_stay"]) == (6, 1, 4)
    assert counts["label_prevalence"] == pytest.approx(3 / 7) and counts["pred_positive_rate_05"] == pytest.approx(4 / 7)


def test_unreadable_labels_are_unknown(spark):
    odd = spark.createDataFrame([("x", "1"), ("1", None), ("2", "0"), ("1.0", "0")], "y string, yhat string")
    groups = errors.error_groups(odd, "y", "yhat")
    assert sorted(r["error_group"] for r in groups.collect()) == ["FN", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    with pytest.raises(checks.QualityError):
        checks.assert_known_error_group(groups)


def test_top_and_all(graded):
    top = errors.top_false_positives(graded, "p", "hadm_id", 2).collect()
    assert [(r["hadm_id"], r["p"]) for r in top] == [(3, 0.8), (6, 0.8)]
    assert [r["hadm_id"] for r in errors.all_false_negatives(graded, "p", "hadm_id").collect()] == [5, 2]


def test_summaries_match_pandas(graded):
    frame = graded.toPandas()
    numeric = errors.numeric_summary(graded, ["lab", "p", "absent"]).toPandas()
    assert set(numeric["feature"]) == {"lab", "p"} and set(numeric["group"]) == {"TP", "FP", "FN", "TN"}
    for row in numeric.itertuples():
        values = frame.loc[frame["error_group"] == row.group, row.feature].astype(float)
        assert row.n_nonmissing == values.notna().sum() and row.missing_rate == pytest.approx(values.isna().mean())
        for name, expected in (("mean", values.mean()), ("median", values.median()), ("p25", values.quantile(0.25)), ("p75", values.quantile(0.75))):
            assert getattr(row, name) == pytest.approx(expected, nan_ok=True)
    binary = {r["group"]: r for r in errors.binary_rates(graded, ["flag"]).collect()}
    assert (binary["FP"]["n_nonmissing"], binary["FP"]["count_1"], binary["FP"]["rate_1"]) == (2, 2, 1.0)
    assert binary["FP"]["missing_rate"] == pytest.approx(1 / 3)


def test_contrast(graded):
    numeric = errors.numeric_summary(graded, ["lab", "p"])
    got = {(r["feature"], r["contrast"]): r["diff_mean"] for r in errors.contrast(numeric, ["mean"]).collect()}
    assert got["lab", "FP-TN"] == pytest.approx(5.5 - 4.0) and got["lab", "FN-TP"] == pytest.approx(6.0 - 1.0)


def test_no_columns_to_summarize(graded):
    with pytest.raises(ValueError):
        errors.numeric_summary(graded, ["absent"])


def test_predictions_round_trip(graded, spark, tmp_path, rows):
    kept = graded.select("hadm_id", "y", "p", "yhat")
    for source, schema in (("parquet", None), ("csv", "hadm_id long, y string, p double, yhat int")):
        path = f"file://{tmp_path}/{source}"
        artifacts.write_predictions(kept, path, source)
        again = artifacts.read_predictions(spark, path, ["y", "yhat", "p"], source, schema)
        assert rows(again, "hadm_id", "p", "yhat") == rows(kept, "hadm_id", "p", "yhat")
        with pytest.raises(ValueError, match="nothing"):
            artifacts.read_predictions(spark, path, ["nothing"], source, schema)


def test_report_is_one_file(graded, spark, tmp_path):
    artifacts.write_report(graded.groupBy("error_group").count(), f"file://{tmp_path}/report", "csv")
    assert len(list((tmp_path / "report").glob("part-*"))) == 1


def test_guards(graded):
    with pytest.raises(ValueError, match="a.*b"):
        assemble.require_columns(graded, ["y", "a", "b"])
    with pytest.raises(ValueError):
        assemble.select_candidates(graded, ["a"])
    assert assemble.select_candidates(graded, ["p", "a", "y", "p"]) == ["p", "y"]


def test_tables_open_on_first_use(spark):
    opened = []
    lazy = LazyTables({"a": lambda: opened.append("a") or spark.range(1), "b": lambda: opened.append("b")})
    assert len(lazy) == 2 and "a" in lazy and not opened[1:]
    assert lazy["a"] is lazy["a"] and opened == ["a"]
    assert load_tables(spark, "/no/such/folder", ["x"]) is not None


def test_left_joins_keep_every_row_and_prune(spark):
    plan = star_plan(spark, "/root/testdata/sf0.001")
    n = plan.base.count()
    assert all(plan.features(v).count() == n for v in ("V1", "V2", "V3", "V4"))
    # a split label needs no event table: unused left joins leave the plan
    label = plan.split("V3").select("hadm_id", "split")
    assert "l_shipdate" not in label._jdf.queryExecution().optimizedPlan().toString()


def test_one_shuffle_per_fact(spark):
    """Without broadcasts the lab summary shuffles events and anchors once each."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labs = star_plan(spark, "/root/testdata/sf0.001").labs("core")
        physical = labs._jdf.queryExecution().executedPlan().toString()
        assert physical.count("Exchange hashpartitioning") == 2 and "SortAggregate" not in physical
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_splits_are_subject_disjoint(spark):
    split = star_plan(spark, "/root/testdata/sf0.001").split("V1")
    assert split.groupBy("subject_id").agg({"split": "approx_count_distinct"}).where("`approx_count_distinct(split)` > 1").count() == 0


def test_cut_lineage_keeps_rows(graded, rows):
    assert rows(cut_lineage(graded.select("hadm_id", "p"))) == rows(graded, "hadm_id", "p")


def test_unknown_version(spark):
    with pytest.raises(ValueError):
        FeaturePlan(STAR, {}).features("V9")


def test_bucketed_table_joins_without_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS buckets LOCATION 'file://{tmp_path}'")
        left = materialize_bucketed(spark.range(100).selectExpr("id AS k", "id AS a"), "buckets.left_side", "k", 4)
        right = materialize_bucketed(spark.range(50).selectExpr("id AS k", "id AS b"), "buckets.right_side", "k", 4)
        joined = left.join(right, "k")
        assert joined.count() == 50 and "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE IF EXISTS buckets CASCADE")
