from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cohort, events
from tidemark.plans.clinical import CLINICAL
from tidemark.specs import Panel, Vitals

DAY = timedelta(hours=24)
T0 = datetime(2020, 1, 1)
PANEL = Panel({1: "a", 2: "b"})


def at(hours):
    return T0 + timedelta(hours=hours)


@pytest.fixture
def anchors(spark):
    return spark.createDataFrame([(1, T0), (2, T0), (3, T0)], "hadm_id long, admittime timestamp_ntz")


def labs(spark, data):
    return spark.createDataFrame(data, "hadm_id long, itemid int, valuenum double, charttime timestamp_ntz")


def test_window_is_half_open(spark, anchors, rows):
    data = labs(spark, [(1, 1, 1.0, at(-1)), (1, 1, 2.0, at(0)), (1, 1, 3.0, at(23.9)), (1, 1, 4.0, at(24)), (1, 1, 5.0, None)])
    inside = events.event_window(anchors, data, ["hadm_id"], "admittime", "charttime", DAY)
    assert rows(inside, "valuenum") == [(2.0,), (3.0,)]


def test_first_value_ties_nulls_and_absent_items(spark, anchors, rows):
    data = labs(
        spark,
        [
            (1, 1, 9.0, at(2)),
            (1, 1, 7.0, at(1)),
            (1, 1, 5.0, at(1)),
            (1, 2, None, at(0)),
            (1, 2, 4.0, at(3)),
            (2, 1, 8.0, at(1)),
            (2, 5, 1.0, at(0)),
            (3, 1, 6.0, at(30)),
        ],
    )
    wide = events.panel_first(anchors, data, PANEL, ["hadm_id"], "admittime", DAY)
    # equal times give the smallest value; entity 3 has no row at all
    assert rows(wide, "hadm_id", "a_first", "b_first") == [(1, 5.0, 4.0), (2, 8.0, None)]


def test_long_and_wide_first_values_agree(spark, anchors, rows):
    data = labs(spark, [(i % 3 + 1, i % 2 + 1, float(i * 7 % 11), at(i * 5 % 24)) for i in range(60)])
    inside = events.event_window(anchors, data, ["hadm_id"], "admittime", "charttime", DAY)
    long = events.first_in_window(inside, ["hadm_id"])
    wide = events.pivot_first(inside, ["hadm_id"], PANEL)
    unpivoted = wide.selectExpr("hadm_id", "stack(2, 1, a_first, 2, b_first) AS (itemid, first_value)")
    assert rows(long, "hadm_id", "itemid", "first_value") == rows(unpivoted, "hadm_id", "itemid", "first_value")


def test_pruned_scan_and_hot_entity(spark, rows):
    """Entity 0 owns most rows; bounds on the scan and a split of its rows lose none."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entities = spark.range(50).select(F.col("id").alias("hadm_id"), F.lit(T0).cast("timestamp_ntz").alias("admittime"))
        keys = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 60)
        data = spark.range(3000).select(
            F.when(F.col("id") % 100 != 7, keys).alias("hadm_id"),
            (F.col("id") % 2 + 1).cast("int").alias("itemid"),
            (F.col("id") % 13).cast("double").alias("valuenum"),
            F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(0, CAST(id % 40 AS INT))").alias("charttime"),
        )
        plain = events.event_window(entities, data, ["hadm_id"], "admittime", "charttime", DAY)
        other = events.event_window(entities, data, ["hadm_id"], "admittime", "charttime", DAY, prune_scan=True)
        assert rows(plain, *data.columns) == rows(other, *data.columns)
        assert plain.count() > 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_key_is_split_by_adaptive_execution(spark):
    """The window join has a shuffle on either side, so that a hot key's rows are read by several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        entities = spark.range(50).select(F.col("id").alias("hadm_id"), F.lit(T0).cast("timestamp_ntz").alias("admittime"))
        data = spark.range(0, 60_000, 1, 8).select(
            F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).alias("hadm_id"),
            F.lit(1).alias("itemid"),
            F.xxhash64("id").cast("double").alias("valuenum"),
            F.lit(T0).cast("timestamp_ntz").alias("charttime"),
        )
        inside = events.event_window(entities, data, ["hadm_id"], "admittime", "charttime", DAY)
        assert inside.agg(F.sum("valuenum")).count() == 1 and inside.count() == 60_000
        places = {(r["p"], r["hadm_id"]) for r in inside.select(F.spark_partition_id().alias("p"), "hadm_id", "valuenum").collect()}
        assert sum(hadm_id == 0 for _, hadm_id in places) > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_same_columns_must_agree(spark, rows):
    entities = spark.createDataFrame([(1, 7, T0), (2, 8, T0)], "hadm_id long, subject_id long, admittime timestamp_ntz")
    data = spark.createDataFrame(
        [(1, 7, 1.0, at(1)), (1, 9, 2.0, at(1)), (2, None, 3.0, at(1)), (2, 8, 4.0, at(2))],
        "hadm_id long, subject_id long, valuenum double, charttime timestamp_ntz",
    )
    inside = events.event_window(entities, data, ["hadm_id"], "admittime", "charttime", DAY, same=["subject_id"])
    assert rows(inside, "valuenum") == [(1.0,), (4.0,)]
    assert inside.columns == data.columns


def vital_rows(spark, data):
    return spark.createDataFrame(data, "hadm_id long, itemid int, valuenum double, charttime timestamp_ntz")


def test_vitals_units_ranges_and_merged_ids(spark, anchors, rows):
    data = vital_rows(
        spark,
        [
            (1, 220045, 19.9, at(1)),
            (1, 220045, 20.0, at(2)),
            (1, 220045, 300.0, at(3)),
            (1, 220045, 300.1, at(4)),
            (1, 223761, 98.6, at(1)),
            (1, 223762, 36.0, at(2)),
            (1, 220050, 120.0, at(5)),
            (1, 220179, 110.0, at(5)),
            (1, 220179, 130.0, at(6)),
            (1, 999, 50.0, at(1)),
            (2, 220277, None, at(1)),
        ],
    )
    out = events.vital_summary(anchors, data, CLINICAL.vitals, ["hadm_id"], "admittime", DAY)
    got = {k: v for k, v in out.first().asDict().items() if v is not None}
    assert got["hadm_id"] == 1 and out.count() == 1
    assert (got["hr_24h_first"], got["hr_24h_min"], got["hr_24h_max"]) == (20.0, 20.0, 300.0)
    assert got["temp_24h_first"] == pytest.approx(37.0) and got["temp_24h_min"] == 36.0
    assert (got["sbp_24h_first"], got["sbp_24h_min"], got["sbp_24h_max"]) == (110.0, 110.0, 130.0)
    assert "spo2_24h_first" not in got


def test_vitals_without_fahrenheit(spark, rows):
    vitals = Vitals({1: "hr"}, {"hr": (0, 10)})
    data = vital_rows(spark, [(1, 1, 5.0, T0), (1, 1, 11.0, T0)])
    assert rows(events.clean_vitals(data, vitals), "vital_name", "vital_value") == [("hr", 5.0)]


def test_first_stay_ties_and_incomplete_rows(spark, rows):
    stays = spark.createDataFrame(
        [(1, 12, at(1)), (1, 11, at(1)), (1, 10, at(2)), (2, None, at(0)), (3, 5, None), (None, 6, at(0))],
        "hadm_id long, stay_id long, intime timestamp_ntz",
    )
    assert rows(cohort.first_stay(stays), "hadm_id", "stay_id") == [(1, 11)]


def test_layout_does_not_matter(spark, anchors, rows):
    data = labs(spark, [(i % 3 + 1, i % 2 + 1, float(i * 7 % 11), at(i * 5 % 30)) for i in range(200)])
    reference = rows(events.panel_first(anchors, data, PANEL, ["hadm_id"], "admittime", DAY))
    for shuffled in (data.repartition(7), data.orderBy(F.desc("valuenum")), data.coalesce(1)):
        assert rows(events.panel_first(anchors, shuffled, PANEL, ["hadm_id"], "admittime", DAY)) == reference


def test_first_values_hold_one_entity_at_a_time(spark, anchors, rows):
    """After a sort-merge join no hash table of groups and no further sort is made."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        data = labs(spark, [(1, 1, 2.0, at(1)), (1, 2, None, at(1)), (1, 2, 3.0, at(2)), (2, 1, 5.0, at(1)), (2, 1, 4.0, at(1))])
        wide = events.panel_first(anchors, data, PANEL, ["hadm_id"], "admittime", DAY)
        plan = wide._jdf.queryExecution().sparkPlan().toString()
        assert "SortAggregate" in plan and "HashAggregate" not in plan
        executed = wide._jdf.queryExecution().executedPlan().toString()
        assert executed.count("Sort [") == 2 and executed.count("Exchange hashpartitioning") == 2
        assert rows(wide, "hadm_id", "a_first", "b_first") == [(1, 2.0, 3.0), (2, 4.0, None)]
        vitals = Vitals({1: "hr", 2: "rr"}, {"hr": (0, 9), "rr": (0, 9)}, suffix="")
        summary = events.vital_summary(anchors, data, vitals, ["hadm_id"], "admittime", DAY)
        assert "HashAggregate" not in summary._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_value_keeps_to_known_times(spark, rows):
    """A row without a time is never the first; a null value is first only where its time has no other."""
    data = labs(spark, [(1, 1, 9.0, None), (1, 1, None, at(1)), (1, 1, 7.0, at(1)), (1, 2, None, at(1)), (1, 2, 5.0, at(2)), (2, 1, 1.0, None)])
    assert rows(events.pivot_first(data, ["hadm_id"], PANEL), "hadm_id", "a_first", "b_first") == [(1, 7.0, None), (2, None, None)]
