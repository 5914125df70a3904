"""The clinical preset on a small invented hospital, through all versions."""

from datetime import datetime, timedelta

import pytest

from tidemark.operators import checks, cohort
from tidemark.plans.clinical import CLINICAL
from tidemark.plans.features import FeaturePlan
from tidemark.sources import tables as store

T0 = datetime(2150, 3, 1, 8)


def h(hours):
    return T0 + timedelta(hours=hours)


@pytest.fixture(scope="module")
def plan(spark):
    make = spark.createDataFrame
    return FeaturePlan(
        CLINICAL,
        {
            "patients": make(
                [(1, 60, 2140, "F"), (2, 17, 2150, "M"), (3, 40, 2150, "M"), (4, 70, None, "F")],
                "subject_id int, anchor_age int, anchor_year int, gender string",
            ),
            "admissions": make(
                [(10, 1, T0, 1, "EW", "WHITE"), (11, 1, h(200), 0, "EW", None), (20, 2, T0, 0, "EL", "X"), (30, 3, T0, None, "EL", "X"), (50, 9, T0, 0, "EL", "X")],
                "hadm_id int, subject_id int, admittime timestamp_ntz, hospital_expire_flag int, admission_type string, race string",
            ),
            "labs": make(
                [
                    (10, 50983, 140.0, h(2)),
                    (10, 50983, 150.0, h(1)),
                    (10, 50931, 99.0, h(24)),
                    (11, 51265, 250.0, h(201)),
                    (20, 50983, 130.0, h(1)),
                    (30, 50983, None, h(1)),
                ],
                "hadm_id int, itemid int, valuenum double, charttime timestamp_ntz",
            ),
            "diagnoses": make(
                [(10, 9, "4280"), (10, 10, "N185"), (11, 10, "J449"), (30, 9, "2391"), (None, 9, "4010")],
                "hadm_id int, icd_version int, icd_code string",
            ),
            "prescriptions": make(
                [(10, "Heparin Sodium", h(3)), (11, None, h(201)), (30, "Aspirin", None)],
                "hadm_id int, drug string, starttime timestamp_ntz",
            ),
            "stays": make(
                [(10, 101, h(5), h(50), "MICU", "SICU"), (10, 100, h(5), h(60), "CCU", "CCU"), (11, 110, None, None, "MICU", "MICU")],
                "hadm_id int, stay_id int, intime timestamp_ntz, outtime timestamp_ntz, first_careunit string, last_careunit string",
            ),
            "procedures": make(
                [(101, 7, h(6)), (100, 8, h(40))], "stay_id int, itemid int, starttime timestamp_ntz"
            ),
            "items": make([(7, "Arterial Line"), (8, "Chest Tube Removed")], "itemid int, label string"),
            "vitals": make(
                [(10, 1, h(4), 220045, 80.0), (10, 1, h(6), 220045, 90.0), (10, 1, h(28), 220045, 70.0), (10, 2, h(6), 220045, 60.0), (10, 1, h(7), 223761, 98.6)],
                "hadm_id int, subject_id int, charttime timestamp_ntz, itemid int, valuenum double",
            ),
        },
    )


def by_id(df):
    return {r["hadm_id"]: r.asDict() for r in df.collect()}


def test_cohort(plan):
    base = by_id(plan.base)
    # minors and entities without a subject leave; a null year gives no age
    assert set(base) == {10, 11, 30}
    assert base[10]["y_inhosp_death"] == 1 and base[30]["y_inhosp_death"] == 0
    assert float(base[10]["age_at_admit"]) == 70.0 and "language" not in base[10]


def test_v1_to_v4(plan):
    for version, width in (("V1", 10), ("V2", 34), ("V3", 51), ("V4", 75)):
        df = plan.features(version)
        assert len(df.columns) == width and set(by_id(df)) == {10, 11, 30}
    v4 = by_id(plan.features("V4"))
    first = v4[10]
    assert first["sodium_24h_first"] == 150.0 and first["glucose_24h_first"] is None and first["glucose_24h_missing"] == 1
    assert first["charlson_min"] == 3 and first["anticoag_antiplatelet_24h"] == 1 and first["insulin_24h"] == 0
    assert first["arterial_line_24h"] == 1 and first["chest_tube_24h"] == 0
    # vitals: other subject's row is ignored, the window starts at admission
    assert (first["hr_24h_first"], first["hr_24h_min"], first["hr_24h_max"]) == (80.0, 80.0, 90.0)
    assert first["temp_24h_first"] == pytest.approx(37.0)
    assert v4[11]["copd"] == 1 and v4[11]["vasopressor_24h"] == 0 and v4[11]["arterial_line_24h"] is None
    # no source rows: flags are null, not 0; codes outside the range are 0
    assert v4[30]["vasopressor_24h"] is None and v4[30]["malignancy"] == 0 and v4[30]["sodium_24h_missing"] == 1


def test_v5_and_v6(plan):
    v5 = by_id(plan.features("V5"))
    assert set(v5) == {10}
    row = v5[10]
    assert row["stay_id"] == 100 and row["first_careunit"] == "CCU" and row["outtime"] == h(60)
    # anchored on the stay: the value before it is out, one 23 hours later is in
    assert (row["hr_24h_first"], row["hr_24h_min"], row["hr_24h_max"]) == (90.0, 70.0, 90.0)
    assert row["hr_24h_missing"] == 0 and row["rr_24h_missing"] == 1
    v6 = plan.features("V6")
    # a stay without a start still counts as a stay
    assert set(by_id(v6)) == {30}
    checks.assert_no_stay(v6, plan.tables["stays"], "hadm_id")


def test_splits(plan, spark, tmp_path):
    labels = {k: r["split"] for k, r in by_id(plan.split("V4")).items()}
    assert labels == {10: "train", 11: "train", 30: "valid"}
    written = store.materialize(plan.features("V1"), f"file://{tmp_path}/v1")
    assert {k: r["split"] for k, r in by_id(plan.split("V1", features=written)).items()} == labels
    for version in ("V5", "V6"):
        direct = by_id(plan.split(version))
        inherited = by_id(plan.split(version, features=plan.features(version), split_v4=plan.split("V4")))
        assert direct == inherited and all(direct[k]["split"] == labels[k] for k in direct)


def test_quality_gates(plan):
    features, split = plan.features("V1"), plan.split("V1")
    checks.assert_row_counts_match(plan.base, features, split)
    checks.assert_unique_key(features, ["hadm_id"])
    checks.assert_label_valid(split, "y_inhosp_death")
    with pytest.raises(checks.QualityError):
        checks.assert_row_counts_match(plan.base, features, split.where("split = 'train'"))
    with pytest.raises(checks.QualityError):
        checks.assert_unique_key(features.union(features), ["hadm_id"])
    with pytest.raises(checks.QualityError):
        checks.assert_label_valid(split.selectExpr("CAST(NULL AS INT) AS y"), "y")
    with pytest.raises(checks.QualityError):
        checks.assert_no_stay(plan.features("V3"), plan.tables["stays"], "hadm_id")


def test_missing_tables_are_listed(spark, plan):
    store.define_views({"known_view": plan.base})
    checks.assert_tables_exist(spark, ["known_view"])
    with pytest.raises(checks.QualityError, match="one_view, other_view"):
        checks.assert_tables_exist(spark, ["known_view", "one_view", "other_view"])


def test_coverage_by_stay_status(plan):
    got = {r["cohort"]: (r["n"], r["any_rate"]) for r in checks.vital_coverage(plan.features("V4"), CLINICAL.vitals.missing_columns, plan.tables["stays"], "hadm_id").collect()}
    assert got == {"all": (3, pytest.approx(1 / 3)), "with_stay": (2, 0.5), "without_stay": (1, 0.0)}


def test_typed_empty_table(spark, plan):
    empty = store.typed_empty_table(spark, store.stay_vitals_schema(CLINICAL))
    assert len(empty.columns) == 27 and empty.count() == 0
    assert empty.unionByName(plan.stay_vitals()).count() == 1


def test_semi_is_the_complement_of_anti(plan):
    with_stay = cohort.by_stay(plan.base, plan.tables["stays"], "hadm_id", True).count()
    without = cohort.by_stay(plan.base, plan.tables["stays"], "hadm_id", False).count()
    assert with_stay + without == plan.base.count()
