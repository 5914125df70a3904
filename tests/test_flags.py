from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions import columns as rules
from tidemark.operators import flags
from tidemark.plans.clinical import CHRONIC, CLINICAL, COMORBIDITY, COMORBIDITY_WEIGHTS, MEDICATIONS, PROCEDURES

T0 = datetime(2020, 1, 1)
DAY = timedelta(hours=24)


def codes(spark, data):
    return spark.createDataFrame(data, "hadm_id long, icd_version int, icd_code string")


def test_code_ranges_are_lexicographic(spark, rows):
    data = codes(spark, [(1, 9, "239"), (2, 9, "2391"), (3, 9, "140"), (4, 9, "1399"), (5, 10, "C34"), (6, 10, "D49")])
    out = flags.chronic_groups(data, "hadm_id", CHRONIC)
    assert rows(out, "hadm_id", "malignancy") == [(1, 1), (2, 0), (3, 1), (4, 0), (5, 1), (6, 0)]


def test_loose_and_strict_systems(spark, rows):
    data = codes(spark, [(1, 8, "I501"), (2, None, "I25"), (3, 10, "I50"), (4, 9, "4280"), (5, 9, None)])
    strict = flags.comorbidity_flags(data, "hadm_id", COMORBIDITY, COMORBIDITY_WEIGHTS, "score")
    assert rows(strict, "hadm_id", "chf") == [(1, 0), (2, 0), (3, 1), (4, 1), (5, 0)]
    loose = flags.chronic_groups(data, "hadm_id", CHRONIC)
    assert rows(loose, "hadm_id", "cad") == [(1, 0), (2, 1), (3, 0), (4, 0), (5, 0)]


def test_null_entity_is_a_group_only_in_the_loose_table(spark):
    data = codes(spark, [(None, 9, "4280"), (1, 9, "401")])
    assert flags.comorbidity_flags(data, "hadm_id", COMORBIDITY, COMORBIDITY_WEIGHTS, "score").count() == 1
    assert flags.chronic_groups(data, "hadm_id", CHRONIC).count() == 2


def test_score_weights(spark, rows):
    data = codes(spark, [(1, 9, "4280"), (1, 10, "N18"), (1, 10, "E11"), (2, 9, "5859"), (3, 9, "x")])
    out = flags.comorbidity_flags(data, "hadm_id", COMORBIDITY, COMORBIDITY_WEIGHTS, "score")
    assert rows(out, "hadm_id", "score") == [(1, 4), (2, 2), (3, 0)]


def test_one_pass_equals_both_tables(spark, rows):
    data = codes(spark, [(i % 5, (9, 10, 8)[i % 3], c) for i, c in enumerate("4280 I50 5851 N18 250 E11 491 J44 571 K70 140 C1 433 G45 401 I10 410 I21".split())])
    both = flags.all_code_flags(data, "hadm_id", COMORBIDITY, COMORBIDITY_WEIGHTS, "score", CHRONIC)
    one = flags.comorbidity_flags(data, "hadm_id", COMORBIDITY, COMORBIDITY_WEIGHTS, "score")
    two = flags.chronic_groups(data, "hadm_id", CHRONIC)
    names = ["hadm_id", *[r.name for r in COMORBIDITY], *[r.name for r in CHRONIC], "score"]
    assert rows(both, *names) == rows(one.join(two, "hadm_id"), *names)


def test_medication_text_null_and_case(spark, rows):
    anchors = spark.createDataFrame([(1, T0), (2, T0)], "hadm_id long, admittime timestamp_ntz")
    rx = spark.createDataFrame(
        [(1, "NORepinephrine", T0), (1, None, T0), (2, None, T0), (2, "Insulin", T0 + DAY), (2, "Aspirin", None)],
        "hadm_id long, drug string, starttime timestamp_ntz",
    )
    out = flags.medication_flags(anchors, rx, "hadm_id", "admittime", DAY, MEDICATIONS)
    assert rows(out, "hadm_id", "vasopressor_24h", "insulin_24h", "anticoag_antiplatelet_24h") == [(1, 1, 0, 0), (2, 0, 0, 0)]
    coded = rx.select("hadm_id", "starttime", F.xxhash64("drug").alias("itemid"))
    dictionary = rx.select(F.xxhash64("drug").alias("itemid"), "drug").distinct()
    same = flags.medication_flags(anchors, coded, "hadm_id", "admittime", DAY, MEDICATIONS, dictionary)
    assert rows(same) == rows(out)


def test_saline_counts_as_a_line(spark, rows):
    items = spark.createDataFrame([(1, "Saline flush"), (2, "Art-line"), (3, None)], "itemid int, label string")
    out = flags.label_flags(items, PROCEDURES)
    assert rows(out, "itemid", "arterial_line_24h") == [(1, 1), (2, 0), (3, None)]


def test_procedures_need_a_stay(spark, rows):
    anchors = spark.createDataFrame([(1, T0), (2, T0)], "hadm_id long, admittime timestamp_ntz")
    stays = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "hadm_id long, stay_id long")
    procedures = spark.createDataFrame(
        [(10, 1, T0), (11, 2, T0 + DAY), (20, 3, T0), (99, 1, T0)], "stay_id long, itemid int, starttime timestamp_ntz"
    )
    items = spark.createDataFrame([(1, "Intubation"), (2, "Dialysis - CRRT"), (4, "other")], "itemid int, label string")
    out = flags.procedure_flags(anchors, stays, procedures, items, "hadm_id", "admittime", DAY, PROCEDURES)
    assert rows(out, "hadm_id", "airway_intubation_24h", "dialysis_24h") == [(1, 1, 0)]


def test_label_and_age_rules(spark, rows):
    data = spark.createDataFrame(
        [(1, 1, 50, 2100, datetime(2103, 5, 1)), (2, None, 17, 2100, datetime(2100, 1, 1)), (3, 0, 17, 2100, datetime(2101, 1, 1))],
        "k int, hospital_expire_flag int, anchor_age int, anchor_year int, admittime timestamp_ntz",
    )
    out = data.select("k", rules.binary_label("hospital_expire_flag").alias("y"), rules.age_at_anchor("anchor_age", "anchor_year", "admittime").cast("double").alias("a"))
    assert rows(out) == [(1, 1, 53.0), (2, 0, 17.0), (3, 0, 18.0)]


def test_clinical_rules_have_every_group():
    assert len(CLINICAL.extended.items) == 14 and len(CLINICAL.core.items) == 4
    assert len(MEDICATIONS) == 6 and len(PROCEDURES) == 5 and len(CHRONIC) == 6
