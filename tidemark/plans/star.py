"""Preset for an order/line-item schema: the same roles on other tables.

Orders are entities, customers subjects, line items the long event tables,
and part names the free text.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.plans.clinical import CHRONIC, COMORBIDITY, COMORBIDITY_WEIGHTS, PLAUSIBLE
from tidemark.plans.features import FeaturePlan
from tidemark.sources.tables import LazyTables, load_tables
from tidemark.specs import Panel, Study, TextRule, Vitals

STAR_TABLES = ("customer", "orders", "lineitem", "events", "part", "documents", "labels")

STAR = Study(
    core=Panel({i: f"item{i}" for i in range(1, 5)}),
    extended=Panel({i: f"item{i}" for i in range(1, 8)}),
    comorbidity=COMORBIDITY,
    weights=COMORBIDITY_WEIGHTS,
    chronic=CHRONIC,
    medications=(
        TextRule("med_ring_rod", "ring|rod"),
        TextRule("med_small_plate", "small.*plate"),
        TextRule("med_bolt", "bolt"),
        TextRule("med_gear_widget", "gear|widget"),
        TextRule("med_gizmo", "gizmo"),
        TextRule("med_hot_cold", "hot|cold"),
    ),
    procedures=(
        TextRule("proc_large_ring", "large.*ring"),
        TextRule("proc_color_rod", "(blue|red).*rod"),
        TextRule("proc_old_gear", "old[- ]?gear"),
        TextRule("proc_anvil", "anvil"),
        TextRule("proc_new_bolt", "new.*bolt"),
    ),
    vitals=Vitals(
        {1: "hr", 2: "rr", 3: "sbp", 4: "sbp", 5: "dbp", 6: "temp_f", 7: "temp_c"}, PLAUSIBLE, suffix=""
    ),
    window=timedelta(days=365),
    split_cut=2003,
    demographics=("gender", "admission_type", "insurance"),
    stay_columns=("first_careunit",),
    left_out={
        ("V5", "linear"): ("med_bolt",),
        ("V5", "tree"): ("med_bolt",),
        ("V6", "linear"): ("med_bolt",),
        ("V6", "tree"): ("med_bolt",),
    },
)

# Charted items of the click-stream table.
EVENT_VITALS = Vitals(
    {"click": "hr", "view": "rr", "purchase": "sbp", "error": "temp_f", "signup": "temp_c"}, PLAUSIBLE, suffix=""
)
EVENT_WINDOW = timedelta(hours=24)


STAY_ID = "((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber"
URGENT = "CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END"


def star_tables(spark: SparkSession, folder: str) -> LazyTables:
    """Roles of a feature plan, and a few more, over the tables in ``folder``."""
    base = load_tables(spark, folder, STAR_TABLES)
    roles = {
        "patients": _patients,
        "admissions": _admissions,
        "labs": _labs,
        "diagnoses": _diagnoses,
        "prescriptions": _prescriptions,
        "drug_items": lambda t: t["part"].selectExpr("p_partkey AS itemid", "p_name AS drug"),
        "stays": _stays,
        "procedures": _procedures,
        "items": lambda t: t["part"].selectExpr("p_partkey AS itemid", "p_name AS label"),
        "vitals": _vitals,
        "event_vitals": _event_vitals,
        "event_anchors": _event_anchors,
        "scored": _scored,
        "docs": _docs,
    }
    makers = {name: lambda n=name: base[n] for name in base}
    makers |= {name: lambda make=make: make(base) for name, make in roles.items()}
    return LazyTables(makers)


def _patients(t) -> DataFrame:
    return t["customer"].select(
        F.col("c_custkey").alias("subject_id"),
        (F.col("c_custkey") % 70 + 10).cast("int").alias("anchor_age"),
        (F.col("c_nationkey") + 1990).cast("int").alias("anchor_year"),
        F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender"),
        F.col("c_mktsegment").alias("insurance"),
    )


def _admissions(t) -> DataFrame:
    return t["orders"].select(
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderdate").alias("admittime"),
        F.expr(URGENT).alias("hospital_expire_flag"),
        F.col("o_orderstatus").alias("admission_type"),
    )


def _labs(t) -> DataFrame:
    return t["lineitem"].select(
        F.col("l_orderkey").alias("hadm_id"),
        F.col("l_linenumber").alias("itemid"),
        F.when(F.col("l_discount") != 0, F.col("l_quantity")).alias("valuenum"),
        F.col("l_shipdate").alias("charttime"),
    )


def _diagnoses(t) -> DataFrame:
    old_code = F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0")
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    letter = F.substring(letters, (F.col("l_partkey") % 26 + 1).cast("int"), F.lit(1))
    new_code = F.concat(letter, F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0"))
    old_system = F.col("l_linestatus") == "F"
    return t["lineitem"].select(
        F.col("l_orderkey").alias("hadm_id"),
        F.when(old_system, 9).otherwise(10).alias("icd_version"),
        F.when(old_system, old_code).otherwise(new_code).alias("icd_code"),
    )


def _prescriptions(t) -> DataFrame:
    return t["lineitem"].select(
        F.col("l_orderkey").alias("hadm_id"),
        F.col("l_partkey").alias("itemid"),
        F.col("l_shipdate").alias("starttime"),
    )


def _stays(t) -> DataFrame:
    return t["lineitem"].where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("hadm_id"),
        F.expr(STAY_ID).alias("stay_id"),
        F.col("l_shipdate").alias("intime"),
        F.col("l_linestatus").alias("first_careunit"),
    )


def _procedures(t) -> DataFrame:
    return t["lineitem"].where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("hadm_id"),
        F.expr(STAY_ID).alias("stay_id"),
        F.col("l_partkey").alias("itemid"),
        F.col("l_shipdate").alias("starttime"),
    )


def _vitals(t) -> DataFrame:
    charted = t["lineitem"].select(
        F.col("l_orderkey").alias("hadm_id"),
        F.col("l_linenumber").alias("itemid"),
        F.col("l_quantity").alias("valuenum"),
        F.col("l_shipdate").alias("charttime"),
    )
    owners = t["orders"].select(F.col("o_orderkey").alias("hadm_id"), F.col("o_custkey").alias("subject_id"))
    return charted.join(owners, ["hadm_id"])


def _event_vitals(t) -> DataFrame:
    return t["events"].select(
        F.col("user_id").alias("subject_id"),
        F.col("event_type").alias("itemid"),
        F.col("value").alias("valuenum"),
        F.col("ts").alias("charttime"),
    )


def _event_anchors(t) -> DataFrame:
    first = t["events"].groupBy("user_id").agg(F.min("ts").alias("admittime"))
    return first.select(F.col("user_id").alias("hadm_id"), F.col("user_id").alias("subject_id"), "admittime")


def _scored(t) -> DataFrame:
    return t["orders"].select(
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_custkey").alias("subject_id"),
        F.expr(URGENT).alias("y"),
        (F.floor(F.col("o_totalprice") / 1000) / 1000.0).cast("double").alias("y_pred_proba"),
    )


def _docs(t) -> DataFrame:
    known = t["documents"].select("doc_id", "n_chars", "lang", "source").join(t["labels"], "doc_id")
    return known.select(
        F.col("doc_id").alias("hadm_id"), F.col("quality").alias("y"), "toxic", "n_chars", "lang", "source"
    )


def star_plan(spark: SparkSession, folder: str) -> FeaturePlan:
    return FeaturePlan(STAR, star_tables(spark, folder))
