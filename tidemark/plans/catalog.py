"""Every operator as a named query over the star preset, with its SQL twin.

``QUERIES[name](spark, folder)`` returns a DataFrame; ``ORACLES[name]`` is the
same result in SQL for another engine.  Queries whose result is no SQL query
(model fits) have no twin.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import columns as rules
from tidemark.functions.prefix import global_rank
from tidemark.operators import assemble, attributions, checks, cohort, curves, errors, events, flags, gates, prep, train
from tidemark.plans import oracle as o, reports
from tidemark.plans.features import FeaturePlan
from tidemark.plans.star import EVENT_VITALS, EVENT_WINDOW, STAR, star_plan
from tidemark.session import shared_folder
from tidemark.sources import artifacts, tables
from tidemark.specs import Codes, FeatureSet, feature_set

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SCORE, LABEL, KEY = "y_pred_proba", "y", "hadm_id"
GRADE = 0.25
NUMBERS = ["age_at_admit", "charlson_min", *[f"item{i}_first" for i in range(1, 8)]]
FLAGS = [f"item{i}_missing" for i in range(1, 8)]
MAY_BE_NULL = {"charlson_min", "strict", "raw_version", *o.MEDS, *o.PROCS, *o.CHRONIC}


def query(name: str, body: str | None = None):
    """Register a query; its result is given plain types for comparison."""

    def register(build: Callable[[FeaturePlan], DataFrame]):
        QUERIES[name] = lambda spark, folder: plain(build(star_plan(spark, folder)))
        if body is not None:
            ORACLES[name] = o.sql(body)
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Decimals and whole numbers that left joins make null become doubles,
    the one type that every engine's data frames show alike."""
    kinds = {c: kind for c, kind in df.dtypes if kind.startswith("decimal") or c in MAY_BE_NULL}
    return df.withColumns({c: F.col(c).cast("double") for c in kinds}) if kinds else df


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


def spark_of(plan: FeaturePlan) -> SparkSession:
    return plan.tables["orders"].sparkSession


# --- sources and sinks -------------------------------------------------------

ROLES = {
    "admissions": "adm",
    "patients": "pat",
    "labs": "lab",
    "diagnoses": "dx",
    "prescriptions": "lineitem",
    "stays": "stay",
    "procedures": "procev",
    "items": "d_items",
    "vitals": "chart_li",
}


@query(
    "source_tables",
    " UNION ALL ".join(f"SELECT '{role}' AS obj, count(*) AS n FROM {block}" for role, block in ROLES.items()),
)
def source_tables(plan):
    return checks.object_row_counts({role: plan.tables[role] for role in ROLES})


@query("load_features_with_split", "SELECT * FROM s1")
def load_features_with_split(plan):
    return tables.load_features_with_split(plan.features("V1"), plan.split("V1"), KEY)


@query("load_split_view", "SELECT * FROM s2")
def load_split_view(plan):
    tables.define_views({"split_v2": plan.split("V2")})
    return tables.load_split_view(spark_of(plan), "split_v2")


@query("define_view", "SELECT hadm_id, item1_first, item4_first FROM labs_core WHERE item1_first IS NOT NULL")
def define_view(plan):
    tables.define_views({"labs_first": plan.labs("core")})
    return spark_of(plan).sql(
        "SELECT hadm_id, item1_first, item4_first FROM labs_first WHERE item1_first IS NOT NULL"
    )


@query("materialize_features", "SELECT * FROM feat1")
def materialize_features(plan):
    return tables.materialize(plan.features("V1"), scratch(spark_of(plan)), sort_by=[KEY])


@query("typed_empty_table", "SELECT * FROM stay_vitals")
def typed_empty_table(plan):
    empty = tables.typed_empty_table(spark_of(plan), tables.stay_vitals_schema(STAR))
    return empty.unionByName(plan.stay_vitals())


PREDICTED = (
    "SELECT hadm_id, subject_id, y, y_pred_proba, CAST(y_pred_proba >= 0.5 AS INT) AS y_pred_label_05, "
    "row_number() OVER (ORDER BY y_pred_proba DESC, hadm_id) AS rank_desc FROM scored"
)


def predicted(plan) -> DataFrame:
    return errors.add_prediction_columns(plan.tables["scored"], SCORE, KEY)


@query("write_predictions", PREDICTED)
def write_predictions(plan):
    path = scratch(spark_of(plan))
    artifacts.write_predictions(predicted(plan), path)
    return spark_of(plan).read.parquet(path)


@query("read_predictions", "SELECT hadm_id, y, y_pred_proba, CAST(y_pred_proba >= 0.5 AS INT) AS y_pred_label_05 FROM scored")
def read_predictions(plan):
    path = scratch(spark_of(plan))
    kept = predicted(plan).select(KEY, LABEL, SCORE, "y_pred_label_05")
    artifacts.write_predictions(kept, path, "csv")
    schema = "hadm_id long, y int, y_pred_proba double, y_pred_label_05 int"
    return artifacts.read_predictions(spark_of(plan), path, [LABEL, SCORE, "y_pred_label_05"], "csv", schema)


@query("write_reports", f"SELECT scenario, threshold, f1, alerts, tp FROM ({o.at_thresholds('chosen', 'scenario, threshold')}) q")
def write_reports(plan):
    path = scratch(spark_of(plan))
    artifacts.write_report(scenarios(plan), path)
    schema = "scenario string, threshold double, f1 double, alerts long, tp long"
    return rounded(spark_of(plan).read.schema(schema).json(path), ["f1"])


# --- projections, filters, predicates ----------------------------------------

BASE_COLUMNS = "hadm_id, subject_id, admittime, y_inhosp_death, age_at_admit, gender, admission_type, insurance"


@query("cohort_base", f"SELECT {BASE_COLUMNS} FROM base")
def cohort_base(plan):
    return plan.base.drop("anchor_year")


@query("binary_label", "SELECT hadm_id, CASE WHEN hospital_expire_flag = 1 THEN 1 ELSE 0 END AS label FROM adm")
def binary_label(plan):
    return plan.tables["admissions"].select(KEY, rules.binary_label("hospital_expire_flag").alias("label"))


@query(
    "age_at_anchor",
    "SELECT hadm_id, CAST(round(anchor_age + year(admittime) - anchor_year, 1) AS DOUBLE) AS age FROM adm JOIN pat USING (subject_id)",
)
def age_at_anchor(plan):
    joined = cohort.join_subject(plan.tables["admissions"], plan.tables["patients"], "subject_id")
    return joined.select(KEY, rules.age_at_anchor("anchor_age", "anchor_year", "admittime").alias("age"))


@query("item_filter", "SELECT hadm_id, itemid, valuenum, charttime FROM lab WHERE valuenum IS NOT NULL AND itemid IN (1, 2, 3, 4)")
def item_filter(plan):
    return events.pick_items(plan.tables["labs"], list(STAR.core.items))


@query("canonical_item", f"SELECT * FROM (SELECT subject_id, charttime, valuenum, {o.EVENT_NAMES} AS name FROM chart) q WHERE name IS NOT NULL")
def canonical_item(plan):
    named = plan.tables["event_vitals"].select(
        "subject_id", "charttime", "valuenum", rules.canonical_item("itemid", EVENT_VITALS.items).alias("name")
    )
    return named.where(F.col("name").isNotNull())


@query(
    "unit_harmonize",
    "SELECT subject_id, charttime, CASE WHEN raw IN ('temp_f', 'temp_c') THEN 'temp' ELSE raw END AS name, "
    "round(CASE WHEN raw = 'temp_f' THEN (valuenum - 32) * 5 / 9 ELSE valuenum END, 6) AS value "
    f"FROM (SELECT *, {o.EVENT_NAMES} AS raw FROM chart) q",
)
def unit_harmonize(plan):
    return plan.tables["event_vitals"].select(
        "subject_id",
        "charttime",
        rules.canonical_item("itemid", EVENT_VITALS.merged).alias("name"),
        F.round(rules.harmonized_value("itemid", "valuenum", EVENT_VITALS), 6).alias("value"),
    )


@query("plausible_range", "SELECT subject_id, charttime, vital_name, round(vital_value, 6) AS vital_value FROM allclean")
def plausible_range(plan):
    cleaned = events.clean_vitals(plan.tables["event_vitals"], EVENT_VITALS)
    return rounded(cleaned.select("subject_id", "charttime", "vital_name", "vital_value"), ["vital_value"])


@query("missing_flags", f"SELECT hadm_id, {o._missing(o.LABS)} FROM base LEFT JOIN labs_ext USING (hadm_id)")
def missing_flags(plan):
    wide = assemble.left_assemble(plan.base.select(KEY), [plan.labs()], [KEY])
    return assemble.with_missing_flags(wide, STAR.extended.stems).select(KEY, *FLAGS)


@query(
    "code_version",
    "SELECT CAST(v AS DOUBLE) AS raw_version, CAST(CASE WHEN v = 9 THEN 9 WHEN v = 10 THEN 10 END AS DOUBLE) AS strict, CASE WHEN v = 9 THEN 9 ELSE 10 END AS loose, "
    "count(*) AS n FROM (SELECT CASE WHEN l_linenumber < 7 THEN l_linenumber + 5 END AS v FROM lineitem) q GROUP BY 1, 2, 3",
)
def code_version(plan):
    versions = plan.tables["lineitem"].select(
        F.when(F.col("l_linenumber") < 7, F.col("l_linenumber") + 5).alias("raw_version")
    )
    systems = versions.select(
        "raw_version",
        rules.code_system("raw_version", strict=True).alias("strict"),
        rules.code_system("raw_version", strict=False).alias("loose"),
    )
    return systems.groupBy("raw_version", "strict", "loose").agg(F.count(F.lit(1)).alias("n"))


@query("code_prefix_match", f"SELECT icd_version, icd_code, CAST({o.code_flag('copd', True)} AS DOUBLE) AS copd, CAST({o.code_flag('cad', False)} AS DOUBLE) AS cad FROM dx")
def code_prefix_match(plan):
    named = {rule.name: rule for rule in STAR.chronic}
    return plan.tables["diagnoses"].select(
        "icd_version",
        "icd_code",
        rules.code_rule(named["copd"], rules.code_system("icd_version", True), "icd_code").alias("copd"),
        rules.code_rule(named["cad"], rules.code_system("icd_version", False), "icd_code").alias("cad"),
    )


@query(
    "code_range_match",
    "SELECT icd_code, count(*) AS n FROM dx WHERE icd_version = 9 AND (icd_code BETWEEN '140' AND '239' OR icd_code BETWEEN '585' AND '5859') GROUP BY icd_code",
)
def code_range_match(plan):
    ranges = Codes(ranges=[("140", "239"), ("585", "5859")])
    hits = plan.tables["diagnoses"].where((F.col("icd_version") == 9) & rules.code_matches("icd_code", ranges))
    return hits.groupBy("icd_code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "text_group_flags_predicate",
    "SELECT p_partkey AS itemid, "
    + o.comma(f"CAST(regexp_matches(lower(p_name), '({p})') AS DOUBLE) AS {n}" for n, p in o.PROCS.items())
    + " FROM part",
)
def text_group_flags_predicate(plan):
    return flags.label_flags(plan.tables["items"], STAR.procedures)


NULLABLE = (
    "SELECT CASE WHEN l_linenumber <> 7 THEN l_orderkey END AS hadm_id, CASE WHEN l_quantity <> 13 THEN l_partkey END AS stay_id, "
    "CASE WHEN l_tax <> 0 THEN l_shipdate END AS intime FROM lineitem"
)


@query(
    "drop_null_keys",
    f"SELECT * FROM ({NULLABLE}) q WHERE hadm_id IS NOT NULL AND stay_id IS NOT NULL AND intime IS NOT NULL",
)
def drop_null_keys(plan):
    nullable = plan.tables["lineitem"].select(
        F.when(F.col("l_linenumber") != 7, F.col("l_orderkey")).alias("hadm_id"),
        F.when(F.col("l_quantity") != 13, F.col("l_partkey")).alias("stay_id"),
        F.when(F.col("l_tax") != 0, F.col("l_shipdate")).alias("intime"),
    )
    return nullable.dropna(subset=["hadm_id", "stay_id", "intime"])


@query("select_candidates", "SELECT hadm_id, age_at_admit, item2_first, charlson_min FROM feat2")
def select_candidates(plan):
    df = plan.features("V2")
    wanted = ["age_at_admit", "item2_first", "age_at_admit", "no_such_column", "charlson_min"]
    return df.select(KEY, *assemble.select_candidates(df, wanted))


@query("feature_set", "SELECT hadm_id, " + o.comma(feature_set(STAR, "V3", "linear").columns) + " FROM feat3")
def feature_sets(plan):
    return plan.features("V3").select(KEY, *feature_set(STAR, "V3", "linear").columns)


@query("train_valid_filter", "SELECT * FROM s1 WHERE split = 'valid'")
def train_valid_filter(plan):
    return assemble.split_rows(plan.split("V1"), "valid")


@query("require_columns", "SELECT hadm_id, y, y_pred_proba FROM scored")
def require_columns(plan):
    return assemble.require_columns(plan.tables["scored"], [LABEL, SCORE]).select(KEY, LABEL, SCORE)


# --- joins -------------------------------------------------------------------


@query("join_subject", "SELECT hadm_id, subject_id, anchor_age, anchor_year, gender FROM adm JOIN pat USING (subject_id)")
def join_subject(plan):
    joined = cohort.join_subject(plan.tables["admissions"], plan.tables["patients"], "subject_id")
    return joined.select(KEY, "subject_id", "anchor_age", "anchor_year", "gender")


@query("window_join_labs", "SELECT hadm_id, itemid, valuenum, charttime FROM labwin")
def window_join_labs(plan):
    wanted = events.pick_items(plan.tables["labs"], list(STAR.extended.items))
    anchors = plan.tables["admissions"]
    return events.event_window(anchors, wanted, [KEY], "admittime", "charttime", STAR.window, prune_scan=True)


@query("window_join_text", "SELECT hadm_id, drug, starttime FROM rxwin")
def window_join_text(plan):
    rows = plan.tables["prescriptions"]
    inside = events.event_window(plan.tables["admissions"], rows, [KEY], "admittime", "starttime", STAR.window)
    return inside.join(plan.tables["drug_items"], ["itemid"]).select(KEY, "drug", "starttime")


@query("window_join_two_keys", "SELECT hadm_id, subject_id, itemid, valuenum, charttime FROM vitwin")
def window_join_two_keys(plan):
    keys = [KEY, "subject_id"]
    return events.event_window(plan.base, plan.tables["vitals"], keys, "admittime", "charttime", STAR.window).select(
        *keys, "itemid", "valuenum", "charttime"
    )


@query("multi_hop_join", "SELECT hadm_id, stay_id, starttime, label FROM procwin")
def multi_hop_join(plan):
    t = plan.tables
    inside = flags.procedure_events(t["admissions"], t["stays"], t["procedures"], KEY, "admittime", STAR.window)
    return inside.join(t["items"], ["itemid"]).select(KEY, "stay_id", "starttime", "label")


@query(
    "assemble_left_joins",
    f"SELECT hadm_id, item1_first, charlson_min, {o.comma(o.CHRONIC)} FROM base LEFT JOIN labs_core USING (hadm_id) LEFT JOIN comorb USING (hadm_id) LEFT JOIN chronic USING (hadm_id)",
)
def assemble_left_joins(plan):
    parts = [plan.labs("core"), plan.comorbidity(), plan.chronic()]
    wide = assemble.left_assemble(plan.base.select(KEY), parts, [KEY])
    return wide.select(KEY, "item1_first", "charlson_min", *o.CHRONIC)


@query("join_first_stay", "SELECT feat1.*, s.stay_id, s.intime, s.first_careunit FROM feat1 JOIN stay1 s ON s.hadm_id = feat1.hadm_id")
def join_first_stay(plan):
    return cohort.with_first_stay(plan.features("V1"), plan.tables["stays"], KEY, STAR.stay_columns)


@query("join_stay_features", "SELECT s.hadm_id, s.stay_id, v.hr_first, v.sbp_max FROM stay1 s LEFT JOIN stay_vitals v ON v.stay_id = s.stay_id AND v.hadm_id = s.hadm_id")
def join_stay_features(plan):
    first = cohort.first_stay(plan.tables["stays"]).select(KEY, "stay_id")
    vitals = plan.stay_vitals().drop("intime")
    return assemble.left_assemble(first, [vitals], ["stay_id", KEY]).select(KEY, "stay_id", "hr_first", "sbp_max")


@query("cohort_without_stay", f"SELECT {BASE_COLUMNS} FROM base WHERE NOT EXISTS (SELECT 1 FROM stay s WHERE s.hadm_id = base.hadm_id)")
def cohort_without_stay(plan):
    return cohort.by_stay(cohort_base(plan), plan.tables["stays"], KEY, has_stay=False)


@query("cohort_with_stay", f"SELECT {BASE_COLUMNS} FROM base WHERE EXISTS (SELECT 1 FROM stay s WHERE s.hadm_id = base.hadm_id)")
def cohort_with_stay(plan):
    return cohort.by_stay(cohort_base(plan), plan.tables["stays"], KEY, has_stay=True)


@query("inherit_split", "SELECT b.hadm_id, s.split FROM base b JOIN s1 s ON s.hadm_id = b.hadm_id WHERE NOT EXISTS (SELECT 1 FROM stay t WHERE t.hadm_id = b.hadm_id)")
def inherit_split(plan):
    members = cohort.by_stay(plan.base.select(KEY), plan.tables["stays"], KEY, has_stay=False)
    return assemble.inherit_split(members, plan.split("V1"), KEY)


@query("join_subject_for_split", "SELECT f.*, CASE WHEN p.anchor_year < 2003 THEN 'train' ELSE 'valid' END AS split FROM feat1 f JOIN pat p ON p.subject_id = f.subject_id")
def join_subject_for_split(plan):
    return plan.split("V1", features=plan.features("V1"))


# --- aggregations ------------------------------------------------------------


@query("first_value_pivot", "SELECT * FROM labs_ext")
def first_value_pivot(plan):
    wanted = events.pick_items(plan.tables["labs"], list(STAR.extended.items))
    inside = events.event_window(plan.tables["admissions"], wanted, [KEY], "admittime", "charttime", STAR.window)
    return events.pivot_first(inside, [KEY], STAR.extended)


def event_window_vitals(plan) -> DataFrame:
    cleaned = events.clean_vitals(plan.tables["event_vitals"], EVENT_VITALS)
    return events.event_window(
        plan.tables["event_anchors"], cleaned, ["subject_id"], "admittime", "charttime", EVENT_WINDOW, carry=[KEY]
    )


@query(
    "min_max_pivot",
    "SELECT hadm_id, "
    + o.comma(f"round({k}(CASE WHEN vital_name = '{v}' THEN vital_value END), 6) AS {v}_{k}" for v in o.VITALS for k in ("min", "max"))
    + " FROM eventclean GROUP BY hadm_id",
)
def min_max_pivot(plan):
    wide = events.min_max_pivot(event_window_vitals(plan), [KEY], EVENT_VITALS)
    return rounded(wide, wide.columns[1:])


ROUNDED_VITALS = o.comma(f"round({v}_{k}, 6) AS {v}_{k}" for v in o.VITALS for k in ("first", "min", "max"))


@query("first_min_max_summary", f"SELECT hadm_id, {ROUNDED_VITALS} FROM vitals")
def first_min_max_summary(plan):
    return rounded(plan.vitals(), STAR.vitals.value_columns)


@query("labs_core_24h", "SELECT * FROM labs_core")
def labs_core(plan):
    return plan.labs("core")


@query("labs_ext_24h", "SELECT * FROM labs_ext")
def labs_ext(plan):
    return plan.labs("extended")


@query("comorbidity_flags", "SELECT hadm_id, chf, renal, dm FROM comorb")
def comorbidity_flags(plan):
    return plan.comorbidity().select(KEY, *o.COMORBIDITY)


@query("weighted_score", "SELECT hadm_id, charlson_min FROM comorb")
def weighted_score(plan):
    return plan.comorbidity().select(KEY, "charlson_min")


@query(
    "chronic_groups",
    "SELECT CAST(hadm_id AS DOUBLE) AS hadm_id, "
    + o.comma(f"CAST(max({o.code_flag(n, False)}) AS DOUBLE) AS {n}" for n in o.CHRONIC)
    + " FROM (SELECT CASE WHEN hadm_id % 10 <> 3 THEN hadm_id END AS hadm_id, icd_version, icd_code FROM dx) q GROUP BY hadm_id",
)
def chronic_groups(plan):
    # some codes lose their entity: they form one group of their own
    loose = plan.tables["diagnoses"].withColumn(KEY, F.when(F.col(KEY) % 10 != 3, F.col(KEY)))
    return flags.chronic_groups(loose, KEY, STAR.chronic).withColumn(KEY, F.col(KEY).cast("double"))


@query("med_group_flags", "SELECT * FROM meds")
def med_group_flags(plan):
    return plan.medications()


@query("proc_group_flags", "SELECT * FROM procs")
def proc_group_flags(plan):
    return plan.procedures()


def _v1_tables(plan) -> dict[str, DataFrame]:
    return {
        "base": plan.base,
        "labs": plan.labs("core"),
        "comorbidity": plan.comorbidity(),
        "features": plan.features("V1"),
        "split": plan.split("V1"),
    }


V1_BLOCKS = {"base": "base", "labs": "labs_core", "comorbidity": "comorb", "features": "feat1", "split": "s1"}


@query("object_row_counts", " UNION ALL ".join(f"SELECT '{k}' AS obj, count(*) AS n FROM {v}" for k, v in V1_BLOCKS.items()))
def object_row_counts(plan):
    return checks.object_row_counts(_v1_tables(plan))


@query(
    "key_profile",
    " UNION ALL ".join(
        f"SELECT '{k}' AS obj, count(*) AS n, count(DISTINCT hadm_id) AS n_distinct, count(*) FILTER (hadm_id IS NULL) AS n_null FROM {V1_BLOCKS[k]}"
        for k in ("base", "features", "split")
    )
    + f" UNION ALL SELECT 'line_keys', count(*), count(DISTINCT hadm_id), count(*) FILTER (hadm_id IS NULL) FROM ({NULLABLE}) q",
)
def key_profile(plan):
    known = _v1_tables(plan)
    lines = plan.tables["lineitem"].select(F.when(F.col("l_linenumber") != 7, F.col("l_orderkey")).alias(KEY))
    profiled = {name: known[name] for name in ("base", "features", "split")}
    return checks.key_profile({**profiled, "line_keys": lines}, KEY)


@query("outcome_counts", "SELECT y_inhosp_death, count(*) AS n FROM s1 GROUP BY 1")
def outcome_counts(plan):
    return checks.counts_by(plan.split("V1"), ["y_inhosp_death"])


@query("split_outcome_crosstab", "SELECT split, y_inhosp_death, count(*) AS n FROM s1 GROUP BY 1, 2")
def split_outcome_crosstab(plan):
    return checks.counts_by(plan.split("V1"), ["split", "y_inhosp_death"])


NULL_COLUMNS = ["item1_first", "item2_first", "item3_first", "item4_first", "charlson_min"]


@query(
    "null_rates",
    "SELECT count(*) AS n, "
    + o.comma(f"round(avg(CAST({c} IS NULL AS INT)), 4) AS {c}_null_rate" for c in NULL_COLUMNS)
    + " FROM s1",
)
def null_rates(plan):
    return checks.null_rates(plan.split("V1"), NULL_COLUMNS)


@query(
    "missing_ranking",
    "SELECT feature, round(missing_rate, 6) AS missing_rate FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CAST({c} IS NULL AS INT)) AS missing_rate FROM feat2" for c in NUMBERS)
    + ") q ORDER BY missing_rate DESC, feature LIMIT 20",
)
def missing_ranking(plan):
    return rounded(checks.missing_ranking(plan.features("V2"), NUMBERS), ["missing_rate"])


@query(
    "split_rule_profile",
    "SELECT split, min(p.anchor_year) AS min_anchor_year, max(p.anchor_year) AS max_anchor_year, count(*) AS n FROM s1 JOIN pat p USING (subject_id) GROUP BY split",
)
def split_rule_profile(plan):
    years = plan.tables["patients"].select("subject_id", "anchor_year")
    return checks.split_rule_profile(cohort.join_subject(plan.split("V1"), years, "subject_id"), "anchor_year")


@query("prevalence", "SELECT split, round(avg(y_inhosp_death), 6) AS prevalence, count(*) AS n FROM s1 GROUP BY split")
def prevalence(plan):
    return rounded(checks.prevalence(plan.split("V1"), "y_inhosp_death"), ["prevalence"])


@query(
    "class_weights",
    "SELECT CAST(p AS BIGINT) AS n_pos, CAST(n - p AS BIGINT) AS n_neg, round((n - p) / greatest(1, p), 6) AS pos_weight, "
    "round(n / (2.0 * (n - p)), 6) AS balanced_0, round(n / (2.0 * p), 6) AS balanced_1 "
    "FROM (SELECT CAST(sum(y_inhosp_death) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM s1 WHERE split = 'train') q",
)
def class_weights(plan):
    weights = checks.class_weights(assemble.split_rows(plan.split("V1"), "train"), "y_inhosp_death")
    return rounded(weights, ["pos_weight", "balanced_0", "balanced_1"])


@query(
    "vital_coverage",
    "SELECT cohort, count(*) AS n, round(avg(1 - none), 6) AS any_rate, round(avg(none), 6) AS none_rate FROM ("
    f"SELECT 'all' AS cohort, least({o.comma(f'{v}_missing' for v in o.VITALS)}) AS none FROM feat4 UNION ALL "
    f"SELECT CASE WHEN EXISTS (SELECT 1 FROM stay s WHERE s.hadm_id = feat4.hadm_id) THEN 'with_stay' ELSE 'without_stay' END, least({o.comma(f'{v}_missing' for v in o.VITALS)}) FROM feat4) q GROUP BY cohort",
)
def vital_coverage(plan):
    covered = checks.vital_coverage(plan.features("V4"), STAR.vitals.missing_columns, plan.tables["stays"], KEY)
    return rounded(covered, ["any_rate", "none_rate"])


# --- window functions --------------------------------------------------------


@query(
    "first_in_window",
    "SELECT hadm_id, itemid, charttime, valuenum AS first_value FROM labfirst",
)
def first_in_window(plan):
    wanted = events.pick_items(plan.tables["labs"], list(STAR.extended.items))
    inside = events.event_window(plan.tables["admissions"], wanted, [KEY], "admittime", "charttime", STAR.window)
    return events.first_in_window(inside, [KEY])


@query(
    "first_by_canonical_item",
    "SELECT hadm_id, vital_name, charttime, round(vital_value, 6) AS first_value FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id, vital_name ORDER BY charttime, vital_value) AS rn FROM eventclean) q WHERE rn = 1",
)
def first_by_canonical_item(plan):
    first = events.first_in_window(event_window_vitals(plan), [KEY], "vital_name", "charttime", "vital_value")
    return rounded(first, ["first_value"])


@query("first_stay", "SELECT hadm_id, stay_id, intime, first_careunit FROM stay1")
def first_stay(plan):
    return cohort.first_stay(plan.tables["stays"])


@query("risk_rank", "SELECT hadm_id, y_pred_proba, row_number() OVER (ORDER BY y_pred_proba DESC, hadm_id) AS rank_desc FROM scored")
def risk_rank(plan):
    return global_rank(plan.tables["scored"].select(KEY, SCORE), SCORE, KEY)


# --- sort, limit, sample, set operations -------------------------------------


@query("ordered_report", "SELECT admission_type, y_inhosp_death, count(*) AS n FROM base GROUP BY 1, 2 ORDER BY 1, 2")
def ordered_report(plan):
    return checks.counts_by(plan.base, ["admission_type", "y_inhosp_death"])


SAMPLE = ["hadm_id", "subject_id", "y_inhosp_death", "split", "item1_first", "charlson_min"]


@query("sample_rows", f"SELECT {o.comma(SAMPLE)} FROM s1 ORDER BY hadm_id LIMIT 10")
def sample_rows(plan):
    return checks.sample_rows(plan.split("V1"), SAMPLE, KEY)


def graded(plan) -> DataFrame:
    """V2 features with score, label, prediction at a fixed threshold and group."""
    scored = plan.tables["scored"].select(KEY, LABEL, SCORE)
    marked = scored.withColumn("yhat", (F.col(SCORE) >= GRADE).cast("int"))
    return errors.error_groups(plan.features("V2").join(marked, KEY), LABEL, "yhat")


@query("top_false_positives", "SELECT hadm_id, y_pred_proba FROM graded WHERE error_group = 'FP' ORDER BY y_pred_proba DESC, hadm_id LIMIT 200")
def top_false_positives(plan):
    return errors.top_false_positives(graded(plan), SCORE, KEY).select(KEY, SCORE)


@query("all_false_negatives", "SELECT hadm_id, y_pred_proba, item1_first FROM graded WHERE error_group = 'FN' ORDER BY y_pred_proba DESC, hadm_id")
def all_false_negatives(plan):
    return errors.all_false_negatives(graded(plan), SCORE, KEY).select(KEY, SCORE, "item1_first")


BUDGETS = (0, 1, 1000, 3000, 10**12)


def long_thresholds(curve: DataFrame, named: dict) -> DataFrame:
    fields = [f"t{i}" for i in range(len(named))]
    wide = curve.agg(*[c.alias(f) for f, c in zip(fields, named.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f).alias("threshold")) for n, f in zip(named, fields)])
    return wide.select(F.inline(rows))


def scored_curve(plan) -> DataFrame:
    return curves.score_curve(plan.tables["scored"], SCORE, LABEL)


@query(
    "topk_threshold",
    " UNION ALL ".join(
        f"SELECT 'top_{k}' AS rule, CASE WHEN {k} <= 0 THEN 1.0 WHEN {k} >= (SELECT count(*) FROM scored) THEN 0.0 "
        f"ELSE (SELECT min(y_pred_proba) FROM (SELECT y_pred_proba FROM scored ORDER BY y_pred_proba DESC LIMIT {k}) q) END::DOUBLE AS threshold"
        for k in BUDGETS
    ),
)
def topk_threshold(plan):
    return long_thresholds(scored_curve(plan), {f"top_{k}": curves.for_top_k(k) for k in BUDGETS})


@query(
    "union_all_counts",
    "SELECT split, 'features' AS part, count(*) AS n FROM s1 GROUP BY split UNION ALL SELECT split, 'positives', count(*) FROM s1 WHERE y_inhosp_death = 1 GROUP BY split",
)
def union_all_counts(plan):
    split = plan.split("V1")
    parts = {"features": split, "positives": split.where(F.col("y_inhosp_death") == 1)}
    return checks.union_all(
        [
            df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select("split", F.lit(name).alias("part"), "n")
            for name, df in parts.items()
        ]
    )


# --- splits and gates --------------------------------------------------------


@query(
    "time_split",
    "SELECT subject_id, CASE WHEN anchor_year < 2003 THEN 'train' ELSE 'valid' END AS split FROM (SELECT subject_id, CASE WHEN subject_id % 9 <> 4 THEN anchor_year END AS anchor_year FROM pat) q",
)
def time_split(plan):
    people = plan.tables["patients"].select(
        "subject_id", F.when(F.col("subject_id") % 9 != 4, F.col("anchor_year")).alias("anchor_year")
    )
    return assemble.time_split(people, "anchor_year", STAR.split_cut).select("subject_id", "split")


@query(
    "assert_tables_exist",
    " UNION ALL ".join(f"SELECT '{role}' AS obj, true AS present, count(*) AS n FROM {block}" for role, block in ROLES.items()),
)
def assert_tables_exist(plan):
    spark = spark_of(plan)
    views = {f"role_{role}": plan.tables[role] for role in ROLES}
    tables.define_views(views)
    checks.assert_tables_exist(spark, list(views))
    there = checks.presence(spark, list(views))
    return checks.union_all(
        [
            spark.table(view).agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(view.removeprefix("role_")).alias("obj"), F.lit(there[view]).alias("present"), "n"
            )
            for view in views
        ]
    )


@query(
    "assert_row_counts_match",
    "SELECT 'split<>features' AS check, (SELECT count(*) FROM s1 WHERE split = 'train') AS n, (SELECT count(*) FROM feat1) AS expected",
)
def assert_row_counts_match(plan):
    # half of the split table is withheld, so one violation must be reported
    train_only = assemble.split_rows(plan.split("V1"), "train")
    return checks.row_count_violations(plan.base, plan.features("V1"), train_only)


@query(
    "assert_unique_key",
    "SELECT l_orderkey AS hadm_id, l_linenumber AS itemid, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def assert_unique_key(plan):
    checks.assert_unique_key(plan.features("V1"), [KEY])
    return checks.duplicate_keys(plan.tables["labs"], [KEY, "itemid"])


@query("assert_label_valid", "SELECT l_orderkey AS hadm_id, l_linenumber AS label FROM lineitem WHERE l_linenumber > 1")
def assert_label_valid(plan):
    checks.assert_label_valid(plan.base, "y_inhosp_death")
    return checks.invalid_labels(plan.tables["labs"].select(KEY, F.col("itemid").alias("label")), "label")


@query("assert_no_stay", "SELECT hadm_id FROM base WHERE EXISTS (SELECT 1 FROM stay s WHERE s.hadm_id = base.hadm_id)")
def assert_no_stay(plan):
    stays = plan.tables["stays"]
    checks.assert_no_stay(cohort.by_stay(plan.base, stays, KEY, has_stay=False), stays, KEY)
    return checks.entities_with_stay(plan.base, stays, KEY)


@query("assert_known_error_group", "SELECT l_orderkey AS hadm_id, l_linenumber AS yhat FROM lineitem WHERE l_linenumber > 1")
def assert_known_error_group(plan):
    checks.assert_known_error_group(graded(plan))
    odd = plan.tables["labs"].select(KEY, F.lit(1).alias(LABEL), F.col("itemid").alias("yhat"))
    return checks.unknown_error_groups(errors.error_groups(odd, LABEL, "yhat")).select(KEY, "yhat")


CHECKED = {
    "rows": "count(*)",
    "null_key": "count(*) - count(hadm_id)",
    "repeated_key": "count(*) - count(DISTINCT hadm_id)",
    "invalid_label": "count(*) FILTER (y_inhosp_death IS NULL OR y_inhosp_death NOT IN (0, 1))",
    **{f"outcome:{s}:{y}": f"count(*) FILTER (split = '{s}' AND y_inhosp_death = {y})" for s in ("train", "valid") for y in (0, 1)},
    **{f"null:{c}": f"count(*) - count({c})" for c in NULL_COLUMNS},
}


@query("checked_write", " UNION ALL ".join(f"SELECT '{name}' AS measure, {count} AS n FROM s1" for name, count in CHECKED.items()))
def checked_write(plan):
    """Row counts, keys, labels, outcomes by split and null rates, collected while the V1 split is written."""
    written = gates.write_checked(plan.split("V1"), scratch(spark_of(plan)), [KEY], label=STAR.label, nulls=NULL_COLUMNS)
    return written.require(empty=False).profile(spark_of(plan))


# --- assembled versions ------------------------------------------------------

for _i in range(1, 4):
    query(f"features_v{_i}", f"SELECT * FROM feat{_i}")(lambda plan, v=f"V{_i}": plan.features(v))


def rounded_block(block: str, rest: str) -> str:
    return f"SELECT {rest}, {ROUNDED_VITALS} FROM {block}"


V3_NAMES = o.comma(FeaturePlan(STAR, {"stays": None}).columns("V3"))
MISSING_VITALS = o.comma(STAR.vitals.missing_columns)


@query("features_v4", rounded_block("feat4", f"{V3_NAMES}, {MISSING_VITALS}"))
def features_v4(plan):
    return rounded(plan.features("V4"), STAR.vitals.value_columns)


@query("stay_cohort", "SELECT * FROM staycohort")
def stay_cohort(plan):
    return plan.stay_cohort()


@query("stay_vitals_24h", rounded_block("stay_vitals", f"hadm_id, stay_id, intime, {MISSING_VITALS}"))
def stay_vitals(plan):
    return rounded(plan.stay_vitals(), STAR.vitals.value_columns)


@query("features_v5_stay", rounded_block("feat5", f"{V3_NAMES}, stay_id, intime, first_careunit, {MISSING_VITALS}"))
def features_v5(plan):
    return rounded(plan.features("V5"), STAR.vitals.value_columns)


@query("features_v5_stored", rounded_block("feat5", f"{V3_NAMES}, stay_id, intime, first_careunit, {MISSING_VITALS}"))
def features_v5_stored(plan):
    """V5 over facts stored by entity, which it does not shuffle again."""
    spark = spark_of(plan)
    name = f"facts_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch(spark)}'")
    stored = plan.stored(name, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rounded(stored.features("V5"), STAR.vitals.value_columns)


@query("features_v6_nostay", "SELECT * FROM feat6")
def features_v6(plan):
    return plan.features("V6")


@query("splits_v1_v4", " UNION ALL ".join(f"SELECT 'V{i}' AS version, hadm_id, split FROM s{i}" for i in range(1, 5)))
def splits_v1_v4(plan):
    return checks.union_all(
        [plan.split(f"V{i}").select(F.lit(f"V{i}").alias("version"), KEY, "split") for i in range(1, 5)]
    )


@query("splits_v5_v6", " UNION ALL ".join(f"SELECT 'V{i}' AS version, hadm_id, split, charlson_min FROM s{i}" for i in (5, 6)))
def splits_v5_v6(plan):
    v3 = plan.features("V3")
    labels = plan.split("V4")
    return checks.union_all(
        [
            plan.split(v, features=plan.features(v, v3), split_v4=labels).select(
                F.lit(v).alias("version"), KEY, "split", "charlson_min"
            )
            for v in ("V5", "V6")
        ]
    )


# --- model preparation -------------------------------------------------------


def train_rows(plan, version: str = "V2") -> DataFrame:
    return assemble.split_rows(plan.split(version), "train")


@query(
    "impute_median",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median FROM s2 WHERE split = 'train'" for c in NUMBERS
    ),
)
def impute_median(plan):
    rows = tables.materialize(train_rows(plan).select(*NUMBERS), scratch(spark_of(plan)))
    return rounded(prep.fit_medians(rows, NUMBERS), ["median"])


@query("impute_constant_binary", "SELECT hadm_id, " + o.comma(f"CAST(coalesce({n}, 0) AS DOUBLE) AS {n}" for n in [*o.MEDS, *o.PROCS]) + " FROM feat3")
def impute_constant_binary(plan):
    names = [*o.MEDS, *o.PROCS]
    return prep.impute(plan.features("V3"), {n: 0.0 for n in names}).select(KEY, *names)


CATEGORIES = ["lang", "source"]


@query(
    "impute_mode",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, (SELECT {c} FROM docs WHERE toxic = 0 GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode" for c in CATEGORIES
    ),
)
def impute_mode(plan):
    return prep.fit_modes(plan.tables["docs"].where("toxic = 0"), CATEGORIES)


FILLED_TRAIN = (
    "SELECT "
    + o.comma(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM s2 WHERE split = 'train')) AS {c}" for c in NUMBERS)
    + ", hadm_id, split FROM s2"
)


@query(
    "standardize",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) AS scale "
        f"FROM ({FILLED_TRAIN}) q WHERE split = 'train'"
        for c in NUMBERS
    ),
)
def standardize(plan):
    train_split = tables.materialize(train_rows(plan).select(*NUMBERS), scratch(spark_of(plan)))
    medians = {r["feature"]: r["median"] for r in prep.fit_medians(train_split, NUMBERS).collect()}
    return rounded(prep.fit_scales(prep.impute(train_split, medians), NUMBERS), ["mean", "scale"])


@query(
    "one_hot",
    "SELECT feature, value, n FROM (SELECT 'lang' AS feature, lang AS value, count(*) AS n FROM docs WHERE lang IN (SELECT lang FROM docs WHERE toxic = 0) GROUP BY lang "
    "UNION ALL SELECT 'source', source, count(*) FROM docs WHERE source IN (SELECT source FROM docs WHERE toxic = 0) GROUP BY source) q",
)
def one_hot(plan):
    docs = plan.tables["docs"]
    known = prep.fit_categories(docs.where("toxic = 0"), CATEGORIES)
    hot = prep.one_hot(docs, known, CATEGORIES)
    return hot.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "drop_all_missing",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n_observed, count({c}) > 0 AS kept FROM s6 WHERE split = 'train'"
        for c in [*NUMBERS, *o.PROCS]
    ),
)
def drop_all_missing(plan):
    names = [*NUMBERS, *o.PROCS]
    rows = tables.materialize(train_rows(plan, "V6").select(*names), scratch(spark_of(plan)))
    kept, _ = prep.drop_all_missing(rows, names)
    return prep.observed_counts(rows, names).withColumn("kept", F.col("feature").isin(kept))


def preprocessed(plan, family: str) -> DataFrame:
    split = tables.materialize(
        plan.split("V2").select(KEY, "split", *NUMBERS, *FLAGS), scratch(spark_of(plan))
    )
    chosen = feature_set(STAR, "V2", family)
    fitted = prep.fit_preprocessor(assemble.split_rows(split, "train"), chosen)
    named = [F.round(c, 5).alias(name) for c, name in zip(fitted.expressions(), fitted.numbers)]
    return split.select(KEY, "split", *named)


@query(
    "preprocess_linear",
    "SELECT q.hadm_id, q.split, "
    + o.comma(
        f"round((q.{c} - s.{c}_m) / (CASE WHEN s.{c}_s = 0 THEN 1 ELSE s.{c}_s END), 5) AS {c}" for c in NUMBERS
    )
    + ", "
    + o.comma(f"CAST(coalesce(x.{c}, 0) AS DOUBLE) AS {c}" for c in FLAGS)
    + f" FROM ({FILLED_TRAIN}) q JOIN s2 x ON x.hadm_id = q.hadm_id, (SELECT "
    + o.comma(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in NUMBERS)
    + f" FROM ({FILLED_TRAIN}) t WHERE split = 'train') s",
)
def preprocess_linear(plan):
    return preprocessed(plan, "linear")


@query(
    "preprocess_tree",
    "SELECT q.hadm_id, q.split, "
    + o.comma(f"round(q.{c}, 5) AS {c}" for c in NUMBERS)
    + ", "
    + o.comma(f"CAST(x.{c} AS DOUBLE) AS {c}" for c in FLAGS)
    + f" FROM ({FILLED_TRAIN}) q JOIN s2 x ON x.hadm_id = q.hadm_id",
)
def preprocess_tree(plan):
    return preprocessed(plan, "tree")


FIXED = {"age_at_admit": 0.02, "charlson_min": 0.5, "item1_first": -0.01, "item2_missing": 0.25}


@query(
    "score",
    "SELECT hadm_id, round(1 / (1 + exp(-(-1.5 + 0.02 * age_at_admit + 0.5 * coalesce(charlson_min, 0) - 0.01 * coalesce(item1_first, 25) + 0.25 * item2_missing))), 6) AS y_pred_proba FROM feat2",
)
def score(plan):
    filled = prep.impute(plan.features("V2"), {"charlson_min": 0.0, "item1_first": 25.0})
    return rounded(train.linear_probability(filled, FIXED, -1.5), [SCORE]).select(KEY, SCORE)


# --- evaluation --------------------------------------------------------------


@query(
    "auroc",
    "SELECT round((sum(CASE WHEN y = 1 THEN r END) - p * (p + 1) / 2.0) / (p * (t - p)), 6) AS auroc FROM (SELECT y, rank() OVER (ORDER BY y_pred_proba) + (count(*) OVER (PARTITION BY y_pred_proba) - 1) / 2.0 AS r, CAST(sum(y) OVER () AS DOUBLE) AS p, count(*) OVER () AS t FROM scored) q GROUP BY p, t",
)
def auroc(plan):
    return rounded(curves.auroc(plan.tables["scored"], SCORE, LABEL), ["auroc"])


@query("average_precision", "SELECT round(sum(pos * pr) / max(p), 6) AS auprc FROM points")
def average_precision(plan):
    return rounded(curves.average_precision(plan.tables["scored"], SCORE, LABEL), ["auprc"])


@query(
    "pr_curve",
    'SELECT score AS threshold, round(pr, 6) AS "precision", round(rc, 6) AS recall FROM points UNION ALL SELECT NULL, 1.0, 0.0',
)
def pr_curve(plan):
    return rounded(curves.pr_curve(scored_curve(plan)), ["precision", "recall"])


THRESHOLDS = (0.0, 0.1, 0.25, 0.4, 0.5)


@query(
    "threshold_report",
    o.at_thresholds("(SELECT unnest([" + o.comma(f"CAST({t} AS DOUBLE)" for t in THRESHOLDS) + "]) AS threshold)"),
)
def threshold_report(plan):
    report = curves.threshold_report(plan.tables["scored"], SCORE, LABEL, THRESHOLDS)
    return rounded(report, ["ppv", "recall", "specificity", "f1"])


@query(
    "best_f1_threshold",
    "SELECT 'step_below' AS rule, (SELECT lower_score FROM fpoints WHERE lower_score IS NOT NULL ORDER BY f1 DESC, score LIMIT 1) AS threshold "
    "UNION ALL SELECT 'clamped', (SELECT coalesce(lower_score, score) FROM fpoints ORDER BY f1 DESC, score LIMIT 1) "
    "UNION ALL SELECT 'exact', (SELECT score FROM fpoints ORDER BY f1 DESC, score LIMIT 1)",
)
def best_f1_threshold(plan):
    aligned = ("step_below", "clamped", "exact")
    return long_thresholds(scored_curve(plan), {a: curves.best_f1(a) for a in aligned})


TARGETS = (0.4, 0.5, 0.6, 1.0)


@query(
    "recall_threshold",
    " UNION ALL ".join(
        f"SELECT '{a}_{t}' AS rule, coalesce((SELECT max({c}) FROM points WHERE rc >= {t}), (SELECT min(score) FROM points)) AS threshold"
        for t in TARGETS
        for a, c in (("step_below", "lower_score"), ("exact", "score"))
    ),
)
def recall_threshold(plan):
    named = {f"{a}_{t}": curves.for_recall(t, a) for t in TARGETS for a in ("step_below", "exact")}
    return long_thresholds(scored_curve(plan), named)


def scenarios(plan) -> DataFrame:
    return curves.scenario_table(plan.tables["scored"], SCORE, LABEL)


@query("scenario_table", o.at_thresholds("chosen", "scenario, threshold"))
def scenario_table(plan):
    return rounded(scenarios(plan), ["ppv", "recall", "specificity", "f1"])


GENERIC = (
    "SELECT 'at_0_5' AS scenario, CAST(0.5 AS DOUBLE) AS threshold UNION ALL "
    "SELECT 'at_best_f1', (SELECT coalesce(lower_score, score) FROM fpoints ORDER BY f1 DESC, score LIMIT 1)"
)


@query(
    "generic_report",
    f"SELECT c.*, m.n, m.prevalence, a.auroc, m.auprc FROM ({o.at_thresholds(f'({GENERIC})', 'scenario, threshold')}) c, "
    "(SELECT CAST(max(total) AS BIGINT) AS n, round(max(p)::DOUBLE / max(total), 6) AS prevalence, round(sum(pos * pr) / max(p), 6) AS auprc FROM points) m, "
    "(SELECT round(sum((n - pos) * (tp - pos / 2.0)) / (max(p)::DOUBLE * (max(total) - max(p))), 6) AS auroc FROM points) a",
)
def generic_report(plan):
    report = curves.generic_report(plan.tables["scored"], SCORE, LABEL)
    return rounded(report, ["ppv", "recall", "specificity", "f1", "prevalence", "auroc", "auprc"])


@query(
    "score_histogram",
    "SELECT CAST(b AS INT) AS bin, coalesce(n, 0) AS n FROM range(50) r(b) LEFT JOIN (SELECT least(floor((y_pred_proba - lo) / (hi - lo) * 50), 49) AS k, count(*) AS n FROM scored, (SELECT min(y_pred_proba) AS lo, max(y_pred_proba) AS hi FROM scored) e GROUP BY 1) c ON c.k = r.b",
)
def score_histogram(plan):
    return curves.score_histogram(plan.tables["scored"], SCORE)


@query("add_prediction_columns", PREDICTED)
def add_prediction_columns(plan):
    return predicted(plan)


@query("error_groups", "SELECT hadm_id, y, yhat, error_group FROM graded")
def error_groups(plan):
    return graded(plan).select(KEY, LABEL, "yhat", "error_group")


@query(
    "error_group_counts",
    "SELECT count(*) AS n_total, round(avg(y), 6) AS label_prevalence, round(avg(yhat), 6) AS pred_positive_rate_05, "
    + o.comma(f"count(*) FILTER (error_group = '{g}') AS n_{g.lower()}" for g in errors.GROUPS)
    + ", count(DISTINCT hadm_id) AS n_unique_entity, count(DISTINCT stay_id) AS n_unique_stay, count(*) - count(DISTINCT hadm_id) AS n_duplicate_rows "
    "FROM graded JOIN stay USING (hadm_id)",
)
def error_group_counts(plan):
    # every stay of an entity repeats its row, so duplicates are counted too
    rows = graded(plan).join(plan.tables["stays"].select(KEY, "stay_id"), KEY)
    return rounded(errors.error_group_counts(rows, LABEL, "yhat"), ["label_prevalence", "pred_positive_rate_05"])


def _per_feature(columns: Sequence[str], select: str) -> str:
    return " UNION ALL ".join(
        f'SELECT error_group AS "group", \'{c}\' AS feature, {select.format(c=f"CAST({c} AS DOUBLE)")} FROM graded GROUP BY error_group' for c in columns
    )


NUMERIC_SQL = _per_feature(
    NUMBERS,
    "count({c}) AS n_nonmissing, round(avg(CAST({c} IS NULL AS INT)), 6) AS missing_rate, round(avg({c}), 6) AS mean, "
    "round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.75), 6) AS p75",
)
BINARY_SQL = _per_feature(
    FLAGS,
    "count({c}) AS n_nonmissing, round(avg(CAST({c} IS NULL AS INT)), 6) AS missing_rate, round(avg({c}), 6) AS rate_1, count(*) FILTER ({c} = 1) AS count_1",
)


@query("numeric_summary_by_group", NUMERIC_SQL)
def numeric_summary(plan):
    rows = tables.materialize(graded(plan).select("error_group", *NUMBERS), scratch(spark_of(plan)))
    return rounded(errors.numeric_summary(rows, NUMBERS), ["missing_rate", "mean", "median", "p25", "p75"])


@query("binary_rates_by_group", BINARY_SQL)
def binary_rates(plan):
    return rounded(errors.binary_rates(graded(plan), FLAGS), ["missing_rate", "rate_1"])


def _contrast_sql(source: str, measures: Sequence[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT l.feature, '{left}-{right}' AS contrast, "
        + o.comma(f"round(l.{m} - r.{m}, 4) AS diff_{m}" for m in measures)
        + f' FROM ({source}) l JOIN ({source}) r ON r.feature = l.feature AND l."group" = \'{left}\' AND r."group" = \'{right}\''
        for left, right in errors.CONTRASTS
    )


@query(
    "error_group_contrast",
    "SELECT feature, contrast, diff_mean, diff_median, CAST(NULL AS DOUBLE) AS diff_rate_1 FROM ("
    + _contrast_sql(NUMERIC_SQL, ["mean", "median"])
    + ") a UNION ALL SELECT feature, contrast, NULL, NULL, diff_rate_1 FROM ("
    + _contrast_sql(BINARY_SQL, ["rate_1"])
    + ") b",
)
def error_group_contrast(plan):
    rows = tables.materialize(
        graded(plan).select("error_group", *NUMBERS, *FLAGS), scratch(spark_of(plan))
    )
    numeric = errors.contrast(errors.numeric_summary(rows, NUMBERS), ["mean", "median"])
    binary = errors.contrast(errors.binary_rates(rows, FLAGS), ["rate_1"])
    both = numeric.unionByName(binary, allowMissingColumns=True)
    return rounded(both, ["diff_mean", "diff_median", "diff_rate_1"], 4)


MODELS = {"price": "y_pred_proba", "inverse": "1 - y_pred_proba"}
COHORTS = {"with_stay": "EXISTS", "without_stay": "NOT EXISTS"}
RUNS = " UNION ALL ".join(
    f"SELECT '{model}' AS model, '{name}' AS cohort, {expr} AS s, y FROM scored WHERE {keep} (SELECT 1 FROM stay t WHERE t.hadm_id = scored.hadm_id)"
    for model, expr in MODELS.items()
    for name, keep in COHORTS.items()
)
RUN_POINTS = (
    "SELECT *, 2 * pr * rc / (pr + rc + 1e-12) AS f1 FROM (SELECT *, tp::DOUBLE / alerts AS pr, tp::DOUBLE / p AS rc, "
    "lag(s) OVER (PARTITION BY model, cohort ORDER BY s) AS lower_s FROM (SELECT model, cohort, s, pos, n, sum(pos) OVER w AS tp, sum(n) OVER w AS alerts, "
    "sum(pos) OVER (PARTITION BY model, cohort) AS p, sum(n) OVER (PARTITION BY model, cohort) AS total "
    f"FROM (SELECT model, cohort, s, sum(y) AS pos, count(*) AS n FROM ({RUNS}) r GROUP BY 1, 2, 3) a WINDOW w AS (PARTITION BY model, cohort ORDER BY s DESC)) b) c"
)


def _run_choices() -> str:
    rules = [("F1_best", "first(lower_s ORDER BY f1 DESC, s) FILTER (lower_s IS NOT NULL)")]
    rules += [(f"Recall_{int(r * 100)}%", f"max(lower_s) FILTER (rc >= {r})") for r in (0.4, 0.5, 0.6)]
    rules += [(f"Top{k}", f"CASE WHEN max(total) <= {k} THEN 0.0 ELSE max(s) FILTER (alerts >= {k}) END") for k in (1000, 3000)]
    return " UNION ALL ".join(
        f"SELECT model, cohort, '{name}' AS scenario, {rule} AS threshold FROM pts GROUP BY model, cohort" for name, rule in rules
    )


@query(
    "model_comparison",
    f"SELECT c.model, 'V0' AS version, c.cohort, c.* EXCLUDE (model, cohort), m.n, m.prevalence, m.auroc, m.auprc FROM (WITH pts AS ({RUN_POINTS}), chosen_runs AS ({_run_choices()}) "
    + o.confusion(
        "SELECT k.model, k.cohort, scenario, threshold, sum(CASE WHEN s >= threshold THEN pos ELSE 0 END) AS tp, sum(CASE WHEN s >= threshold THEN n - pos ELSE 0 END) AS fp, "
        "sum(CASE WHEN s < threshold THEN pos ELSE 0 END) AS fn, sum(CASE WHEN s < threshold THEN n - pos ELSE 0 END) AS tn "
        "FROM chosen_runs k JOIN pts ON pts.model = k.model AND pts.cohort = k.cohort GROUP BY 1, 2, 3, 4",
        "model, cohort, scenario, threshold",
    )
    + ") c JOIN (SELECT model, cohort, CAST(max(total) AS BIGINT) AS n, round(max(p)::DOUBLE / max(total), 6) AS prevalence, "
    "round(sum((n - pos) * (tp - pos / 2.0)) / (max(p)::DOUBLE * (max(total) - max(p))), 6) AS auroc, round(sum(pos * pr) / max(p), 6) AS auprc "
    f"FROM ({RUN_POINTS}) q GROUP BY 1, 2) m ON m.model = c.model AND m.cohort = c.cohort",
)
def model_comparison(plan):
    """Two scores in two cohorts: every scenario beside the ranking metrics."""
    scored = plan.tables["scored"].select(KEY, SCORE, LABEL)
    runs = []
    for model, rows in (("price", scored), ("inverse", scored.withColumn(SCORE, 1 - F.col(SCORE)))):
        for name, has in (("with_stay", True), ("without_stay", False)):
            runs.append(((model, "V0", name), cohort.by_stay(rows, plan.tables["stays"], KEY, has_stay=has)))
    together = train.compare_models(dict(runs))
    compared = curves.scenario_comparison(together, SCORE, LABEL)
    return rounded(compared, ["ppv", "recall", "specificity", "f1", "prevalence", "auroc", "auprc"])


@query(
    "scenario_report",
    "SELECT CAST(max(total) AS BIGINT) AS n_valid, round(max(p)::DOUBLE / max(total), 6) AS prevalence_valid, "
    "round(sum((n - pos) * (tp - pos / 2.0)) / (max(p)::DOUBLE * (max(total) - max(p))), 6) AS auroc, round(sum(pos * pr) / max(p), 6) AS auprc, "
    "CAST(2 AS BIGINT) AS n_features_used, 'charlson_min,item1_first' AS features_used, CAST(6 AS BIGINT) AS n_scenarios FROM points",
)
def scenario_report(plan):
    """The record of an evaluation, from its written bundle."""
    spark, place = spark_of(plan), scratch(spark_of(plan))
    parts = reports.scenario_report(plan.tables["scored"], SCORE, LABEL, ["charlson_min", "item1_first"])
    manifest = artifacts.write_bundle(spark, parts, place)
    summary = artifacts.read_bundle(spark, place)["summary"]
    number = manifest.where("name = 'scenarios'").select(F.col("rows"))
    joined = summary.withColumn("features_used", F.array_join("features_used", ",")).withColumn("n_scenarios", number.scalar())
    return rounded(joined, ["prevalence_valid", "auroc", "auprc"])


@query(
    "error_report",
    "SELECT 'cohort_counts' AS name, CAST(1 AS BIGINT) AS rows UNION ALL SELECT 'top_false_positives', least(200, count(*) FILTER (error_group = 'FP')) FROM graded "
    "UNION ALL SELECT 'all_false_negatives', count(*) FILTER (error_group = 'FN') FROM graded "
    f"UNION ALL SELECT 'numeric_summary', count(DISTINCT error_group) * {len(NUMBERS)} FROM graded "
    f"UNION ALL SELECT 'binary_rates', count(DISTINCT error_group) * {len(FLAGS)} FROM graded "
    f"UNION ALL SELECT 'contrasts', {2 * len(NUMBERS) + 2 * len(FLAGS)}",
)
def error_report(plan):
    """The error analysis as one bundle; its manifest."""
    spark = spark_of(plan)
    rows = tables.materialize(graded(plan), scratch(spark))
    parts = reports.error_report(rows, LABEL, "yhat", SCORE, KEY, NUMBERS, FLAGS)
    return artifacts.write_bundle(spark, parts, scratch(spark)).select("name", "rows")


@query(
    "metrics_by_period",
    "SELECT y.anchor_year, CAST(y.n AS BIGINT) AS n, round(y.prevalence, 6) AS prevalence, round(y.auroc, 6) AS auroc, round(y.auprc, 6) AS auprc, y.threshold, "
    "round(sum(CASE WHEN e.y = 1 THEN 1 ELSE 0 END) / (count(*) + 1e-12), 6) AS ppv, count(*) AS alerts FROM ("
    "SELECT anchor_year, max(total) AS n, max(p)::DOUBLE / max(total) AS prevalence, sum((n - pos) * (tp - pos / 2.0)) / (max(p)::DOUBLE * (max(total) - max(p))) AS auroc, "
    "sum(pos * tp::DOUBLE / alerts) / max(p) AS auprc, CASE WHEN max(total) <= 100 THEN 0.0 ELSE max(CASE WHEN alerts >= 100 THEN s END) END AS threshold "
    "FROM (SELECT *, sum(pos) OVER (PARTITION BY anchor_year ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY anchor_year ORDER BY s DESC) AS alerts, sum(pos) OVER (PARTITION BY anchor_year) AS p, sum(n) OVER (PARTITION BY anchor_year) AS total "
    "FROM (SELECT anchor_year, y_pred_proba AS s, sum(y) AS pos, count(*) AS n FROM scored JOIN pat USING (subject_id) GROUP BY 1, 2) a) b GROUP BY anchor_year) y "
    "JOIN (SELECT * FROM scored JOIN pat USING (subject_id)) e ON e.anchor_year = y.anchor_year AND e.y_pred_proba >= y.threshold GROUP BY 1, 2, 3, 4, 5, 6",
)
def metrics_by_period(plan):
    years = plan.tables["patients"].select("subject_id", "anchor_year")
    rows = cohort.join_subject(plan.tables["scored"], years, "subject_id")
    report = curves.metrics_by_period(rows, SCORE, LABEL, "anchor_year", 100, few_periods=True)
    return rounded(report, ["prevalence", "auroc", "auprc", "ppv"])


# --- model runs ----------------------------------------------------------------


def model_query(name: str, body: str | None = None):
    """Register a query that fits on the session and folder."""

    def register(build: Query):
        QUERIES[name] = lambda spark, folder: plain(build(spark, folder))
        if body is not None:
            ORACLES[name] = o.sql(body)
        return build

    return register


def kept_place(spark: SparkSession, folder: str, name: str) -> str:
    """Where this application keeps what it made of a folder."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/fits-{application}/{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}-{name}"


def kept_model(spark: SparkSession, folder: str, name: str, fit: Callable[[], train.FittedModel]) -> train.FittedModel:
    """A model saved below the shared folder by this application, or fitted and saved there now."""
    place = kept_place(spark, folder, name)
    try:
        return artifacts.load_model(spark, place)
    except FileNotFoundError:
        model = fit()
        artifacts.save_model(spark, model, place)
        return model


def kept_split(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """The split table of a version, written once by this application; the record of its place is written last."""
    record = kept_place(spark, folder, f"{version}-split")
    try:
        place = spark.read.parquet(record).first()["path"]
    except AnalysisException:
        place = scratch(spark)
        split = tables.materialize(star_plan(spark, folder).split(version), place)
        artifacts.write_report(spark.createDataFrame([(place,)], "path string"), record, "parquet")
        return split
    return spark.read.parquet(place)


def fitted(spark: SparkSession, folder: str, version: str, family: str) -> train.FittedModel:
    """A fit on the whole split table of a version."""

    def fit() -> train.FittedModel:
        split = {version: kept_split(spark, folder, version)}
        return train.train_by_version(split, STAR, [family], written=True)[version, family]

    return kept_model(spark, folder, f"{version}-{family}", fit)


# Fits whose result has a closed form: market segments as flags, the others being the baseline.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")
SEGMENT_FLAGS = [f"is_{s.lower()}" for s in SEGMENTS]
TREE_FLAG = SEGMENT_FLAGS[0]
EXACT_LINEAR = {"regParam": 0.0, "tol": 1e-13, "maxIter": 1000}
EXACT_TREE = {"maxIter": 1, "maxDepth": 1, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}


def segment_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The V1 split with the flags of its subjects' segments."""
    plan = star_plan(spark, folder)
    people = plan.tables["patients"].select(
        "subject_id", *[(F.col("insurance") == s).cast("int").alias(c) for s, c in zip(SEGMENTS, SEGMENT_FLAGS)]
    )
    return cohort.join_subject(plan.split("V1"), people, "subject_id")


def fitted_segments(spark: SparkSession, folder: str, family: str) -> train.FittedModel:
    """All flags in an unpenalised linear model, or one split on the first flag."""

    def fit() -> train.FittedModel:
        rows = segment_rows(spark, folder)
        if family == "linear":
            return train.train_model(rows, FeatureSet("S1", family, (), tuple(SEGMENT_FLAGS)), STAR.label, params=EXACT_LINEAR)
        return train.train_model(rows, FeatureSet("S1", family, (TREE_FLAG,)), STAR.label, params=EXACT_TREE)

    return kept_model(spark, folder, f"segments-{family}", fit)


SEGMENT_ROWS = (
    "SELECT s1.hadm_id, s1.y_inhosp_death AS y, s1.split, CASE WHEN insurance IN ("
    + o.comma(f"'{s}'" for s in SEGMENTS)
    + ") THEN insurance ELSE 'OTHER' END AS g FROM s1 JOIN pat USING (subject_id)"
)
# balanced classes: the weighted share of class 1 in each segment's train rows
SEGMENT_SHARES = (
    "SELECT g, pos / (pos + neg) AS share FROM (SELECT g, sum(y) / (2.0 * max(p)) AS pos, sum(1 - y) / (2.0 * max(q)) AS neg FROM ("
    f"SELECT *, sum(y) OVER () AS p, sum(1 - y) OVER () AS q FROM ({SEGMENT_ROWS}) r WHERE split = 'train') t GROUP BY g) u"
)
# one split, labels -1 and 1, positives weighted by their rarity: what a leaf says, and its share of the weight
TREE_LEAVES = (
    "SELECT f, (pos - neg) / (pos + neg) AS leaf, (pos + neg) / sum(pos + neg) OVER () AS share FROM ("
    f"SELECT g = '{SEGMENTS[0]}' AS f, sum(y) * max(q) / max(p)::DOUBLE AS pos, sum(1 - y) AS neg FROM (SELECT *, sum(y) OVER () AS p, sum(1 - y) OVER () AS q FROM ({SEGMENT_ROWS}) r "
    "WHERE split = 'train') t GROUP BY 1) u"
)


def _metrics_sql(scored: str, family: str | None) -> str:
    """Metrics of both splits of a relation with split, y and s."""
    head = f"'S1' AS version, '{family}' AS family, " if family else ""
    return (
        f"SELECT {head}split, CAST(max(total) AS BIGINT) AS n, round(max(p)::DOUBLE / max(total), 6) AS prevalence, "
        "round(sum((n - pos) * (tp - pos / 2.0)) / (max(p)::DOUBLE * (max(total) - max(p))), 6) AS auroc, round(sum(pos * tp::DOUBLE / alerts) / max(p), 6) AS auprc FROM ("
        "SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS alerts, sum(pos) OVER (PARTITION BY split) AS p, sum(n) OVER (PARTITION BY split) AS total FROM ("
        f"SELECT split, s, sum(y) AS pos, count(*) AS n FROM ({scored}) a GROUP BY 1, 2) b WINDOW w AS (PARTITION BY split ORDER BY s DESC)) c GROUP BY split"
    )


LINEAR_SCORED = f"SELECT hadm_id, split, y, share AS s FROM ({SEGMENT_ROWS}) r JOIN ({SEGMENT_SHARES}) h USING (g)"
TREE_SCORED = f"SELECT hadm_id, split, y, 1 / (1 + exp(-2 * leaf)) AS s FROM ({SEGMENT_ROWS}) r JOIN ({TREE_LEAVES}) h ON h.f = (r.g = '{SEGMENTS[0]}')"
METRICS = ["prevalence", "auroc", "auprc"]


@model_query("train_logistic", _metrics_sql(LINEAR_SCORED, "linear"))
def train_logistic(spark, folder):
    """A fit with a closed form; V3 is ``train_logistic_v3``."""
    return rounded(train.metrics_report([fitted_segments(spark, folder, "linear")], spark), METRICS)


@model_query("train_logistic_v3")
def train_logistic_v3(spark, folder):
    return train.metrics_report([fitted(spark, folder, "V3", "linear")], spark)


@model_query("train_boosted_trees", _metrics_sql(TREE_SCORED, "tree"))
def train_boosted_trees(spark, folder):
    """One round with one split; V3 is ``train_boosted_trees_v3``."""
    return rounded(train.metrics_report([fitted_segments(spark, folder, "tree")], spark), METRICS)


@model_query("train_boosted_trees_v3")
def train_boosted_trees_v3(spark, folder):
    return train.metrics_report([fitted(spark, folder, "V3", "tree")], spark)


@model_query("train_by_version")
def train_by_version(spark, folder):
    runs = train.train_by_version(star_plan(spark, folder).written_splits(), STAR, written=True)
    return train.metrics_report(list(runs.values()), spark)


@model_query("train_metrics_report", _metrics_sql(LINEAR_SCORED, None))
def train_metrics_report(spark, folder):
    model = fitted_segments(spark, folder, "linear")
    needed = segment_rows(spark, folder).select(STAR.label, "split", *model.prep.inputs)
    return rounded(train.training_metrics(model, tables.materialize(needed, scratch(spark))), METRICS)


@model_query(
    "non_feature_columns",
    f"SELECT hadm_id, y AS y_inhosp_death, round(s, 4) AS y_pred_proba FROM ({LINEAR_SCORED}) q WHERE split = 'valid'",
)
def non_feature_columns(spark, folder):
    """Ids, times, label and split beside the inputs do not change a score."""
    model = fitted_segments(spark, folder, "linear")
    valid = assemble.split_rows(segment_rows(spark, folder), "valid")
    return rounded(model.score(valid).select(KEY, STAR.label, train.PREDICTION), [train.PREDICTION], 4)


@model_query("save_load_model", "SELECT split, count(*) AS n, 0 AS n_different FROM s1 GROUP BY split")
def save_load_model(spark, folder):
    """Rows whose score differs after saving and loading: none."""
    model = fitted(spark, folder, "V1", "linear")
    place = scratch(spark)
    artifacts.save_model(spark, model, place)
    rows = star_plan(spark, folder).split("V1")
    before = model.score(rows).select(KEY, "split", F.col(train.PREDICTION).alias("_before"))
    after = artifacts.load_model(spark, place).score(rows).select(KEY, train.PREDICTION)
    different = F.when(F.col("_before").eqNullSafe(F.col(train.PREDICTION)), 0).otherwise(1)
    return before.join(after, KEY).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(different).cast("int").alias("n_different")
    )


def _logit(share: str) -> str:
    return f"ln({share} / (1 - {share}))"


COEFFICIENTS = (
    f"SELECT 'is_' || lower(c.g) AS feature, 'bin' AS type, {_logit('c.share')} - {_logit('b.share')} AS coef FROM ({SEGMENT_SHARES}) c, "
    f"({SEGMENT_SHARES}) b WHERE b.g = 'OTHER' AND c.g <> 'OTHER'"
)
COEFFICIENT_ROWS = f"SELECT feature, type, round(coef, 4) AS coef, round(exp(coef), 4) AS odds_ratio, round(abs(coef), 4) AS abs_coef FROM ({COEFFICIENTS}) k"
COEFFICIENT_NUMBERS = ["coef", "odds_ratio", "abs_coef"]


@model_query("coefficients", COEFFICIENT_ROWS)
def coefficients(spark, folder):
    return rounded(train.coefficients(fitted_segments(spark, folder, "linear"), spark), COEFFICIENT_NUMBERS, 4)


@model_query("coefficients_v3")
def coefficients_v3(spark, folder):
    return train.coefficients(fitted(spark, folder, "V3", "linear"), spark)


@model_query(
    "coefficient_summary",
    f"SELECT 'S1' AS version, round({_logit('share')}, 4) AS intercept, round(share / (1 - share), 4) AS odds_at_zero, CAST({len(SEGMENTS)} AS BIGINT) AS n_total_features, "
    f"CAST(0 AS BIGINT) AS n_continuous, CAST({len(SEGMENTS)} AS BIGINT) AS n_binary, CAST(0 AS BIGINT) AS n_categories, "
    f"(SELECT feature FROM ({COEFFICIENTS}) k ORDER BY abs(coef) DESC LIMIT 1) AS largest FROM ({SEGMENT_SHARES}) h WHERE g = 'OTHER'",
)
def coefficient_summary(spark, folder):
    """Intercept, number of inputs by kind and the largest coefficient, from a written bundle."""
    parts = reports.coefficient_report([fitted_segments(spark, folder, "linear")], spark)
    place = scratch(spark)
    artifacts.write_bundle(spark, parts, place)
    summary = artifacts.read_bundle(spark, place)["summary"]
    named = summary.withColumn("largest", F.col("top_features")[0]["feature"]).drop("top_features")
    return rounded(named, ["intercept", "odds_at_zero"], 4)


@model_query("topn_by_abs", f"SELECT * FROM ({COEFFICIENT_ROWS}) t ORDER BY abs_coef DESC, feature LIMIT 3")
def topn_by_abs(spark, folder):
    table = train.coefficients(fitted_segments(spark, folder, "linear"), spark)
    return rounded(train.top_by(table, "abs_coef", "feature", 3), COEFFICIENT_NUMBERS, 4)


def _valid_v3(spark, folder) -> DataFrame:
    return assemble.split_rows(star_plan(spark, folder).split("V3"), "valid")


@model_query(
    "seeded_sample",
    "SELECT hadm_id, split, age_at_admit FROM s3 WHERE split = 'valid' ORDER BY md5('42:' || hadm_id), hadm_id LIMIT 2000",
)
def seeded_sample(spark, folder):
    return attributions.seeded_sample(_valid_v3(spark, folder), KEY).select(KEY, "split", "age_at_admit")


V1_INPUTS = feature_set(STAR, "V1", "linear").columns


@model_query(
    "assert_vectors_finite",
    "SELECT " + o.comma(f"CAST(count(*) - count({c}) AS {'DOUBLE' if c in MAY_BE_NULL else 'BIGINT'}) AS {c}" for c in V1_INPUTS) + " FROM s1",
)
def assert_vectors_finite(spark, folder):
    """The gate lets the preprocessed inputs pass and stops the raw ones, whose nulls are returned."""
    rows = tables.materialize(star_plan(spark, folder).split("V1"), scratch(spark))
    fitted_prep = prep.fit_preprocessor(assemble.split_rows(rows, "train"), feature_set(STAR, "V1", "linear"))
    checks.assert_vectors_finite(fitted_prep.apply(rows), fitted_prep.number_columns, rows, V1_INPUTS)
    counts = checks.nonfinite_counts(rows, V1_INPUTS)
    if any(counts.first()):
        try:
            checks.assert_vectors_finite(rows, V1_INPUTS, rows, V1_INPUTS)
        except checks.QualityError:
            return counts
        raise AssertionError("the gate let nulls pass")
    return counts


TREE_VALUES = f"SELECT *, sum(leaf * share) OVER () AS mean FROM ({TREE_LEAVES}) l"


@model_query(
    "attributions",
    f"SELECT hadm_id, '{TREE_FLAG}' AS feature, round(2 * (leaf - mean), 6) AS contribution FROM ({SEGMENT_ROWS}) r JOIN ({TREE_VALUES}) h ON h.f = (r.g = '{SEGMENTS[0]}') "
    f"WHERE split = 'valid' UNION ALL SELECT hadm_id, '<bias>', round(2 * mean, 6) FROM ({SEGMENT_ROWS}) r, (SELECT max(mean) AS mean FROM ({TREE_VALUES}) v) h WHERE split = 'valid'",
)
def attribution_rows(spark, folder):
    """Shapley values of one split; V3 is ``attributions_v3``."""
    model = fitted_segments(spark, folder, "tree")
    valid = assemble.split_rows(segment_rows(spark, folder), "valid")
    return rounded(attributions.attributions(model, valid, KEY, scratch(spark)), ["contribution"])


@model_query(
    "attribution_ranking",
    f"SELECT '{TREE_FLAG}' AS feature, round(avg(abs(2 * (leaf - mean))), 6) AS mean_abs_contribution FROM ({SEGMENT_ROWS}) r "
    f"JOIN ({TREE_VALUES}) h ON h.f = (r.g = '{SEGMENTS[0]}') WHERE split = 'valid'",
)
def attribution_ranking(spark, folder):
    model = fitted_segments(spark, folder, "tree")
    valid = assemble.split_rows(segment_rows(spark, folder), "valid")
    ranking = attributions.attribution_ranking(attributions.attributions(model, valid, KEY, scratch(spark)))
    return rounded(ranking, ["mean_abs_contribution"])


def _contributions(spark, folder) -> DataFrame:
    model = fitted(spark, folder, "V3", "tree")
    valid = assemble.split_rows(kept_split(spark, folder, "V3"), "valid")
    return attributions.attributions(model, valid, KEY, scratch(spark))


@model_query("attributions_v3")
def attribution_rows_v3(spark, folder):
    return _contributions(spark, folder)


@model_query("attribution_ranking_v3")
def attribution_ranking_v3(spark, folder):
    return attributions.attribution_ranking(_contributions(spark, folder))
