"""SQL of the star preset for an independent engine: shared building blocks.

``sql(body)`` puts every named block that ``body`` needs in front of it.
"""

from __future__ import annotations

import re

from tidemark.plans.star import STAR

ITEMS = range(1, 8)
VITALS = list(STAR.vitals.bounds)
LABS = [f"item{i}" for i in ITEMS]
MEDS = {rule.name: rule.pattern for rule in STAR.medications}
PROCS = {rule.name: rule.pattern for rule in STAR.procedures}
COMORBIDITY = [rule.name for rule in STAR.comorbidity]
CHRONIC = [rule.name for rule in STAR.chronic]

STAY_ID = "((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber"


def comma(parts) -> str:
    return ", ".join(parts)


def _vital_pivot(kind: str) -> str:
    source = {"first": "CASE WHEN vital_name='{v}' AND rn=1 THEN vital_value END"}.get(
        kind, "CASE WHEN vital_name='{v}' THEN vital_value END"
    )
    fn = "min" if kind == "min" else "max"
    return comma(f"{fn}({source.format(v=v)}) AS {v}_{kind}" for v in VITALS)


def _cleaned(source: str, names: str) -> str:
    """Vitals cleaning on a source with itemid, valuenum and other columns."""
    return f"""
SELECT * FROM (
  SELECT *, CASE WHEN raw IN ('temp_c','temp_f') THEN 'temp' ELSE raw END AS vital_name,
         CASE WHEN raw='temp_f' THEN (valuenum-32.0)*5.0/9.0 ELSE valuenum END AS vital_value
  FROM (SELECT *, {names} AS raw FROM {source} WHERE valuenum IS NOT NULL) r WHERE raw IS NOT NULL) c
WHERE (vital_name='hr' AND vital_value BETWEEN 20 AND 300) OR (vital_name='rr' AND vital_value BETWEEN 2 AND 80)
   OR (vital_name='sbp' AND vital_value BETWEEN 30 AND 300) OR (vital_name='dbp' AND vital_value BETWEEN 10 AND 200)
   OR (vital_name='spo2' AND vital_value BETWEEN 30 AND 100) OR (vital_name='temp' AND vital_value BETWEEN 25 AND 45)"""


LINE_NAMES = (
    "CASE itemid WHEN 1 THEN 'hr' WHEN 2 THEN 'rr' WHEN 3 THEN 'sbp' WHEN 4 THEN 'sbp' WHEN 5 THEN 'dbp' "
    "WHEN 6 THEN 'temp_f' WHEN 7 THEN 'temp_c' END"
)
EVENT_NAMES = (
    "CASE itemid WHEN 'click' THEN 'hr' WHEN 'view' THEN 'rr' WHEN 'purchase' THEN 'sbp' "
    "WHEN 'error' THEN 'temp_f' WHEN 'signup' THEN 'temp_c' END"
)

_V9, _V10 = "icd_version=9", "icd_version=10"


def _like(*prefixes: str) -> str:
    return "(" + " OR ".join(f"icd_code LIKE '{p}%'" for p in prefixes) + ")"


# fixed values: code prefixes of the comorbidity and chronic groups
CODE_TESTS = {
    "chf": (_like("428"), _like("I50")),
    "renal": ("icd_code BETWEEN '585' AND '5859'", _like("N18")),
    "dm": (_like("250"), _like("E1")),
    "copd": (_like("491", "492", "496"), _like("J44", "J43")),
    "chronic_liver": (_like("571"), _like("K70", "K74")),
    "malignancy": ("icd_code BETWEEN '140' AND '239'", _like("C", "D0")),
    "cerebrovascular": (_like("433", "434", "435", "436"), _like("I63", "I64", "G45")),
    "hypertension": (_like("401"), _like("I10")),
    "cad": (_like("410", "411", "414"), _like("I21", "I22", "I25")),
}


def code_flag(name: str, strict: bool) -> str:
    old, new = CODE_TESTS[name]
    other = _V10 if strict else "icd_version IS DISTINCT FROM 9"
    return f"CASE WHEN ({_V9} AND {old}) OR ({other} AND {new}) THEN 1 ELSE 0 END"


def _firsts(items) -> str:
    return comma(f"max(CASE WHEN itemid={i} THEN valuenum END) AS item{i}_first" for i in items)


def _missing(stems) -> str:
    return comma(f"CAST({s}_first IS NULL AS INT) AS {s}_missing" for s in stems)


HEAD = "b.hadm_id, b.subject_id, b.admittime, b.y_inhosp_death, b.age_at_admit"
V1_COLUMNS = comma(f"item{i}_first" for i in range(1, 5)) + ", charlson_min"
V2_COLUMNS = comma(f"{s}_first" for s in LABS) + ", " + _missing(LABS) + ", charlson_min"
V3_FLAGS = comma([*MEDS, *PROCS, *CHRONIC])
VITAL_VALUES = comma(f"{v}_{k}" for v in VITALS for k in ("first", "min", "max"))

BLOCKS = {
    "pat": "SELECT c_custkey AS subject_id, CAST(10 + c_custkey % 70 AS INT) AS anchor_age, CAST(1990 + c_nationkey AS INT) AS anchor_year, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, c_mktsegment AS insurance FROM customer",
    "adm": "SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, o_orderdate AS admittime, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS hospital_expire_flag, o_orderstatus AS admission_type FROM orders",
    "lab": "SELECT l_orderkey AS hadm_id, l_linenumber AS itemid, CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity END AS valuenum, l_shipdate AS charttime FROM lineitem",
    "dx": "SELECT l_orderkey AS hadm_id, CASE WHEN l_linestatus = 'F' THEN 9 ELSE 10 END AS icd_version, CASE WHEN l_linestatus = 'F' THEN lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') ELSE concat(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(l_partkey % 26 + 1 AS INT), 1), lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0')) END AS icd_code FROM lineitem",
    "rx": "SELECT l_orderkey AS hadm_id, p_name AS drug, l_shipdate AS starttime FROM lineitem JOIN part ON p_partkey = l_partkey",
    "stay": f"SELECT l_orderkey AS hadm_id, {STAY_ID} AS stay_id, l_shipdate AS intime, l_linestatus AS first_careunit FROM lineitem WHERE l_returnflag = 'R'",
    "procev": f"SELECT l_orderkey AS hadm_id, {STAY_ID} AS stay_id, l_partkey AS itemid, l_shipdate AS starttime FROM lineitem WHERE l_returnflag = 'R'",
    "d_items": "SELECT p_partkey AS itemid, p_name AS label FROM part",
    "chart": "SELECT user_id AS subject_id, event_type AS itemid, value AS valuenum, ts AS charttime FROM events",
    "chart_li": "SELECT l_orderkey AS hadm_id, o_custkey AS subject_id, l_linenumber AS itemid, l_quantity AS valuenum, l_shipdate AS charttime FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "chart_adm": "SELECT user_id AS hadm_id, user_id AS subject_id, MIN(ts) AS admittime FROM events GROUP BY user_id",
    "scored": "SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS y, CAST(floor(o_totalprice / 1000) / 1000.0 AS DOUBLE) AS y_pred_proba FROM orders",
    "docs": "SELECT d.doc_id AS hadm_id, l.quality AS y, l.toxic, d.n_chars, d.lang, d.source FROM documents d JOIN labels l ON l.doc_id = d.doc_id",
    # cohort and event features
    "base": "SELECT * FROM (SELECT hadm_id, subject_id, admittime, CASE WHEN hospital_expire_flag = 1 THEN 1 ELSE 0 END AS y_inhosp_death, CAST(round(anchor_age + year(admittime) - anchor_year, 1) AS DOUBLE) AS age_at_admit, gender, admission_type, insurance, anchor_year FROM adm JOIN pat USING (subject_id)) q WHERE age_at_admit >= 18",
    "labwin": "SELECT l.* FROM adm a JOIN lab l ON l.hadm_id = a.hadm_id AND l.charttime >= a.admittime AND l.charttime < a.admittime + INTERVAL 365 DAY WHERE l.valuenum IS NOT NULL AND l.itemid BETWEEN 1 AND 7",
    "labfirst": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id, itemid ORDER BY charttime, valuenum) AS rn FROM labwin) q WHERE rn = 1",
    "labs_core": f"SELECT hadm_id, {_firsts(range(1, 5))} FROM labfirst WHERE itemid <= 4 GROUP BY hadm_id",
    "labs_ext": f"SELECT hadm_id, {_firsts(ITEMS)} FROM labfirst GROUP BY hadm_id",
    "comorb": "SELECT *, CAST(chf + renal * 2 + dm AS DOUBLE) AS charlson_min FROM (SELECT hadm_id, "
    + comma(f"max({code_flag(n, True)}) AS {n}" for n in COMORBIDITY)
    + " FROM dx WHERE hadm_id IS NOT NULL GROUP BY hadm_id) q",
    "chronic": "SELECT hadm_id, " + comma(f"CAST(max({code_flag(n, False)}) AS DOUBLE) AS {n}" for n in CHRONIC) + " FROM dx GROUP BY hadm_id",
    "rxwin": "SELECT r.* FROM adm a JOIN rx r ON r.hadm_id = a.hadm_id AND r.starttime >= a.admittime AND r.starttime < a.admittime + INTERVAL 365 DAY",
    "meds": "SELECT hadm_id, "
    + comma(f"max(CAST(regexp_matches(lower(coalesce(drug, '')), '({p})') AS DOUBLE)) AS {n}" for n, p in MEDS.items())
    + " FROM rxwin GROUP BY hadm_id",
    "procwin": "SELECT a.hadm_id, s.stay_id, p.starttime, p.itemid, d.label FROM adm a JOIN stay s ON s.hadm_id = a.hadm_id JOIN procev p ON p.stay_id = s.stay_id JOIN d_items d ON d.itemid = p.itemid WHERE p.starttime >= a.admittime AND p.starttime < a.admittime + INTERVAL 365 DAY",
    "procs": "SELECT hadm_id, "
    + comma(f"max(CAST(regexp_matches(lower(label), '({p})') AS DOUBLE)) AS {n}" for n, p in PROCS.items())
    + " FROM procwin GROUP BY hadm_id",
    "vitwin": "SELECT c.* FROM base b JOIN chart_li c ON c.hadm_id = b.hadm_id AND c.subject_id = b.subject_id WHERE c.charttime >= b.admittime AND c.charttime < b.admittime + INTERVAL 365 DAY",
    "vitclean": _cleaned("vitwin", LINE_NAMES),
    "vitrank": "SELECT *, row_number() OVER (PARTITION BY hadm_id, vital_name ORDER BY charttime, vital_value) AS rn FROM vitclean",
    "vitals": f"SELECT b.hadm_id, {VITAL_VALUES} FROM base b LEFT JOIN (SELECT hadm_id, {_vital_pivot('first')}, {_vital_pivot('min')}, {_vital_pivot('max')} FROM vitrank GROUP BY hadm_id) v USING (hadm_id)",
    "eventwin": "SELECT a.hadm_id, c.* FROM chart_adm a JOIN chart c ON c.subject_id = a.subject_id WHERE c.charttime >= a.admittime AND c.charttime < a.admittime + INTERVAL 24 HOUR",
    "eventclean": _cleaned("eventwin", EVENT_NAMES),
    "allclean": _cleaned("chart", EVENT_NAMES),
    # stays
    "stay1": "SELECT hadm_id, stay_id, intime, first_careunit FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY intime, stay_id) AS rn FROM stay WHERE hadm_id IS NOT NULL AND stay_id IS NOT NULL AND intime IS NOT NULL) q WHERE rn = 1",
    "staywin": "SELECT s.stay_id, c.* FROM stay1 s JOIN base b ON b.hadm_id = s.hadm_id JOIN chart_li c ON c.hadm_id = s.hadm_id WHERE c.charttime >= s.intime AND c.charttime < s.intime + INTERVAL 365 DAY",
    "stayclean": _cleaned("staywin", LINE_NAMES),
    "stayrank": "SELECT *, row_number() OVER (PARTITION BY hadm_id, stay_id, vital_name ORDER BY charttime, vital_value) AS rn FROM stayclean",
    "stay_vitals": f"SELECT s.hadm_id, s.stay_id, s.intime, {VITAL_VALUES}, {_missing(VITALS)} FROM stay1 s JOIN base b ON b.hadm_id = s.hadm_id LEFT JOIN (SELECT hadm_id, stay_id, {_vital_pivot('first')}, {_vital_pivot('min')}, {_vital_pivot('max')} FROM stayrank GROUP BY hadm_id, stay_id) v ON v.hadm_id = s.hadm_id AND v.stay_id = s.stay_id",
    # assembled versions and splits
    "feat1": f"SELECT {HEAD}, {V1_COLUMNS} FROM base b LEFT JOIN labs_core USING (hadm_id) LEFT JOIN comorb USING (hadm_id)",
    "feat2": f"SELECT {HEAD}, {V2_COLUMNS} FROM base b LEFT JOIN labs_ext USING (hadm_id) LEFT JOIN comorb USING (hadm_id)",
    "feat3": f"SELECT {HEAD}, {V2_COLUMNS}, {V3_FLAGS} FROM base b LEFT JOIN labs_ext USING (hadm_id) LEFT JOIN comorb USING (hadm_id) LEFT JOIN meds USING (hadm_id) LEFT JOIN procs USING (hadm_id) LEFT JOIN chronic USING (hadm_id)",
    "feat4": f"SELECT feat3.*, {VITAL_VALUES}, {_missing(VITALS)} FROM feat3 LEFT JOIN vitals USING (hadm_id)",
    "staycohort": "SELECT feat3.*, s.stay_id, s.intime, s.first_careunit FROM feat3 JOIN stay1 s ON s.hadm_id = feat3.hadm_id",
    "feat5": "SELECT c.*, "
    + comma(f"v.{v}_{k}" for v in VITALS for k in ("first", "min", "max", "missing"))
    + " FROM staycohort c LEFT JOIN stay_vitals v ON v.stay_id = c.stay_id AND v.hadm_id = c.hadm_id",
    "feat6": "SELECT * FROM feat3 WHERE NOT EXISTS (SELECT 1 FROM stay s WHERE s.hadm_id = feat3.hadm_id)",
    **{
        f"s{i}": f"SELECT feat{i}.*, CASE WHEN p.anchor_year < 2003 THEN 'train' ELSE 'valid' END AS split FROM feat{i} JOIN pat p ON p.subject_id = feat{i}.subject_id"
        for i in range(1, 5)
    },
    **{f"s{i}": f"SELECT feat{i}.*, s4.split FROM feat{i} JOIN s4 ON s4.hadm_id = feat{i}.hadm_id" for i in (5, 6)},
    # curves over the scored rows: points in ascending score order
    "counts": "SELECT y_pred_proba AS score, sum(y) AS pos, count(*) AS n FROM scored GROUP BY 1",
    "points": "SELECT *, tp::DOUBLE / alerts AS pr, CASE WHEN p > 0 THEN tp::DOUBLE / p ELSE 1.0 END AS rc, lag(score) OVER (ORDER BY score) AS lower_score FROM (SELECT score, pos, n, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS alerts, sum(pos) OVER () AS p, sum(n) OVER () AS total FROM counts) q",
    "fpoints": "SELECT *, 2 * pr * rc / (pr + rc + 1e-12) AS f1 FROM points",
    "chosen": "SELECT 'F1_best' AS scenario, (SELECT lower_score FROM fpoints WHERE lower_score IS NOT NULL ORDER BY f1 DESC, score LIMIT 1) AS threshold"
    + "".join(
        f" UNION ALL SELECT 'Recall_{int(r * 100)}%', (SELECT max(lower_score) FROM fpoints WHERE rc >= {r})"
        for r in (0.4, 0.5, 0.6)
    )
    + "".join(
        f" UNION ALL SELECT 'Top{k}', CASE WHEN (SELECT max(total) FROM points) <= {k} THEN 0.0 ELSE (SELECT max(score) FROM points WHERE alerts >= {k}) END"
        for k in (1000, 3000)
    ),
    # graded rows: predicted positive at 0.25, with the V2 features
    "graded": "SELECT *, CASE WHEN y = 1 AND yhat = 1 THEN 'TP' WHEN y = 0 AND yhat = 1 THEN 'FP' WHEN y = 1 AND yhat = 0 THEN 'FN' ELSE 'TN' END AS error_group FROM (SELECT feat2.*, s.y, s.y_pred_proba, CAST(s.y_pred_proba >= 0.25 AS INT) AS yhat FROM feat2 JOIN scored s ON s.hadm_id = feat2.hadm_id) q",
}

RATES = (
    "tp / (tp + fp + 1e-12) AS ppv_, tp / (tp + fn + 1e-12) AS recall_, tn / (tn + fp + 1e-12) AS specificity_"
)


def confusion(source: str, keys: str) -> str:
    """Rates from a relation with keys, tp, fp, fn, tn."""
    return (
        f"SELECT {keys}, round(ppv_, 6) AS ppv, round(recall_, 6) AS recall, round(specificity_, 6) AS specificity, "
        "round(2 * ppv_ * recall_ / (ppv_ + recall_ + 1e-12), 6) AS f1, CAST(tp + fp AS BIGINT) AS alerts, "
        "CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp "
        f"FROM (SELECT *, {RATES} FROM ({source}) c) r"
    )


def at_thresholds(thresholds: str, keys: str = "threshold") -> str:
    """Confusion counts of the scored rows at each row of ``thresholds``."""
    return confusion(
        f"SELECT {keys}, count(*) FILTER (y = 1 AND y_pred_proba >= threshold) AS tp, "
        "count(*) FILTER (y = 0 AND y_pred_proba >= threshold) AS fp, "
        "count(*) FILTER (y = 1 AND y_pred_proba < threshold) AS fn, "
        "count(*) FILTER (y = 0 AND y_pred_proba < threshold) AS tn "
        f"FROM {thresholds} t, scored GROUP BY {keys}",
        keys,
    )


def sql(body: str) -> str:
    """``body`` preceded by all blocks it uses, directly or through others."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            if word in BLOCKS and word not in needed:
                visit(BLOCKS[word])
                if word not in needed:
                    needed.append(word)

    visit(body)
    blocks = ",\n".join(f"{name} AS ({BLOCKS[name]})" for name in needed)
    return f"WITH {blocks}\n{body}" if needed else body
