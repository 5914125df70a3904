"""Preset for hospital admissions: items, codes, words and ranges as data."""

from __future__ import annotations

from datetime import timedelta

from tidemark.specs import CodeRule, Codes, Panel, Study, TextRule, Vitals

# --- fixed values: they define the results and must not be changed -----------

CORE_LABS = {
    50983: "sodium_24h",
    50971: "potassium_24h",
    50912: "creatinine_24h",
    50813: "lactate_24h",
}

EXTENDED_LABS = {
    **CORE_LABS,
    50931: "glucose_24h",
    51006: "bun_24h",
    50902: "chloride_24h",
    50882: "bicarbonate_24h",
    50893: "calcium_24h",
    50960: "magnesium_24h",
    50970: "phosphate_24h",
    51301: "wbc_24h",
    51222: "hemoglobin_24h",
    51265: "platelets_24h",
}

CHARTED_ITEMS = {
    220045: "hr",
    220210: "rr",
    220050: "sbp",
    220179: "sbp",
    220051: "dbp",
    220180: "dbp",
    220277: "spo2",
    223762: "temp_c",
    223761: "temp_f",
}

PLAUSIBLE = {
    "hr": (20, 300),
    "rr": (2, 80),
    "sbp": (30, 300),
    "dbp": (10, 200),
    "spo2": (30, 100),
    "temp": (25, 45),
}

COMORBIDITY = (
    CodeRule("chf", {9: Codes(["428"]), 10: Codes(["I50"])}),
    CodeRule("renal", {9: Codes(ranges=[("585", "5859")]), 10: Codes(["N18"])}),
    CodeRule("dm", {9: Codes(["250"]), 10: Codes(["E1"])}),
)

COMORBIDITY_WEIGHTS = {"chf": 1, "renal": 2, "dm": 1}

CHRONIC = (
    CodeRule("copd", {9: Codes(["491", "492", "496"]), 10: Codes(["J44", "J43"])}),
    CodeRule("chronic_liver", {9: Codes(["571"]), 10: Codes(["K70", "K74"])}),
    CodeRule("malignancy", {9: Codes(ranges=[("140", "239")]), 10: Codes(["C", "D0"])}),
    CodeRule("cerebrovascular", {9: Codes(["433", "434", "435", "436"]), 10: Codes(["I63", "I64", "G45"])}),
    CodeRule("hypertension", {9: Codes(["401"]), 10: Codes(["I10"])}),
    CodeRule("cad", {9: Codes(["410", "411", "414"]), 10: Codes(["I21", "I22", "I25"])}),
)

MEDICATIONS = (
    TextRule(
        "vasopressor_24h", "norepi|norepinephrine|epinephrine|vasopressin|dopamine|phenylephrine|levophed"
    ),
    TextRule(
        "antibiotic_24h",
        "vancomycin|piperacillin|tazobactam|meropenem|cefepime|ceftriaxone|zosyn|levofloxacin"
        "|ciprofloxacin|linezolid|metronidazole",
    ),
    TextRule("insulin_24h", "insulin"),
    TextRule("diuretic_24h", "furosemide|lasix|bumetanide|torsemide|hydrochlorothiazide"),
    TextRule(
        "anticoag_antiplatelet_24h",
        "heparin|enoxaparin|warfarin|apixaban|rivaroxaban|clopidogrel|aspirin",
    ),
    TextRule("sedative_analgesic_24h", "propofol|midazolam|fentanyl|dexmedetomidine"),
)

PROCEDURES = (
    TextRule("airway_intubation_24h", "intubat|endotrache|tracheostom"),
    TextRule("central_line_24h", "central.*line|cvc|central venous|subclavian|internal jugular|ij line"),
    TextRule("arterial_line_24h", "arterial.*line|a[- ]?line"),
    TextRule("dialysis_24h", "dialysis|hemodialysis|cvvh|cvvhd|cvvhdf|crrt"),
    TextRule("chest_tube_24h", "chest.*tube|thoracostom"),
)

NOT_IN_V5_V6 = ("insulin_24h", "diuretic_24h", "anticoag_antiplatelet_24h")

# --- end of fixed values -----------------------------------------------------

CLINICAL = Study(
    core=Panel(CORE_LABS),
    extended=Panel(EXTENDED_LABS),
    comorbidity=COMORBIDITY,
    weights=COMORBIDITY_WEIGHTS,
    chronic=CHRONIC,
    medications=MEDICATIONS,
    procedures=PROCEDURES,
    vitals=Vitals(CHARTED_ITEMS, PLAUSIBLE),
    window=timedelta(hours=24),
    split_cut=2150,
    demographics=("gender", "admission_type", "admission_location", "insurance", "race", "language"),
    stay_columns=("outtime", "first_careunit", "last_careunit"),
    left_out={
        ("V4", "tree"): ("bicarbonate_24h_missing",),
        ("V5", "linear"): ("bicarbonate_24h_missing", *NOT_IN_V5_V6),
        ("V5", "tree"): ("bicarbonate_24h_missing", *NOT_IN_V5_V6),
        ("V6", "linear"): NOT_IN_V5_V6,
        ("V6", "tree"): NOT_IN_V5_V6,
    },
)

# Table roles -> file names of the usual export.
CLINICAL_FILES = {
    "admissions": "admissions",
    "patients": "patients",
    "labs": "labevents",
    "diagnoses": "diagnoses_icd",
    "prescriptions": "prescriptions",
    "stays": "icustays",
    "procedures": "procedureevents",
    "items": "d_items",
    "vitals": "chartevents_vitals_subset",
}
