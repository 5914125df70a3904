"""The versioned feature tables of a study, as lazy Spark plans."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import assemble, cohort, events, flags
from tidemark.operators.cohort import by_stay, cohort_base, with_first_stay
from tidemark.operators.gates import CheckedTable, write_checked
from tidemark.session import shared_folder
from tidemark.sources.tables import materialize_bucketed
from tidemark.specs import VERSIONS, Study


class FeaturePlan:
    """Feature tables V1 to V6 and their splits over one set of tables.

    ``tables`` holds ``admissions, patients, labs, diagnoses, prescriptions,
    stays, procedures, items, vitals`` and optionally ``drug_items`` (the
    dictionary of coded prescriptions).  Nothing runs until a result is used,
    except with ``prune_scan``: it bounds the event scans by the cohort's times,
    which costs a small job for each.
    """

    def __init__(self, study: Study, tables: Mapping[str, DataFrame], prune_scan: bool = False):
        self.study = study
        self.tables = tables
        self.options = {"prune_scan": True} if prune_scan else {}

    # --- sources of features -------------------------------------------------

    @cached_property
    def base(self) -> DataFrame:
        return cohort_base(self.tables["admissions"], self.tables["patients"], self.study)

    @cached_property
    def _anchors(self) -> DataFrame:
        """Cohort keys with their anchor; subjects that fail the age rule are
        not worth joining events for, as assembly starts from the cohort."""
        s = self.study
        return self.base.select(s.entity, s.anchor)

    def _all_anchors(self) -> DataFrame:
        s = self.study
        return self.tables["admissions"].select(s.entity, s.anchor)

    def labs(self, panel: str = "extended", everyone: bool = True) -> DataFrame:
        """First lab values, for all entities or for the cohort only."""
        s = self.study
        chosen = s.core if panel == "core" else s.extended
        anchors = self._all_anchors() if everyone else self._anchors
        return events.panel_first(anchors, self.tables["labs"], chosen, [s.entity], s.anchor, s.window, **self.options)

    def comorbidity(self) -> DataFrame:
        s = self.study
        return flags.comorbidity_flags(self.tables["diagnoses"], s.entity, s.comorbidity, s.weights, s.score)

    def chronic(self) -> DataFrame:
        return flags.chronic_groups(self.tables["diagnoses"], self.study.entity, self.study.chronic)

    def medications(self, everyone: bool = True) -> DataFrame:
        s = self.study
        anchors = self._all_anchors() if everyone else self._anchors
        if (flagged := self.tables.get("flagged_prescriptions")) is not None:
            return flags.window_flags(anchors, flagged, s.entity, s.anchor, s.window, s.medications, **self.options)
        return flags.medication_flags(
            anchors,
            self.tables["prescriptions"],
            s.entity,
            s.anchor,
            s.window,
            s.medications,
            self.tables.get("drug_items"),
            **self.options,
        )

    def procedures(self, everyone: bool = True) -> DataFrame:
        s = self.study
        anchors = self._all_anchors() if everyone else self._anchors
        if (flagged := self.tables.get("flagged_procedures")) is not None:
            return flags.window_flags(anchors, flagged, s.entity, s.anchor, s.window, s.procedures, **self.options)
        return flags.procedure_flags(
            anchors,
            self.tables["stays"],
            self.tables["procedures"],
            self.tables["items"],
            s.entity,
            s.anchor,
            s.window,
            s.procedures,
            **self.options,
        )

    def _vitals_inside(self) -> DataFrame:
        s = self.study
        anchors = self.base.select(s.entity, s.subject, s.anchor)
        return events.vital_summary(
            anchors, self.tables["vitals"], s.vitals, [s.entity], s.anchor, s.window, same=[s.subject], **self.options
        )

    def vitals(self) -> DataFrame:
        """Vital summaries after the entity's anchor; every cohort entity has a row."""
        entity = self.study.entity
        return assemble.left_assemble(self.base.select(entity), [self._vitals_inside()], [entity])

    def stay_vitals(self) -> DataFrame:
        """Vital summaries after the start of each entity's first stay."""
        s = self.study
        first = cohort.first_stay(self.tables["stays"].select(s.entity, "stay_id", "intime"), s.entity)
        anchored = first.join(self.base.select(s.entity, s.subject), s.entity)
        wanted = events.clean_vitals(self.tables["vitals"], s.vitals).select(
            s.entity, s.subject, "vital_name", "vital_value", "charttime"
        )
        inside = events.event_window(
            anchored, wanted, [s.entity], "intime", "charttime", s.window,
            carry=["stay_id"], same=[s.subject], **self.options,
        )
        summary = events.summarize_vitals(inside, [s.entity, "stay_id"], s.vitals)
        # one stay an entity: joined by the entity alone, by which facts may be stored
        every = assemble.left_assemble(anchored.drop(s.subject), [summary.drop("stay_id")], [s.entity])
        return assemble.with_missing_flags(every, s.vitals.stems)

    # --- assembled versions --------------------------------------------------

    def _wide(self, version: str) -> DataFrame:
        """V1 to V4 with the split driver still attached."""
        s = self.study
        head = self.base.select(s.entity, s.subject, s.anchor, s.label, s.age, "anchor_year")
        if version == "V1":
            parts = [self.labs("core", everyone=False), self.comorbidity().select(s.entity, s.score)]
            return assemble.left_assemble(head, parts, [s.entity])
        labs = self.labs("extended", everyone=False)
        if version == "V2":
            parts = [labs, self.comorbidity().select(s.entity, s.score)]
        else:
            codes = flags.all_code_flags(
                self.tables["diagnoses"], s.entity, s.comorbidity, s.weights, s.score, s.chronic
            ).drop(*[rule.name for rule in s.comorbidity])
            parts = [labs, self.medications(everyone=False), self.procedures(everyone=False), codes]
        if version == "V4":
            parts.append(self._vitals_inside())
        wide = assemble.left_assemble(head, parts, [s.entity])
        wide = assemble.with_missing_flags(wide, s.extended.stems)
        return assemble.with_missing_flags(wide, s.vitals.stems) if version == "V4" else wide

    def columns(self, version: str) -> list[str]:
        """Column order of a feature table."""
        s = self.study
        head = [s.entity, s.subject, s.anchor, s.label, s.age]
        if version == "V1":
            return [*head, *s.core.first_columns, s.score]
        names = [*head, *s.extended.first_columns, *s.extended.missing_columns, s.score]
        if version == "V2":
            return names
        names += [rule.name for rule in (*s.medications, *s.procedures, *s.chronic)]
        if version == "V5":
            present = [c for c in s.stay_columns if c in self.tables["stays"].columns]
            names += ["stay_id", "intime", *present]
        if version in ("V4", "V5"):
            names += [*s.vitals.value_columns, *s.vitals.missing_columns]
        return names

    def stay_cohort(self, v3: DataFrame | None = None) -> DataFrame:
        """V3 rows of entities with a stay, with the first stay's columns."""
        s = self.study
        v3 = self.features("V3") if v3 is None else v3
        return with_first_stay(v3, self.tables["stays"], s.entity, s.stay_columns)

    def features(self, version: str, v3: DataFrame | None = None) -> DataFrame:
        """One version's table.  V5 and V6 accept an already written V3."""
        return self._build(version, v3).select(*self.columns(version))

    def _build(self, version: str, v3: DataFrame | None = None) -> DataFrame:
        """A version's columns, and the split driver unless a plain V3 is given."""
        s = self.study
        if version not in VERSIONS:
            raise ValueError(f"unknown version {version}")
        if version in ("V1", "V2", "V3", "V4"):
            return self._wide(version)
        v3 = self._wide("V3") if v3 is None else v3
        if version == "V5":
            vitals = self.stay_vitals().drop("intime", "stay_id")
            return assemble.left_assemble(self.stay_cohort(v3), [vitals], [s.entity])
        return by_stay(v3, self.tables["stays"], s.entity, has_stay=False)

    def split(
        self, version: str, features: DataFrame | None = None, split_v4: DataFrame | None = None
    ) -> DataFrame:
        """Features with their ``split``; already written inputs may be passed.

        The label follows the subject's year, so a subject is never on both
        sides.  Built from the tables, the year rides along and no join is
        needed.  A written V5 or V6 inherits the labels of the written V4 by
        entity; a written V1 to V4 looks its subject's year up again.
        """
        s = self.study
        if split_v4 is not None:
            return assemble.inherit_split(self.features(version) if features is None else features, split_v4, s.entity)
        if features is None:
            wide = assemble.time_split(self._build(version), "anchor_year", s.split_cut)
            return wide.select(*self.columns(version), "split")
        years = self.tables["patients"].select(s.subject, "anchor_year")
        joined = cohort.join_subject(features, years, s.subject)
        return assemble.time_split(joined, "anchor_year", s.split_cut).drop("anchor_year").select(
            *features.columns, "split"
        )

    def written_splits(self) -> dict[str, DataFrame]:
        """Split tables of all versions, from one written table.

        V4 is written once; V1 to V3 are columns of it, V5 and V6 start from its
        V3 columns and take its labels, and are written too.  Keys, labels and
        row counts are checked while they are written, and ``QualityError`` ends
        the run: every entity must be in V5 or in V6.
        """
        s = self.study
        place = shared_folder(self.tables["admissions"].sparkSession)

        def checked(split: DataFrame) -> CheckedTable:
            return write_checked(split, f"{place}/split-{uuid.uuid4().hex}", [s.entity], label=s.label)

        whole = checked(self.split("V4")).require()
        v4 = whole.table
        splits = {v: v4.select(*self.columns(v), "split") for v in ("V1", "V2", "V3")} | {"V4": v4}
        v3 = v4.select(*self.columns("V3"))
        labels = v4.select(s.entity, "split")
        with_stay, without = (checked(self.split(v, features=self.features(v, v3), split_v4=labels)) for v in ("V5", "V6"))
        without.require(rows=whole.rows - with_stay.require().rows)
        return splits | {"V5": with_stay.table, "V6": without.table}

    #: Tables whose rows belong to an entity.
    FACTS = ("admissions", "stays", "labs", "diagnoses", "vitals")

    def stored(self, database: str, buckets: int) -> FeaturePlan:
        """The same plan over facts that are stored bucketed and sorted by entity.

        Facts are shuffled once, here.  Every version of the returned plan then
        joins and groups them where they lie, as it does the cohort, which is
        stored too.  Prescriptions and procedures are stored with their text
        flags, and procedures with the entity of their stay, so that no dictionary
        is met again.  Rows without an entity belong to none and are left out.
        """
        s = self.study
        stored = dict(self.tables)

        def keep(name: str, df: DataFrame) -> DataFrame:
            return materialize_bucketed(df.where(F.col(s.entity).isNotNull()), f"{database}.{name}", s.entity, buckets)

        for name in self.FACTS:
            if s.entity in self.tables[name].columns:
                stored[name] = keep(name, self.tables[name])
        drugs = flags.flagged_prescriptions(
            self.tables["prescriptions"], s.entity, s.medications, self.tables.get("drug_items")
        )
        stored["flagged_prescriptions"] = keep("flagged_prescriptions", drugs)
        done = flags.flagged_procedures(
            self.tables["stays"], self.tables["procedures"], self.tables["items"], s.entity, s.procedures
        )
        stored["flagged_procedures"] = keep("flagged_procedures", done)
        plan = FeaturePlan(s, stored, bool(self.options))
        plan.base = keep("base", self.base)
        return plan
