"""Group flags per entity from code sets and free text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import columns as rules
from tidemark.operators.events import event_window
from tidemark.specs import CodeRule, TextRule


def weighted_score(weights: Mapping[str, int]) -> Column:
    return sum((F.col(name) * weight for name, weight in weights.items()), F.lit(0))


def comorbidity_flags(
    codes: DataFrame, entity: str, rules_: Sequence[CodeRule], weights: Mapping[str, int], score: str
) -> DataFrame:
    """Code flags under the strict system rule, plus their weighted score."""
    system = rules.code_system("icd_version", strict=True)
    flags = [F.max(rules.code_rule(r, system, "icd_code")).alias(r.name) for r in rules_]
    per_entity = codes.where(F.col(entity).isNotNull()).groupBy(entity).agg(*flags)
    return per_entity.withColumn(score, weighted_score(weights))


def chronic_groups(codes: DataFrame, entity: str, rules_: Sequence[CodeRule]) -> DataFrame:
    """Code flags under the loose system rule; a null entity forms a group."""
    system = rules.code_system("icd_version", strict=False)
    flags = [F.max(rules.code_rule(r, system, "icd_code")).alias(r.name) for r in rules_]
    return codes.groupBy(entity).agg(*flags)


def all_code_flags(
    codes: DataFrame,
    entity: str,
    comorbidity: Sequence[CodeRule],
    weights: Mapping[str, int],
    score: str,
    chronic: Sequence[CodeRule],
) -> DataFrame:
    """Score and chronic flags in one pass over the codes, for assembly."""
    strict, loose = rules.code_system("icd_version", True), rules.code_system("icd_version", False)
    flags = [F.max(rules.code_rule(r, strict, "icd_code")).alias(r.name) for r in comorbidity]
    flags += [F.max(rules.code_rule(r, loose, "icd_code")).alias(r.name) for r in chronic]
    per_entity = codes.where(F.col(entity).isNotNull()).groupBy(entity).agg(*flags)
    return per_entity.withColumn(score, weighted_score(weights))


def _max_flags(events: DataFrame, entity: str, flags: Sequence[str]) -> DataFrame:
    return events.groupBy(entity).agg(*[F.max(name).alias(name) for name in flags])


def medication_flags(
    entities: DataFrame,
    prescriptions: DataFrame,
    entity: str,
    anchor: str,
    window: timedelta,
    rules_: Sequence[TextRule],
    dictionary: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Text flags of prescriptions started in the window; null text is empty.

    The text is the ``drug`` column, or, where prescriptions are coded, the
    ``drug`` of their ``itemid`` in ``dictionary``; then expressions run once
    per dictionary entry and only in-window items are looked up.
    """
    text = F.lower(F.coalesce(F.col("drug"), F.lit("")))
    flags = [rules.text_rule(r, text).alias(r.name) for r in rules_]
    source = "drug" if dictionary is None else "itemid"
    rows = prescriptions.select(entity, source, "starttime")
    inside = event_window(entities, rows, [entity], anchor, "starttime", window, **options)
    if dictionary is None:
        flagged = inside.select(entity, *flags)
    else:
        flagged = inside.select(entity, "itemid").join(dictionary.select("itemid", *flags), ["itemid"])
    return _max_flags(flagged, entity, [r.name for r in rules_])


def label_flags(items: DataFrame, rules_: Sequence[TextRule], label: str = "label") -> DataFrame:
    """Flags per dictionary item, so that expressions run once per label."""
    text = F.lower(label)
    return items.select("itemid", *[rules.text_rule(r, text).alias(r.name) for r in rules_])


def procedure_events(
    entities: DataFrame,
    stays: DataFrame,
    procedures: DataFrame,
    entity: str,
    anchor: str,
    window: timedelta,
    **options,
) -> DataFrame:
    """Procedure events of an entity's stays inside the entity's window.

    Stays take their entity's anchor first; procedure events are then joined
    once, on the stay, and the window is applied in that join.
    """
    owners = stays.select(entity, "stay_id").dropna()
    anchored = owners.join(entities.select(entity, anchor), [entity])
    rows = procedures.select("stay_id", "itemid", "starttime")
    return event_window(anchored, rows, ["stay_id"], anchor, "starttime", window, carry=[entity], **options)


def procedure_flags(
    entities: DataFrame,
    stays: DataFrame,
    procedures: DataFrame,
    items: DataFrame,
    entity: str,
    anchor: str,
    window: timedelta,
    rules_: Sequence[TextRule],
    **options,
) -> DataFrame:
    """Text flags of procedure labels in the window, one row per entity."""
    inside = procedure_events(entities, stays, procedures, entity, anchor, window, **options)
    flagged = inside.select(entity, "itemid").join(label_flags(items, rules_), ["itemid"])
    return _max_flags(flagged, entity, [r.name for r in rules_])


# --- events with their flags, to be stored by entity ---------------------------


def flagged_prescriptions(
    prescriptions: DataFrame, entity: str, rules_: Sequence[TextRule], dictionary: DataFrame | None = None
) -> DataFrame:
    """``entity, starttime`` and the text flags of every prescription; coded ones without an entry go."""
    text = F.lower(F.coalesce(F.col("drug"), F.lit("")))
    flags = [rules.text_rule(r, text).alias(r.name) for r in rules_]
    if dictionary is None:
        return prescriptions.select(entity, "starttime", *flags)
    coded = prescriptions.select(entity, "itemid", "starttime")
    return coded.join(dictionary.select("itemid", *flags), ["itemid"]).drop("itemid")


def flagged_procedures(
    stays: DataFrame, procedures: DataFrame, items: DataFrame, entity: str, rules_: Sequence[TextRule]
) -> DataFrame:
    """``entity, starttime`` and the text flags of every procedure event of an entity's stays."""
    owners = stays.select(entity, "stay_id").dropna().distinct()
    events = procedures.select("stay_id", "itemid", "starttime").join(label_flags(items, rules_), ["itemid"])
    return events.join(owners, ["stay_id"]).drop("itemid", "stay_id")


def window_flags(
    entities: DataFrame,
    flagged: DataFrame,
    entity: str,
    anchor: str,
    window: timedelta,
    rules_: Sequence[TextRule],
    **options,
) -> DataFrame:
    """Flags of the events in the window, one row per entity; stored by entity, nothing is shuffled."""
    inside = event_window(entities.select(entity, anchor), flagged, [entity], anchor, "starttime", window, **options)
    return _max_flags(inside, entity, [r.name for r in rules_])
