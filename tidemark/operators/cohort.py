"""Entities with label and age, and the first sub-interval of each entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import columns as rules
from tidemark.specs import Study


def join_subject(entities: DataFrame, subjects: DataFrame, subject: str) -> DataFrame:
    """Entities with their subject's columns; entities without a subject go."""
    return entities.join(subjects, [subject])


def cohort_base(entities: DataFrame, subjects: DataFrame, study: Study) -> DataFrame:
    """One row per entity of an adult subject.

    ``anchor_year`` rides along so that splits need no second subject join;
    feature tables do not expose it.
    """
    people = subjects.select(
        study.subject, "anchor_age", "anchor_year", *[c for c in study.demographics if c in subjects.columns]
    )
    kept = [c for c in study.demographics if c in people.columns or c in entities.columns]
    return (
        join_subject(entities, people, study.subject)
        .select(
            study.entity,
            study.subject,
            study.anchor,
            rules.binary_label("hospital_expire_flag").alias(study.label),
            rules.age_at_anchor("anchor_age", "anchor_year", study.anchor).alias(study.age),
            *kept,
            "anchor_year",
        )
        .where(F.col(study.age) >= study.min_age)
    )


def rank_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key.

    Spark keeps only one row per key and task before the shuffle (window
    group limit), so a key with very many rows does not reach one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") == 1).drop("_rank")


def first_stay(stays: DataFrame, entity: str = "hadm_id") -> DataFrame:
    """Earliest stay per entity, ties by stay id; incomplete stays are ignored."""
    usable = stays.dropna(subset=[entity, "stay_id", "intime"])
    return rank_one(usable, [entity], [F.asc("intime"), F.asc("stay_id")])


def with_first_stay(features: DataFrame, stays: DataFrame, entity: str, stay_columns: Sequence[str]) -> DataFrame:
    """Entities that have a stay, with columns of their first one."""
    present = [c for c in stay_columns if c in stays.columns]
    first = first_stay(stays.select(entity, "stay_id", "intime", *present), entity)
    return features.join(first, entity)


def by_stay(features: DataFrame, stays: DataFrame, entity: str, has_stay: bool) -> DataFrame:
    """Entities with any stay (semi-join) or without one (anti-join).

    Owners are made distinct first: map-side, so that an entity with very many
    stays reaches the join as one row.
    """
    return features.join(stays.select(entity).distinct(), entity, "left_semi" if has_stay else "left_anti")
