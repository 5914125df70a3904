"""Wide feature tables: left joins on the entity, missing flags, splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import columns as rules


def left_assemble(cohort: DataFrame, parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-join tables holding one row per key; the cohort's rows stay as they are.

    All joins use the same keys, so a side that was aggregated by them is not
    shuffled again, and a part whose columns go unused is removed from the plan.
    """
    return reduce(lambda wide, part: wide.join(part, list(keys), "left"), parts, cohort)


def with_missing_flags(df: DataFrame, stems: Sequence[str]) -> DataFrame:
    """``<stem>_missing`` is 1 where ``<stem>_first`` is null."""
    return df.withColumns({f"{stem}_missing": rules.missing_flag(f"{stem}_first") for stem in stems})


def time_split(df: DataFrame, driver: str, cut: int) -> DataFrame:
    """``train`` below the cut, else ``valid``; a null driver is ``valid``."""
    return df.withColumn("split", F.when(F.col(driver) < cut, "train").otherwise("valid"))


def inherit_split(features: DataFrame, split: DataFrame, entity: str) -> DataFrame:
    """Split labels of another version, matched by entity."""
    return features.join(split.select(entity, "split"), entity)


def split_rows(df: DataFrame, part: str) -> DataFrame:
    return df.where(F.col("split") == part)


def select_candidates(df: DataFrame, candidates: Sequence[str]) -> list[str]:
    """Candidates present in the table, in order, each once; none is an error."""
    kept = [c for c in dict.fromkeys(candidates) if c in df.columns]
    if not kept:
        raise ValueError("none of the candidate feature columns is present")
    return kept


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The table itself, or an error naming absent columns, before any job."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    return df
