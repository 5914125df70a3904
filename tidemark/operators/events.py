"""Events in a time window after each entity's anchor, and their summaries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import columns as rules
from tidemark.operators.cohort import rank_one
from tidemark.specs import Panel, Vitals


def event_window(
    entities: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    anchor: str,
    time: str,
    window: timedelta,
    *,
    carry: Sequence[str] = (),
    same: Sequence[str] = (),
    prune_scan: bool = False,
) -> DataFrame:
    """Events with ``anchor <= time < anchor + window`` of their entity.

    ``carry`` names entity columns to add to the events, ``same`` columns that
    must agree besides the keys.  The equi-join on ``keys`` carries these and
    the time range as a residual condition; a hot key is split by adaptive
    execution.
    ``prune_scan`` adds the earliest and latest useful event time as literal
    bounds; that lets date-partitioned or time-sorted event tables skip files
    when the entities cover a slice of time, at the cost of a min/max job.
    """
    length = F.lit(window)
    rows = events.where(F.col(time).isNotNull())
    if prune_scan:
        span = entities.agg(F.min(anchor).alias("lo"), (F.max(anchor) + length).alias("hi"))
        rows = rows.where(
            (F.col(time) >= span.select("lo").scalar()) & (F.col(time) < span.select("hi").scalar())
        )
    anchors = entities.select(
        *keys, *carry, *[F.col(c).alias(f"_own_{c}") for c in same], F.col(anchor).alias("_anchor")
    )
    inside = (F.col(time) >= F.col("_anchor")) & (F.col(time) < F.col("_anchor") + length)
    for c in same:
        # as an equality it would become a key of the join, and undo a partitioning by the others
        inside &= (F.col(c) >= F.col(f"_own_{c}")) & (F.col(c) <= F.col(f"_own_{c}"))
    return rows.join(anchors, list(keys)).where(inside).drop("_anchor", *[f"_own_{c}" for c in same])


def pick_items(events: DataFrame, items: Sequence[object], item: str = "itemid", value: str = "valuenum") -> DataFrame:
    """Rows of the listed items with a value; both tests reach the file scan."""
    return events.where(F.col(item).isin(list(items)) & F.col(value).isNotNull())


def first_in_window(
    events: DataFrame, keys: Sequence[str], item: str = "itemid", time: str = "charttime", value: str = "valuenum"
) -> DataFrame:
    """First value per (key, item) in long form; equal times: smallest value."""
    first = rank_one(events.select(*keys, item, time, value), [*keys, item], [F.asc(time), F.asc(value)])
    return first.select(*keys, item, time, F.col(value).alias("first_value"))


def earliest(mine: Column, time: str, value: str) -> Column:
    """Aggregate: the value at the earliest time of the rows where ``mine`` holds, the smallest of equal times.

    One fixed entry a group.  Spark sorts by the keys for it, as a sort-merge
    join has done already, and holds a single group at a time: a task's memory
    does not grow with its groups, nor with the events of one key.
    """
    at = F.struct(F.col(time).alias("at"), F.col(value).isNull().alias("absent"), F.col(value).alias("value"))
    return F.min(F.when(mine & F.col(time).isNotNull(), at))["value"]


def pivot_first(
    events: DataFrame,
    keys: Sequence[str],
    panel: Panel,
    item: str = "itemid",
    time: str = "charttime",
    value: str = "valuenum",
) -> DataFrame:
    """One row per key with a ``<stem>_first`` column for each panel item."""
    firsts = [earliest(F.col(item) == raw, time, value).alias(f"{stem}_first") for raw, stem in panel.items.items()]
    return events.groupBy(*keys).agg(*firsts)


def panel_first(
    entities: DataFrame,
    events: DataFrame,
    panel: Panel,
    keys: Sequence[str],
    anchor: str,
    window: timedelta,
    **options,
) -> DataFrame:
    """Window join, item filter and pivot in one: first values of a lab panel."""
    wanted = pick_items(events, list(panel.items)).select(*keys, "itemid", "valuenum", "charttime")
    return pivot_first(
        event_window(entities, wanted, keys, anchor, "charttime", window, **options), keys, panel
    )


def clean_vitals(events: DataFrame, vitals: Vitals, item: str = "itemid", value: str = "valuenum") -> DataFrame:
    """Canonical name and unit, unlisted items and implausible values removed.

    Adds ``vital_name`` and ``vital_value``.
    """
    listed = pick_items(events, list(vitals.items), item, value)
    return listed.where(rules.plausible(item, value, vitals)).withColumns(
        {
            "vital_name": rules.canonical_item(item, vitals.merged),
            "vital_value": rules.harmonized_value(item, value, vitals),
        }
    )


def summarize_vitals(cleaned: DataFrame, keys: Sequence[str], vitals: Vitals, time: str = "charttime") -> DataFrame:
    """First, minimum and maximum of every vital in one aggregation."""
    summaries = []
    for name, stem in zip(vitals.bounds, vitals.stems):
        mine = F.col("vital_name") == name
        own = F.when(mine, F.col("vital_value"))
        summaries += [
            earliest(mine, time, "vital_value").alias(f"{stem}_first"),
            F.min(own).alias(f"{stem}_min"),
            F.max(own).alias(f"{stem}_max"),
        ]
    return cleaned.groupBy(*keys).agg(*summaries)


def min_max_pivot(cleaned: DataFrame, keys: Sequence[str], vitals: Vitals) -> DataFrame:
    """Minimum and maximum of every vital, one row per key."""
    summaries = []
    for name, stem in zip(vitals.bounds, vitals.stems):
        mine = F.when(F.col("vital_name") == name, F.col("vital_value"))
        summaries += [F.min(mine).alias(f"{stem}_min"), F.max(mine).alias(f"{stem}_max")]
    return cleaned.groupBy(*keys).agg(*summaries)


def vital_summary(
    entities: DataFrame,
    events: DataFrame,
    vitals: Vitals,
    keys: Sequence[str],
    anchor: str,
    window: timedelta,
    same: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Summaries of the vitals in the window after the anchor."""
    wanted = clean_vitals(events, vitals).select(*keys, *same, "vital_name", "vital_value", "charttime")
    inside = event_window(entities, wanted, keys, anchor, "charttime", window, same=same, **options)
    return summarize_vitals(inside, keys, vitals)
