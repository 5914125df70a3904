"""Column rules.  All are Catalyst expressions: no Python runs per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from tidemark.specs import CodeRule, Codes, TextRule, Vitals


def binary_label(flag: str) -> Column:
    """1 where the flag is 1, else 0; a null flag counts as 0."""
    return F.when(F.col(flag) == 1, 1).otherwise(0)


def age_at_anchor(age: str, year: str, anchor: str) -> Column:
    """Age at the anchor time from an age known for one calendar year."""
    years = F.col(age) + F.year(anchor) - F.col(year)
    return F.round(years.cast("decimal(12,2)"), 1).cast("decimal(10,1)")


def missing_flag(column: str) -> Column:
    return F.col(column).isNull().cast("int")


def code_system(version: str, strict: bool) -> Column:
    """Code system 9 or 10.  Strict: anything else is null; loose: it is 10."""
    known = F.when(F.col(version) == 9, 9)
    return known.when(F.col(version) == 10, 10) if strict else known.otherwise(10)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions)


def code_matches(code: str, codes: Codes) -> Column:
    """Prefix match or closed lexicographic range on the code text."""
    column = F.col(code)
    tests = [column.startswith(prefix) for prefix in codes.prefixes]
    tests += [column.between(low, high) for low, high in codes.ranges]
    return any_of(tests)


def code_rule(rule: CodeRule, system: Column, code: str) -> Column:
    """0/1; never null, so that an unmatched or null code counts as 0."""
    hit = any_of([(system == number) & code_matches(code, codes) for number, codes in rule.systems.items()])
    return F.when(hit, 1).otherwise(0)


def text_rule(rule: TextRule, text: Column) -> Column:
    """0/1 for an unanchored regular-expression match; null text gives null."""
    return text.rlike(rule.pattern).cast("int")


def canonical_item(item: str, items: Mapping[object, str]) -> Column:
    """Raw item id -> canonical name, null when the id is not listed."""
    names: dict[str, list[object]] = {}
    for raw, name in items.items():
        names.setdefault(name, []).append(raw)
    pairs = [(F.col(item).isin(ids), F.lit(name)) for name, ids in names.items()]
    first, *rest = pairs
    return reduce(lambda column, pair: column.when(*pair), rest, F.when(*first))


def harmonized_value(item: str, value: str, vitals: Vitals) -> Column:
    """Fahrenheit values become Celsius; other values stay."""
    fahrenheit = vitals.ids(vitals.fahrenheit)
    if not fahrenheit:
        return F.col(value)
    celsius = (F.col(value) - 32.0) * 5.0 / 9.0
    return F.when(F.col(item).isin(fahrenheit), celsius).otherwise(F.col(value))


def plausible(item: str, value: str, vitals: Vitals) -> Column:
    """Harmonized value lies inside the closed range of its item.

    Stated per raw id, so that rows are dropped by cheap comparisons before
    names are built.
    """
    harmonized = harmonized_value(item, value, vitals)
    groups: dict[str, list[object]] = {}
    for raw, name in vitals.merged.items():
        groups.setdefault(name, []).append(raw)
    return any_of(
        [F.col(item).isin(ids) & harmonized.between(*vitals.bounds[name]) for name, ids in groups.items()]
    )


def no_nan(column: Column) -> Column:
    """NaN means missing, like null."""
    return F.when(F.isnan(column), None).otherwise(column)
