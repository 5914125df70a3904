"""Gates and profiles that are collected while a table is written.

The counts ride along with the rows to the sink, so that no gate reads a table
again.  ``checks`` has the same gates for tables that are there already, and
lists the rows that break them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from tidemark.operators.checks import QualityError

SPLITS, OUTCOMES = ("train", "valid"), (0, 1)


@dataclass(frozen=True)
class CheckedTable:
    """A written table and what was counted on the way."""

    table: DataFrame
    counts: dict[str, int]

    @property
    def rows(self) -> int:
        return self.counts["rows"]

    def null_rate(self, column: str) -> float | None:
        return self.counts[f"null:{column}"] / self.rows if self.rows else None

    def violations(self, rows: int | None = None, empty: bool = True) -> dict[str, int]:
        """Broken rules and how often: keys that are null or repeated, labels other than 0 and 1,
        numbers that are not finite, and, where it is given, another number of rows."""
        broken = {
            name: n
            for name, n in self.counts.items()
            if n and name.partition(":")[0] in ("null_key", "repeated_key", "invalid_label", "not_finite")
        }
        if rows is not None and rows != self.rows:
            broken["rows"] = self.rows
        if not empty and not self.rows:
            broken["rows"] = 0
        return broken

    def require(self, rows: int | None = None, empty: bool = True) -> CheckedTable:
        """The table itself, or ``QualityError`` with all broken rules."""
        if broken := self.violations(rows, empty):
            expected = f", {rows} rows expected" if rows is not None else ""
            raise QualityError(f"table breaks its rules: {broken}{expected}")
        return self

    def profile(self, spark: SparkSession) -> DataFrame:
        """``measure, n`` of everything that was counted."""
        return spark.createDataFrame(sorted(self.counts.items()), "measure string, n long")


def write_checked(
    df: DataFrame,
    path: str,
    key: Sequence[str] = (),
    unique: bool = True,
    label: str | None = None,
    finite: Sequence[str] = (),
    nulls: Sequence[str] = (),
) -> CheckedTable:
    """Write ``df`` as Parquet and count in the same pass.

    Counted are rows, null keys and rows that repeat one; rows by split and
    label, and labels other than 0 and 1; nulls and numbers that are null or not
    finite in the named columns.  Repeated keys are told apart by sorting each
    task's rows, without a further shuffle where ``df`` is partitioned by its
    key already, as an assembled feature table is.
    """
    counts: dict[str, Column] = {"rows": F.count(F.lit(1))}
    rows = df
    if key:
        no_key = F.lit(False)
        for c in key:
            no_key = no_key | F.col(c).isNull()
        counts["null_key"] = F.count_if(no_key)
        if unique:
            same = Window.partitionBy(*key).orderBy(*key)
            rows = rows.withColumn("_repeat", F.row_number().over(same))
            counts["repeated_key"] = F.count_if(F.col("_repeat") > 1)
    if label:
        value = F.col(label)
        counts["invalid_label"] = F.count_if(value.isNull() | ~value.isin(*OUTCOMES))
        if "split" in df.columns:
            for split in SPLITS:
                for outcome in OUTCOMES:
                    counts[f"outcome:{split}:{outcome}"] = F.count_if((F.col("split") == split) & (value == outcome))
    for c in nulls:
        counts[f"null:{c}"] = F.count_if(F.col(c).isNull())
    for c in finite:
        number = F.col(c).cast("double")
        bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
        counts[f"not_finite:{c}"] = F.count_if(bad)
    seen = Observation()
    names = {f"m{i}": name for i, name in enumerate(counts)}
    observed = rows.observe(seen, *[c.alias(f"m{i}") for i, c in enumerate(counts.values())])
    observed.drop("_repeat").write.mode("overwrite").parquet(path)
    # a table without a partition observes nothing
    found = seen.get
    spark = df.sparkSession
    return CheckedTable(spark.read.schema(df.schema).parquet(path), {name: int(found.get(m) or 0) for m, name in names.items()})
