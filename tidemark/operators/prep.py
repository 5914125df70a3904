"""Preprocessing fitted on the train split, applied as column expressions and joins.

Fitting reduces the train rows to a handful of constants per number and to a
table of categories; only the constants reach the driver.  Categories are
joined as rows and become one sparse vector for each text column, so their
number is not bounded and none is named in a plan.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields

from pyspark.ml import Transformer
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.columns import no_nan
from tidemark.functions.quantiles import exact_quantiles
from tidemark.functions.ranges import numbered
from tidemark.session import cut_lineage
from tidemark.specs import FeatureSet


def number(column: str) -> Column:
    return no_nan(F.col(column).cast("double"))


def fit_medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, median`` for columns that have any value; exact, interpolated.

    ``train`` is read three times, so a long plan is best written before.
    """
    return exact_quantiles(train.select(*[number(c).alias(c) for c in columns]), columns, {"median": 0.5})


def fit_modes(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, mode``: most frequent category, ties to the smallest."""
    values = train.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "feature", "value"
    )
    counts = values.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))


def fit_categories(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, value``: distinct non-null categories."""
    return (
        train.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], list(columns), "feature", "value")
        .where(F.col("value").isNotNull())
        .distinct()
    )


def indexed_categories(known: DataFrame) -> DataFrame:
    """``known`` (feature, value) with the ``place`` of a value among its feature's, from 0 in ascending order.

    Written once; numbers come from range partitions, not from one task for a feature.
    """
    placed = numbered(known, [F.col("feature"), F.col("value")], "_at")
    first = F.broadcast(placed.groupBy("feature").agg(F.min("_at").alias("_first")))  # a row for each column
    return placed.join(first, "feature").select("feature", "value", (F.col("_at") - F.col("_first")).alias("place"))


def fit_scales(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, mean, scale`` with population deviation, 1 where it is 0."""
    stats = [F.avg(c).alias(f"{c}__mean") for c in columns] + [F.stddev_pop(c).alias(f"{c}__sd") for c in columns]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"{c}__mean").alias("mean"),
                F.when(F.col(f"{c}__sd") == 0, 1.0).otherwise(F.col(f"{c}__sd")).alias("scale"),
            )
            for c in columns
        ]
    )
    return train.agg(*stats).select(F.inline(rows))


def observed_counts(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, n_observed`` in one aggregate."""
    wide = train.agg(*[F.count(F.col(c)).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_observed")) for c in columns])
    return wide.select(F.inline(rows))


def drop_all_missing(train: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Columns with any train value, and the absent or all-null ones."""
    present = [c for c in columns if c in train.columns]
    seen: set[str] = set()
    if present:
        numbers = train.select(*[F.when(~_is_nan(train, c), F.col(c)).alias(c) for c in present])
        seen = {row["feature"] for row in observed_counts(numbers, present).collect() if row["n_observed"]}
    return [c for c in columns if c in seen], [c for c in columns if c not in seen]


def _is_nan(df: DataFrame, column: str) -> Column:
    floating = dict(df.dtypes)[column] in ("double", "float")
    return F.isnan(column) if floating else F.lit(False)


def impute(df: DataFrame, fills: Mapping[str, float | str]) -> DataFrame:
    """Null (and NaN) replaced by the given constant per column."""
    text = {c for c, kind in df.dtypes if kind == "string"}
    return df.withColumns(
        {c: F.coalesce(F.col(c) if c in text else number(c), F.lit(v)) for c, v in fills.items()}
    )


def standardize(df: DataFrame, scales: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - mean) / scale for c, (mean, scale) in scales.items()})


def one_hot(df: DataFrame, known: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, ``feature``, ``value`` of each row's ones, as a table.

    An unseen category or a null has none.  Categories are joined as rows, so
    their number is not bounded and none is named in the plan.
    """
    values = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        list(keep), list(columns), "feature", "value"
    )
    return values.join(known, ["feature", "value"])


@dataclass
class Preprocessor:
    """Fitted constants, and the table of categories (feature, value, place).

    The model's inputs are the numbers, the flags, and after them one input for
    each category of each text column.
    """

    family: str
    continuous: list[str]
    binary: list[str]
    categorical: list[str]
    medians: dict[str, float]
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    #: Number of categories of each text column.
    sizes: dict[str, int] = field(default_factory=dict)
    categories: DataFrame | None = field(default=None, compare=False, repr=False)

    @property
    def inputs(self) -> list[str]:
        return [*self.continuous, *self.binary, *self.categorical]

    @property
    def numbers(self) -> list[str]:
        return [*self.continuous, *self.binary]

    @property
    def number_columns(self) -> list[str]:
        """Neutral names of the preprocessed numbers and flags."""
        return [f"_x{i}" for i in range(len(self.numbers))]

    @property
    def encoded(self) -> dict[str, str]:
        """Index column of each text column that has categories."""
        return {c: f"_k{i}" for i, c in enumerate(self.categorical) if self.sizes.get(c)}

    def first_input(self, column: str) -> int:
        """Place of a text column's first category among the inputs."""
        before = self.categorical[: self.categorical.index(column)]
        return len(self.numbers) + sum(self.sizes.get(c, 0) for c in before)

    def input_names(self, spark: SparkSession) -> DataFrame:
        """``input, feature, type`` of every model input; categories as ``column_value``."""
        kinds = ["cont"] * len(self.continuous) + ["bin"] * len(self.binary)
        rows = list(zip(range(len(kinds)), self.numbers, kinds))
        names = spark.createDataFrame(rows, "input long, feature string, type string")
        for c in self.encoded:
            own = self.categories.where(F.col("feature") == c)
            names = names.union(
                own.select(F.col("place") + self.first_input(c), F.concat(F.lit(f"{c}_"), "value"), F.lit("cat"))
            )
        return names

    def expressions(self) -> list[Column]:
        """The preprocessed numbers and flags."""
        out: list[Column] = []
        for c in self.continuous:
            filled = F.coalesce(number(c), F.lit(self.medians[c]))
            mean, scale = self.scales.get(c, (0.0, 1.0))
            out.append((filled - mean) / scale if c in self.scales else filled)
        return out + [F.coalesce(number(c), F.lit(0.0)) for c in self.binary]

    def apply(self, df: DataFrame) -> DataFrame:
        """Numbers added as doubles, and each text column's place among its categories; raw columns stay.

        A null text takes the mode; an unseen one the place after the last,
        which stands for no category.  A category held by many rows is left to
        adaptive execution, which splits it where the join is not broadcast.
        """
        out = df.withColumns(dict(zip(self.number_columns, self.expressions())))
        for c, index in self.encoded.items():
            known = self.categories.where(F.col("feature") == c).select(
                F.col("value").alias(f"{index}_value"), F.col("place").cast("double").alias(index)
            )
            filled = F.coalesce(F.col(c).cast("string"), F.lit(self.modes[c]))
            out = out.join(known, filled == F.col(f"{index}_value"), "left").drop(f"{index}_value")
            out = out.withColumn(index, F.coalesce(index, F.lit(float(self.sizes[c]))))
        return out

    def stages(self, spark: SparkSession) -> list[Transformer]:
        """What makes one vector of what ``apply`` adds: sparse ones for text columns, then all in order."""
        made, stages = [f"{index}_vector" for index in self.encoded.values()], []
        if made:
            last = spark.createDataFrame([tuple(float(self.sizes[c] - 1) for c in self.encoded)], list(self.encoded.values()))
            # the place kept for unseen values is the last one, and that is dropped
            encoder = OneHotEncoder(inputCols=last.columns, outputCols=made, handleInvalid="keep", dropLast=True)
            stages.append(encoder.fit(last))
        return [*stages, VectorAssembler(inputCols=[*self.number_columns, *made], outputCol="features", handleInvalid="error")]

    def to_json(self) -> str:
        return json.dumps({f.name: getattr(self, f.name) for f in fields(self) if f.name != "categories"})

    @staticmethod
    def from_json(text: str, categories: DataFrame | None = None) -> Preprocessor:
        raw = json.loads(text)
        raw["scales"] = {c: tuple(pair) for c, pair in raw["scales"].items()}
        return Preprocessor(**raw, categories=categories)


def fit_preprocessor(train: DataFrame, features: FeatureSet) -> Preprocessor:
    """Linear: median and scaling for numbers, 0 for flags.  Tree: median only.

    Both: mode and one input per category.  Medians, modes and categories are
    exact; scaling sees the imputed numbers.  A text column without any value
    has no category and makes no input.
    """
    numbers, flags, texts = list(features.continuous), list(features.binary), list(features.categorical)
    medians = {r["feature"]: r["median"] for r in fit_medians(train, numbers).collect()} if numbers else {}
    absent = [c for c in numbers if c not in medians]
    if absent:
        raise ValueError(f"columns without any train value: {absent}")
    fitted = Preprocessor(features.family, numbers, flags, texts, medians)
    if features.family == "linear" and numbers:
        filled = impute(train.select(*numbers), medians)
        fitted.scales = {r["feature"]: (r["mean"], r["scale"]) for r in fit_scales(filled, numbers).collect()}
    if texts:
        fitted.modes = {r["feature"]: r["mode"] for r in fit_modes(train, texts).collect()}
        fitted.categories = cut_lineage(indexed_categories(fit_categories(train, texts)))
        counts = fitted.categories.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()
        fitted.sizes = {r["feature"]: r["n"] for r in counts}
    return fitted
