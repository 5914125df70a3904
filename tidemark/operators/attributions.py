"""Additive contributions of tree inputs to each row's log-odds.

A leaf's game has few players: the inputs tested on its path.  With ``o_j`` = 1
if the row passes all tests of input j on the path and ``r_j`` the share of
training weight that does, a coalition S is worth
``leaf * prod(o_j for j in S) * prod(r_j for j outside S)``, and the Shapley
value of that product game has a closed form per leaf.  Contributions add up
over leaves and trees; with the bias they equal the model's margin.

All that matters of a row is which tests it passes.  Leaves that ask for few
tests together share a table of their contributions for every outcome of these
tests, so a row costs a comparison for each test and a look-up for each input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.train import FittedModel
from tidemark.operators.trees import LOG_ODDS_PER_MARGIN, node_table


def leaf_paths(nodes: pd.DataFrame, weights: list[float]) -> list[dict]:
    """Leaves as ``value`` and per-input ``(low, high, share)`` along the path.

    ``nodes`` has ``tree, id, prediction, weight, left, right, feature,
    threshold``; a row passes an input's tests when ``low < x <= high``.
    """
    leaves = []
    for tree, group in nodes.groupby("tree"):
        table = {row.id: row for row in group.itertuples()}
        pending = [(0, {})]
        while pending:
            at, path = pending.pop()
            node = table[at]
            if node.left < 0:
                leaves.append({"value": float(node.prediction) * weights[tree] * LOG_ODDS_PER_MARGIN, "path": path})
                continue
            for child, is_left in ((node.left, True), (node.right, False)):
                low, high, share = path.get(node.feature, (-np.inf, np.inf, 1.0))
                if is_left:
                    high = min(high, node.threshold)
                else:
                    low = max(low, node.threshold)
                share *= table[child].weight / node.weight
                pending.append((child, {**path, node.feature: (low, high, share)}))
    return leaves


# Leaves share a table of 2^TESTS outcomes at most.
TESTS = 8


@dataclass
class LeafTable:
    """Contributions of some leaves: ``values[input][outcome]`` of the tests ``x[input] <= threshold``."""

    tests: list[tuple[int, float]]
    values: dict[int, np.ndarray]


def leaf_contributions(leaf: dict, passed: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Contribution of each input of a leaf's path, from whether its tests are passed (1.0) or not (0.0)."""
    path = leaf["path"]
    size = len(path)
    out = {}
    for i in path:
        # worth[k]: summed worth over coalitions of k other players
        worth = [np.ones_like(passed[i])]
        for j in path:
            if j == i:
                continue
            grown = [w * path[j][2] for w in worth] + [np.zeros_like(passed[i])]
            for k, w in enumerate(worth):
                grown[k + 1] = grown[k + 1] + w * passed[j]
            worth = grown
        mean = sum(w * (factorial(k) * factorial(size - 1 - k) / factorial(size)) for k, w in enumerate(worth))
        out[i] = leaf["value"] * (passed[i] - path[i][2]) * mean
    return out


def leaf_tests(leaf: dict) -> list[tuple[int, float]]:
    return [(j, t) for j, (low, high, _) in leaf["path"].items() for t in (low, high) if np.isfinite(t)]


def leaf_tables(leaves: list[dict]) -> list[LeafTable | dict]:
    """Neighbouring leaves in tables; a leaf with too many tests for one stays as it is."""
    groups: list[tuple[list[tuple[int, float]], list[dict]]] = []
    for leaf in leaves:
        own = leaf_tests(leaf)
        union = list(dict.fromkeys([*groups[-1][0], *own])) if groups else own
        if groups and len(union) <= TESTS:
            groups[-1] = (union, [*groups[-1][1], leaf])
        else:
            groups.append((own, [leaf]))
    return [_table(tests, members) if len(tests) <= TESTS else members[0] for tests, members in groups]


def _table(tests: list[tuple[int, float]], leaves: list[dict]) -> LeafTable:
    outcomes = np.arange(1 << len(tests))
    below = {test: (outcomes >> i) & 1 == 1 for i, test in enumerate(tests)}
    always, never = np.ones(len(outcomes), dtype=bool), np.zeros(len(outcomes), dtype=bool)
    values: dict[int, np.ndarray] = {}
    for leaf in leaves:
        passed = {
            j: (~below.get((j, low), never) & below.get((j, high), always)).astype(float)
            for j, (low, high, _) in leaf["path"].items()
        }
        for j, part in leaf_contributions(leaf, passed).items():
            values[j] = values.get(j, 0.0) + part
    return LeafTable(tests, values)


def bias_of(leaves: list[dict]) -> float:
    return sum(leaf["value"] * float(np.prod([share for _, _, share in leaf["path"].values()])) for leaf in leaves)


def tabled_contributions(tables: list[LeafTable | dict], x: np.ndarray) -> np.ndarray:
    """Contribution per row and input."""
    columns = np.ascontiguousarray(x.T)
    out = np.zeros(columns.shape)
    for table in tables:
        if isinstance(table, LeafTable):
            outcome = np.zeros(len(x), dtype=np.uint8)
            for i, (j, threshold) in enumerate(table.tests):
                outcome |= (columns[j] <= threshold).astype(np.uint8) << np.uint8(i)
            for j, values in table.values.items():
                out[j] += values[outcome]
        else:
            passed = {j: ((columns[j] > low) & (columns[j] <= high)).astype(float) for j, (low, high, _) in table["path"].items()}
            for j, part in leaf_contributions(table, passed).items():
                out[j] += part
    return out.T


def contributions(leaves: list[dict], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Contribution per row and input, and the bias common to all rows."""
    return tabled_contributions(leaf_tables(leaves), x), bias_of(leaves)


def seeded_sample(df: DataFrame, key: str, n: int = 2000, seed: int = 42) -> DataFrame:
    """``n`` rows by the digest of seed and key: repeatable on any layout and in any engine."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)).limit(n)


def attributions(model: FittedModel, rows: DataFrame, key: str, scratch: str) -> DataFrame:
    """Long table ``key, feature, contribution`` with the bias as ``<bias>``.

    Every number and flag is listed, and of the categories those that a tree
    asks for: the others contribute nothing.  ``scratch`` is a folder all
    executors' tables may live in; the fitted classifier is saved there to read
    its nodes.
    """
    if not hasattr(model.classifier, "treeWeights"):
        raise TypeError("attributions exist for tree models only")
    spark, prep = rows.sparkSession, model.prep
    path = f"{scratch.rstrip('/')}/classifier"
    model.classifier.write().overwrite().save(path)
    leaves = leaf_paths(node_table(spark, path), list(model.classifier.treeWeights))
    n = len(prep.numbers)
    # bounded by the number of tests in the trees
    categories = sorted({int(j) for leaf in leaves for j in leaf["path"] if j >= n})
    compact = {j: j for j in range(n)} | {j: n + i for i, j in enumerate(categories)}
    leaves = [{"value": leaf["value"], "path": {compact[int(j)]: p for j, p in leaf["path"].items()}} for leaf in leaves]
    names = [*prep.numbers, *_category_names(model, categories)]
    shared = spark.sparkContext.broadcast((leaf_tables(leaves), bias_of(leaves)))
    inputs = [F.col(c) for c in prep.number_columns] + [_is_category(model, j) for j in categories]
    vectors = prep.apply(rows).select(key, F.array(*inputs).alias("x"))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, bias = shared.value
        for batch in batches:
            if batch.empty:
                continue
            values = tabled_contributions(tables, np.stack(batch["x"].to_numpy()))
            yield pd.DataFrame({key: batch[key], "contributions": list(np.c_[values, np.full(len(batch), bias)])})

    kind = rows.schema[key].dataType.simpleString()
    wide = vectors.mapInPandas(explain, f"`{key}` {kind}, contributions array<double>")
    labelled = F.arrays_zip(F.array(*[F.lit(name) for name in [*names, "<bias>"]]).alias("feature"), F.col("contributions").alias("contribution"))
    return wide.select(key, F.inline(labelled).alias("feature", "contribution"))


def _column_of(model: FittedModel, j: int) -> tuple[str, int]:
    """Text column of a model input, and the category's place in it."""
    column = max((c for c in model.prep.encoded if model.prep.first_input(c) <= j), key=model.prep.first_input)
    return column, j - model.prep.first_input(column)


def _is_category(model: FittedModel, j: int) -> Column:
    column, place = _column_of(model, j)
    return (F.col(model.prep.encoded[column]) == place).cast("double")


def _category_names(model: FittedModel, inputs: list[int]) -> list[str]:
    if not inputs:
        return []
    names = model.prep.input_names(model.prep.categories.sparkSession).where(F.col("input").isin(inputs))
    known = {r["input"]: r["feature"] for r in names.collect()}
    return [known[j] for j in inputs]


def attribution_ranking(contributed: DataFrame) -> DataFrame:
    """Mean absolute contribution per input, largest first."""
    return (
        contributed.where(F.col("feature") != "<bias>")
        .groupBy("feature")
        .agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
        .orderBy(F.desc("mean_abs_contribution"), "feature")
    )


def margins(model: FittedModel, rows: DataFrame, key: str) -> DataFrame:
    """Log-odds of class 1 per row, to compare with summed contributions."""
    scored = model.pipeline.transform(model.prep.apply(rows))
    return scored.select(key, (vector_to_array("rawPrediction")[1] * LOG_ODDS_PER_MARGIN).alias("log_odds"))
