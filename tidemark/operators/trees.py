"""Nodes of boosted trees, and how many of the trees to keep."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

# Spark's boosted classifier reports P(1) = 1 / (1 + exp(-2 * margin)).
LOG_ODDS_PER_MARGIN = 2.0
# Probabilities are counted in this many bins to choose the number of trees.
BINS = 2048


def node_table(spark: SparkSession, model_path: str) -> pd.DataFrame:
    """Nodes of a saved boosted model.

    Bounded by the model: trees times nodes of a depth-limited tree.
    """
    data = spark.read.parquet(f"{model_path}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("id"),
        F.col("nodeData.prediction").alias("prediction"),
        F.col("nodeData.impurityStats")[0].alias("weight"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.when(
            F.col("nodeData.leftChild") >= 0, F.col("nodeData.split.leftCategoriesOrThreshold")[0]
        ).alias("threshold"),
    )
    return data.toPandas()


def first_trees(model: GBTClassificationModel, saved: str, size: int) -> GBTClassificationModel:
    """The first ``size`` trees of a model that is saved under ``saved``, written beside it and loaded.

    Later trees only add to what the earlier ones say, so these are what a fit
    of ``size`` rounds gives.
    """
    spark = SparkSession.active()
    place = f"{saved}-first-{size}"
    (line,) = spark.read.text(f"{saved}/metadata").collect()
    record = json.loads(line["value"])
    record["numTrees"] = size
    record["paramMap"] = {**record.get("paramMap", {}), "maxIter": size}
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.text(f"{place}/metadata")
    for part in ("data", "treesMetadata"):
        rows = spark.read.parquet(f"{saved}/{part}")
        # the number of the tree comes first in either table
        rows.where(F.col(rows.columns[0]) < size).write.parquet(f"{place}/{part}")
    cut = GBTClassificationModel.load(place)
    if cut.getNumTrees != size or cut.numFeatures != model.numFeatures:
        raise ValueError(f"{cut.getNumTrees} trees of {cut.numFeatures} inputs were loaded, not {size} of {model.numFeatures}")
    return cut


def tree_values(nodes: pd.DataFrame, x: np.ndarray) -> np.ndarray:
    """Prediction of every tree (column) for every row of ``x``."""
    out = []
    for _, group in nodes.sort_values(["tree", "id"]).groupby("tree"):
        left, right = group["left"].to_numpy(), group["right"].to_numpy()
        feature = np.maximum(group["feature"].to_numpy(), 0)
        threshold = group["threshold"].fillna(0).to_numpy(dtype=float)
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := left[at] >= 0).any():
            goes_left = x[np.arange(len(x)), feature[at]] <= threshold[at]
            at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
        out.append(group["prediction"].to_numpy()[at])
    return np.stack(out, axis=1)


def binned_precision(positive: np.ndarray, rows: np.ndarray) -> float:
    """Average precision from counts by falling score."""
    hits, seen = positive.cumsum(), rows.cumsum()
    if not hits[-1]:
        return 0.0
    return float((positive * hits / np.maximum(seen, 1)).sum() / hits[-1])


def precision_by_size(
    valid: DataFrame, nodes: pd.DataFrame, weights: Sequence[float], label: str = "_y", features: str = "features"
) -> list[float]:
    """Average precision on ``valid`` of the first 1, 2, ... trees, in one pass.

    Every task counts rows by size and score bin; what is summed and collected
    has a size set by the number of trees.  Of the inputs only those that a tree
    asks for leave the sparse vectors.
    """
    inner = nodes["left"] >= 0
    asked = sorted(set(nodes.loc[inner, "feature"].astype(int))) or [0]
    nodes = nodes.assign(feature=nodes["feature"].where(inner, asked[0]).astype(int).map({f: i for i, f in enumerate(asked)}))
    shared = valid.sparkSession.sparkContext.broadcast((nodes, np.array(weights)))
    size = len(weights)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, scale = shared.value
        counts = np.zeros((2, size, BINS), dtype=np.int64)
        for batch in batches:
            if batch.empty:
                continue
            margins = np.cumsum(tree_values(table, np.stack(batch["x"].to_numpy())) * scale, axis=1)
            share = 1 / (1 + np.exp(-LOG_ODDS_PER_MARGIN * margins))
            place = np.arange(size) * BINS + np.minimum((share * BINS).astype(np.int64), BINS - 1)
            for kind, picked in ((0, slice(None)), (1, batch["y"].to_numpy() == 1)):
                counts[kind] += np.bincount(place[picked].ravel(), minlength=size * BINS).reshape(size, BINS)
        k, b = np.nonzero(counts[0])
        yield pd.DataFrame({"k": k, "bin": b, "n": counts[0][k, b], "pos": counts[1][k, b]})

    sliced = VectorSlicer(inputCol=features, outputCol="_asked", indices=asked).transform(valid)
    rows = sliced.select(F.col(label).alias("y"), vector_to_array("_asked").alias("x"))
    summed = (
        rows.mapInPandas(count, "k long, bin long, n long, pos long")
        .groupBy("k", "bin")
        .agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        .toPandas()
        .sort_values(["k", "bin"], ascending=[True, False])
    )
    return [binned_precision(g["pos"].to_numpy(), g["n"].to_numpy()) for _, g in summed.groupby("k")]


def best_size(precision: Sequence[float], patience: int) -> int:
    """Number of trees with the best value before ``patience`` more brought nothing."""
    best = 0
    for i, value in enumerate(precision):
        if value > precision[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1
