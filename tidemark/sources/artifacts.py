"""Predictions, reports and models on storage, written and read by Spark."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tidemark.operators.assemble import require_columns
from tidemark.operators.prep import Preprocessor
from tidemark.operators.train import FittedModel

LATEST = "latest"


def write_predictions(scored: DataFrame, path: str, source: str = "parquet") -> None:
    """Row-level predictions; every task writes its own part."""
    writer = scored.write.mode("overwrite").format(source)
    (writer.option("header", True) if source == "csv" else writer).save(path)


def read_predictions(
    spark: SparkSession, path: str, required: Sequence[str], source: str = "parquet", schema: str | None = None
) -> DataFrame:
    """Scored rows; label, predicted label and score must be there."""
    reader = spark.read.format(source)
    if source == "csv":
        reader = reader.option("header", True)
    if schema:
        reader = reader.schema(schema)
    return require_columns(reader.load(path), required)


def write_report(report: DataFrame, path: str, source: str = "json") -> None:
    """A small summary table as one file; its rows are few by construction."""
    writer = report.repartition(1).write.mode("overwrite").format(source)
    (writer.option("header", True) if source == "csv" else writer).save(path)


def write_bundle(spark: SparkSession, reports: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Reports that belong together, as Parquet below one folder, and their manifest ``name, path, rows``.

    Rows are counted while they are written.  The manifest is written last, so a
    folder with a manifest is complete.
    """
    rows = []
    for name, report in reports.items():
        seen = Observation()
        report.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{folder}/{name}")
        rows.append((name, f"{folder}/{name}", seen.get["rows"]))
    manifest = spark.createDataFrame(rows, "name string, path string, rows long")
    write_report(manifest, f"{folder}/manifest", "parquet")
    return manifest


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The reports of a complete bundle by name."""
    return {r["name"]: spark.read.parquet(r["path"]) for r in spark.read.parquet(f"{folder}/manifest").collect()}


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_model(
    spark: SparkSession, model: FittedModel, folder: str, stamp: str | None = None, latest: bool = True
) -> str:
    """Save under a time stamp and, on request, as the latest; returns the stamp."""
    stamp = stamp or datetime.now().strftime("%Y%m%d_%H%M%S")
    for name in (stamp, LATEST) if latest else (stamp,):
        model.pipeline.write().overwrite().save(f"{folder}/pipelines/{name}")
        if model.prep.categories is not None:
            model.prep.categories.write.mode("overwrite").parquet(f"{folder}/categories/{name}")
        record = {"prep": model.prep.to_json(), "label": model.label, "details": model.details}
        # the record is written last: a model is listed once it is complete
        _write_text(spark, json.dumps(record), f"{folder}/records/stamp={name}")
    return stamp


def model_stamps(spark: SparkSession, folder: str) -> list[str]:
    try:
        rows = spark.read.text(f"{folder}/records").select("stamp").distinct().collect()
    except AnalysisException as error:
        raise FileNotFoundError(f"no model under {folder}") from error
    return sorted(str(row["stamp"]) for row in rows)


def load_model(spark: SparkSession, folder: str, stamp: str | None = None) -> FittedModel:
    """A given stamp, else the latest, else the newest stamp."""
    stamps = model_stamps(spark, folder)
    if stamp is None:
        stamp = LATEST if LATEST in stamps else stamps[-1]
    if stamp not in stamps:
        raise FileNotFoundError(f"no model {stamp} under {folder}")
    record = json.loads(spark.read.text(f"{folder}/records/stamp={stamp}").first()["value"])
    pipeline = PipelineModel.load(f"{folder}/pipelines/{stamp}")
    prep = Preprocessor.from_json(record["prep"])
    if prep.categorical:
        prep.categories = spark.read.parquet(f"{folder}/categories/{stamp}")
    return FittedModel(prep, pipeline, record["label"], record["details"])
