"""Reports and models."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.schema import STEP


def write_reports(path: str, model: str, reports: dict[str, DataFrame]) -> None:
    """One CSV folder per report: true positives, false positives, false negatives, true events."""
    for name, df in reports.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{model}_{name}")


def write_summary(path: str, failures: dict[str, str], tables: dict[str, DataFrame]) -> None:
    """Results, feature importances and whatever else is told about a run, and the failures, as
    JSON lines."""
    spark = next(iter(tables.values())).sparkSession
    failed = spark.createDataFrame(list(failures.items()), "model string, error string")
    for name, df in {**tables, "failures": failed}.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def save_model(
    spark: SparkSession, path: str, model: PipelineModel, names: list[str], window: int, width: int,
    threshold: float, **extra,
) -> None:
    """The fitted pipeline with its feature names and metadata next to it."""
    model.write().overwrite().save(f"{path}/model")
    meta = {
        "window_seconds": window, "step_seconds": STEP, "model_type": type(model.stages[-1]).__name__,
        "width": width, "threshold": threshold, "spark_version": spark.version, **extra,
    }
    row = spark.createDataFrame([(names, json.dumps(meta))], "feature_names array<string>, metadata string")
    row.withColumn("trained_at", F.current_timestamp()).write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str], dict]:
    row = spark.read.json(f"{path}/metadata").first()
    return PipelineModel.load(f"{path}/model"), list(row["feature_names"]), json.loads(row["metadata"])
