"""Model store (S6-S8): fitted models saved under a store folder as
``{model_name}_{yyyyMMdd_HHmmss}``, one registry row per save appended to a
parquet table, listing and loading by file name."""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.operators.models import FittedModel, load_model as _load

REGISTRY = "registry"


def save_model(model: FittedModel, store: str, model_name: str | None = None) -> str:
    """Save a fitted model (S6) and register it (S7); returns the file name."""
    name = (model_name or model.name).replace(" ", "_")
    stamp = _dt.datetime.now().strftime("%Y%m%d_%H%M%S_%f")
    filename = f"{name}_{stamp}"
    model.save(os.path.join(store, filename))
    register_model(SparkSession.getActiveSession(), store, filename, model.name, model.classification)
    return filename


def register_model(spark: SparkSession, store: str, filename: str, model_name: str,
                   is_classification: bool) -> None:
    """Append one metadata row to the registry table."""
    row = spark.createDataFrame([(filename, model_name, _dt.datetime.now().isoformat(timespec="seconds"),
                                  bool(is_classification))],
                                "filename string, model_name string, timestamp string, is_classification boolean")
    row.coalesce(1).write.mode("append").parquet(os.path.join(store, REGISTRY))


def list_models(spark: SparkSession, store: str) -> DataFrame:
    """Registered models, newest first."""
    return spark.read.parquet(os.path.join(store, REGISTRY)).orderBy(F.desc("timestamp"), "filename")


def load_model(store: str, filename: str) -> FittedModel:
    """Load one saved model."""
    return _load(os.path.join(store, filename))
