"""Streaming scoring.

The reference has no stream processing; its batch scoring (M14) is a pure
projection for the pipeline-based models and Gaussian naive Bayes, so the
same fitted model applies unchanged to a Structured Streaming DataFrame.
KNN needs a join and an aggregation per query row and is batch-only.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from tabsight.operators.models import KNN, FittedModel
from tabsight.plans.compare import batch_predict


def score_stream(model: FittedModel, stream: DataFrame) -> DataFrame:
    """``batch_predict`` on a streaming DataFrame (``readStream``)."""
    if isinstance(model, KNN):
        raise ValueError("KNN scoring needs a per-row aggregation; score micro-batches with foreachBatch")
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    return batch_predict(model, stream)


def score_micro_batches(model: FittedModel, stream: DataFrame, sink_path: str, checkpoint: str,
                        key: str | None = None):
    """Score every micro-batch with any model (KNN included) and write the
    result as parquet under ``sink_path/batch_id=<epoch>``; returns the started
    query.  Each epoch overwrites its own folder, so a micro-batch replayed
    after a failure replaces its earlier output instead of duplicating it
    (read ``sink_path`` as one parquet table with a ``batch_id`` column)."""
    def each(batch: DataFrame, epoch: int) -> None:
        batch_predict(model, batch, key).write.mode("overwrite") \
            .parquet(os.path.join(sink_path, f"batch_id={epoch}"))
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
