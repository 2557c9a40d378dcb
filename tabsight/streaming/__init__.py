"""Streaming: apply fitted models to Structured Streaming DataFrames."""

from tabsight.streaming.scoring import score_micro_batches, score_stream  # noqa: F401
