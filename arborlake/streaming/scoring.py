"""Scoring of streams: models keep no state, so every micro-batch is one map over Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from arborlake.plans.boosting import Model


def score_stream(model: Model, stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **trigger) -> StreamingQuery:
    """Writes a stream with its predictions; ``trigger`` as for ``writeStream.trigger``, all that is there and stop by default."""
    scored = model.transform(stream)
    return scored.writeStream.format(fmt).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
