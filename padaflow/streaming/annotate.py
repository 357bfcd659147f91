"""Annotation of unbounded input: the batch plan is stateless and narrow, so it runs unchanged on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from padaflow.operators.export import json_lines
from padaflow.plans.engine import Engine


def annotate_stream(engine: Engine, stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write annotated documents of ``stream(text)`` as JSON lines; ``once`` stops after what is there now."""
    writer = json_lines(engine.annotate(stream)).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
