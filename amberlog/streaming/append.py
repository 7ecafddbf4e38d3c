"""Streams of changes into the log: micro-batches append, and the current state stays a batch view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from amberlog.operators.changes import MergeOnReadTable


def append_stream(changes: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends a stream to the log as files; exactly once, by the sink's own commit log."""
    return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def apply_stream(changes: DataFrame, table: MergeOnReadTable, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Applies each micro-batch to a merge-on-read table.

    A batch that runs again after a failure writes the same version again (the version is the batch number), so applying stays exactly once.
    """

    def one(batch: DataFrame, number: int) -> None:
        table.version = number - 1
        table.apply(batch)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def in_batches(stream: DataFrame, handler: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hands every micro-batch to a handler."""
    return stream.writeStream.foreachBatch(lambda batch, _: handler(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
