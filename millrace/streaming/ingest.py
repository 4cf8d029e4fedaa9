"""Bounded ingest of Arrow batches into a table, and the same for a structured stream's micro-batches."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.outcomes import ValidationError
from millrace.session import Engine

# The limits of one ingest
MAX_BATCHES, MAX_ROWS, MAX_BYTES = 128, 1_000_000, 32 << 20


def ingest(engine: Engine, table: str, batches: Iterable[pa.RecordBatch]) -> int:
    """Append Arrow batches as one commit; more than the limits is refused and nothing is written."""
    held, rows, size = [], 0, 0
    for b in batches:
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        for what, now, most in (("batches", len(held), MAX_BATCHES), ("rows", rows, MAX_ROWS), ("bytes", size, MAX_BYTES)):
            if now > most:
                raise ValidationError("VALIDATION_INGEST_LIMIT", f"more than {most} {what}")
    if not held:
        raise ValidationError("VALIDATION_INGEST_EMPTY", "no batches")
    return engine.append(table, engine.spark.createDataFrame(pa.Table.from_batches(held)))


def stream_into(engine: Engine, table: str, stream: DataFrame, checkpoint: str):  # noqa: ANN201
    """Start a stream that commits each micro-batch to the table, once the batches so far are in.

    A batch's commit holds the stream's checkpoint and the batch's number, so a replayed batch is not committed twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        engine.append(table, batch, token=[checkpoint, number])

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
