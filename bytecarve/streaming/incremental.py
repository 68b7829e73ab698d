"""Carving a stream of files: every new binary value is carved on its own, with the batch plan's kernel.

Records carry no event time, so there is no watermark; selection and duplicates are settled inside a
value by ``foreachBatch`` on ``carve_column``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.carve import carve_column


def carve_stream(stream: DataFrame, id_column: str, content: str, sink: Callable[[DataFrame, int], None], checkpoint: str, **options) -> StreamingQuery:
    """Start a query that hands the records of each micro-batch to ``sink(records, epoch)``."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, epoch: sink(carve_column(batch, id_column, content, **options), epoch)).start()
