"""Stored metrics kept up to date from a stream of source files.

There is no streaming query language here: a stream only tells when to refresh. Each micro-batch hands its rows' dimension
values to the same merge that a scheduled refresh uses, so results are those of the batch operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..model import Metric, Source
from ..operators.materialize import MaterializedStore
from ..plans.governance import utc_now


def refresh_on_arrival(stream: DataFrame, metric: Metric, source: Source, store: MaterializedStore, load, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that refreshes `metric` after each micro-batch with rows. `load()` gives the source as it is then."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.refresh(metric, source, load(), utc_now())

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()
