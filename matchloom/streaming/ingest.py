"""An extension beyond batch parity: offers that arrive as a stream of lines, stored once each by their source hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store


def ingest_lines(stream: DataFrame, store: Store, checkpoint: str, to_items: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Upserts each micro-batch's offer lines by (offer_id, line_no), so that a replayed batch changes nothing."""

    def put(rows: DataFrame, _: int) -> None:
        store.upsert("offer_items", to_items(rows))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def line_counts(stream: DataFrame, time_column: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Lines by offer and window, late ones dropped after the watermark."""
    from pyspark.sql import functions as F

    return stream.withWatermark(time_column, late).groupBy(F.window(time_column, width), "offer_id").agg(F.count("*").alias("lines"))
