"""Streams: index tables kept up as documents arrive, and request counts over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import postings_of


def stream_postings(docs: DataFrame, out: str, checkpoint: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> StreamingQuery:
    """Append the postings of new documents. A document's postings need that document only, so the plan has no state.

    A batch that is replayed overwrites its own folder, so its rows are there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        postings_of(batch, text, keys).sortWithinPartitions("token").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_on_arrival(docs: DataFrame, checkpoint: str, rebuild: Callable[[], None]) -> StreamingQuery:
    """Rebuild and publish once for each batch that holds documents."""

    def run(batch: DataFrame, _: int) -> None:
        if batch.head(1):
            rebuild()

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_windows(events: DataFrame, at: str, key: str, width: str = "1 minute", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(key, start, n) by event time; rows later than the watermark are dropped by the engine, as streams must."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of runs of events no further apart than ``gap``."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
