"""Streams that the built-in operators express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafvoice.operators.sentences import Books, build_chapters


def latest_position(progress: DataFrame, key: str = "book_id") -> DataFrame:
    """The last write per key, for update or complete mode. Partial maxima are merged before the exchange."""
    rest = [c for c in progress.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct("updated_at", "event_id")).alias("_row")
    return progress.groupBy(key).agg(last).select(key, "_row.*")


def furthest_position(boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """Position per utterance, only ever forward; update mode."""
    return boundaries.groupBy(*keys).agg(F.max("reported").alias("position"), F.max("ts").alias("ts"))


def listening_sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Sessions of activity per reader: events, furthest position, first and last moment."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy("session_id", F.session_window("ts", gap))
        .agg(
            F.count("*").alias("events"), F.count_if(F.col("kind") == "play").alias("plays"),
            F.max("position").alias("furthest"),
        )
        .select("session_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"),
                "events", "plays", "furthest")
    )


def incremental_chapters(runs: DataFrame, sink: Callable[[Books, int], None], checkpoint: str, **options):
    """Build chapters for the documents of each micro-batch and hand them to ``sink(books, batch_id)``.
    A document arrives whole: partition the runs by document when writing them, so that each is in one
    file. ``sink`` must be idempotent per batch."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if not batch.limit(1).isEmpty():
            sink(build_chapters(batch, **options), batch_id)

    return runs.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
