"""Streams: the latest text of each document, daily totals with late data, deliveries once each, and subscriptions merged batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.operators.dashboard import Subscriptions, latest_by
from lakesift.operators.delivery import SeenState, dedup_deliveries

DOCUMENT = "uri string, version bigint, text string"


def latest_documents(batch: DataFrame) -> DataFrame:
    """The latest version of each document in a batch; a null text closes it."""
    return latest_by(batch, "uri", F.col("version"))


def scan_stream(documents: DataFrame, scan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):  # noqa: ANN201
    """Scan each changed document once per micro-batch; results of a batch go to their own folder, so a batch run again replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        latest = latest_documents(batch)
        opened = latest.where("text is not null").select(F.col("uri").alias("path"), F.col("text").alias("source"), "version")
        scan(opened).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_totals(scans: DataFrame, late: str = "3 days") -> DataFrame:
    """Daily scans and findings of a stream of scans; a day is final once the watermark has passed it."""
    return (
        scans.withWatermark("created_at", late)
        .groupBy(F.window("created_at", "1 day"))
        .agg(F.count("*").alias("scans"), F.sum("findings_count").alias("findings"))
        .select(F.to_date("window.start").alias("day"), "scans", "findings")
    )


def distinct_deliveries(messages: DataFrame, state: SeenState, out: str, checkpoint: str, id_col: str = "id", order_col: str = "delivery_no"):  # noqa: ANN201
    """Keep one delivery of each identifier of a stream, however late its copies come; those without an identifier all stay.

    Each micro-batch is committed to ``state`` under its number, and its kept rows go to a folder of their own: a batch run again gets and writes what it did before.
    """

    def each(batch: DataFrame, number: int) -> None:
        kept, _ = dedup_deliveries(batch, id_col, order_col, state, f"stream {number}")
        kept.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_subscriptions(messages: DataFrame, table: Subscriptions, checkpoint: str):  # noqa: ANN201
    """Merge a stream of billing messages into the table of current subscriptions, batch by batch, each once."""
    each = lambda batch, number: table.load(batch, f"stream {number}")
    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
