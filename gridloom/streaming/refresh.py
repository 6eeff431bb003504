"""Readings as a stream: each micro-batch names the local days that it touches; these are worked out anew from the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.functions.windows import DAY, local


def refresh_days(
    stream: DataFrame,
    store: str,
    publish: Callable[[DataFrame, int], None],
    *,
    checkpoint: str,
    tz: str = "UTC",
    max_late: str = "2 days",
    once: bool = True,
) -> StreamingQuery:
    """``stream``: meter_id, ts_s, demand_kw. Appends to ``store`` (Parquet by local_date and batch_id) and hands the
    readings of all touched days to ``publish(df, batch_id)``. Readings later than ``max_late`` before the watermark are
    dropped; an empty batch publishes nothing. Only the folders of touched dates are listed and read, so that a batch
    costs the same however many came before it."""
    timed = stream.withColumn(
        "event_time", F.timestamp_seconds("ts_s")
    ).withWatermark("event_time", max_late).dropDuplicatesWithinWatermark(["meter_id", "ts_s"])

    def one(batch: DataFrame, batch_id: int) -> None:
        batch = local(batch.drop("event_time"), tz).withColumn("batch_id", F.lit(batch_id)).persist()
        try:
            # Dates, not (meter, date) pairs: there are no more than the calendar has.
            dates = [r[0].isoformat() for r in batch.select("local_date").distinct().collect()]
            if not dates:
                return
            # A batch that runs again replaces what it wrote.
            batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "local_date", "batch_id"
            ).parquet(store)
            touched = [f"{store}/local_date={d}" for d in dates]
            everything = batch.sparkSession.read.option("basePath", store).parquet(*touched)
            days = batch.select(*DAY).distinct()
            few = days.count() <= 500_000
            publish(everything.join(F.broadcast(days) if few else days, DAY, "left_semi"), batch_id)
        finally:
            batch.unpersist()

    writer = timed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
