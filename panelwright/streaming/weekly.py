"""Incremental variants: new part files and weekly counts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import week_start


def stream_parts(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    """File stream over part files; the checkpoint remembers which ones were processed."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(path)


def ingest_available(stream: DataFrame, target: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Append everything that is new and stop; running it again only handles newer files."""
    query = (
        stream.writeStream.format(fmt)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start(target)
    )
    query.awaitTermination()


def weekly_totals_available(stream: DataFrame, ts: str, keys: list[str], target: str, checkpoint: str) -> None:
    """Fold everything that is new into weekly counts and stop.

    Each micro-batch is reduced to its own weekly counts and appended under its batch id; a repeated batch
    after a failure overwrites its own folder, so totals stay exact. Readers sum over the batches.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(week_start(F.col(ts)).alias("week_start"), *keys).agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_weekly_totals(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """Weekly counts over all folded batches."""
    return spark.read.parquet(target).groupBy("week_start", *keys).agg(F.sum("n").alias("n"))


def weekly_counts_stream(events: DataFrame, ts: str, keys: list[str], late: str = "14 days") -> DataFrame:
    """Monday weeks as tumbling windows with a watermark: state is one row per open week and key.

    Windows are counted from a Thursday, hence the offset of four days.
    """
    week = F.window(F.col(ts), "7 days", "7 days", "4 days")
    counted = events.withWatermark(ts, late).groupBy(week, *keys).agg(F.count("*").alias("n"))
    return counted.select(F.to_date("window.start").alias("week_start"), *keys, "n")
