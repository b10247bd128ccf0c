"""Pending variants as a stream: what arrives is annotated or indexed once, and windows over arriving events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType, files_each: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def settle(rows: DataFrame, key: str, time: str, delay: str, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Work on each key once, as far back as delay, and append to the table at out; a batch that runs again overwrites its own part."""
    fresh = rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return fresh.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(rows: DataFrame, time: str, width: str, delay: str, by: str) -> DataFrame:
    """Counts by tumbling window and value; late rows count as long as the watermark has not passed."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
