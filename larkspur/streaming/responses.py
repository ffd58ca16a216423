"""Batch answers that arrive as files, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur import schemas


def answers(spark: SparkSession, folder: str, hours: int = 24) -> DataFrame:
    """custom_id, content, arrived of answered requests in files that come into the folder; each id once.

    Ids are remembered as long as a batch may take: after that the watermark lets their state go.
    """
    rows = spark.readStream.schema(schemas.BATCH_RESPONSE).json(folder)
    content = F.get(F.col("response.body.choices"), F.lit(0))["message"]["content"]
    rows = rows.select("custom_id", content.alias("content"), F.current_timestamp().alias("arrived")).filter(F.coalesce("content", F.lit("")) != "")
    return rows.withWatermark("arrived", f"{hours} hours").dropDuplicatesWithinWatermark(["custom_id"])


def land(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has come to a parquet folder, exactly once, and ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
