"""Incremental ingest: new files only, with the progress in a checkpoint instead of a set of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeprint import schemas
from codeprint.functions.pycode import code_status_udf


def validated_samples(spark: SparkSession, landing: str) -> DataFrame:
    """A stream of the samples landed as JSON lines, with their code_status."""
    return spark.readStream.schema(schemas.SAMPLE).json(landing).withColumn("code_status", code_status_udf("code"))


def ingest_available(spark: SparkSession, landing: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the valid samples of all new files to ``target``, once each, and stop."""
    rows = validated_samples(spark, landing).where("code_status = 'ok'").drop("code_status")
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows of each window and key; on a stream, rows later than ``late`` are left out."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, width)
    return rows.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
