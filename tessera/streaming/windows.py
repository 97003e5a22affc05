"""Structured Streaming counterparts; an extension that the surveyed system lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from ..sources.tables import table


def events_stream(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """The events table as a stream with a watermark on its time."""
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/events*.parquet").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)


def final_state(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and give the last state of its result."""
    spark = stream.sparkSession
    base, done = new_path(spark), set()

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out-{number}")  # a batch that runs again replaces itself
        done.add(number)

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(store).trigger(availableNow=True).start()
    run.awaitTermination()
    kept = [f"{base}/out-{n}" for n in (sorted(done)[-1:] if mode == "complete" else sorted(done))]
    return spark.read.schema(stream.schema).parquet(*kept) if kept else spark.createDataFrame([], stream.schema)


def windowed(stream: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """type, start, n, total in tumbling or sliding windows."""
    w = F.window("at", size, slide) if slide else F.window("at", size)
    sums = stream.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.select("event_type", F.col("w.start").alias("start"), "n", "total")


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    """user_id, start, n of runs of events with gaps shorter than given."""
    found = stream.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), "n")
