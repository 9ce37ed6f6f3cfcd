"""Monitors over event streams. Each takes a streaming (or batch) frame; run() drains a stream into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.scratch import scratch
from tracemill.functions.shipping import ship
from tracemill.operators.ordered import MOST_ROWS, running_count


def event_stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """A stream over Parquet files of events; ts becomes a timestamp, as watermarks need one."""
    ship(spark)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, name: str, mode: str = "append", place: str | None = None) -> DataFrame:
    """Processes what there is and reads the result; its rows, place and state are in the shared folder.

    A later call with the same place goes on behind what earlier ones have processed, as after a restart.
    """
    spark = stream.sparkSession
    place = place or scratch(spark, name)
    out = f"{place}/rows"
    writer = stream.writeStream.option("checkpointLocation", f"{place}/offsets").outputMode(mode).trigger(availableNow=True)
    if mode == "complete":
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    else:
        query = writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their mean value by window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Closed sessions of each user: start, end of the last gap, events."""
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return by.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def first_of_hour(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Distinct (user, type, hour); state older than the watermark is dropped."""
    hours = events.withColumn("hour", F.date_trunc("hour", "ts")).withWatermark("hour", late)
    return hours.dropDuplicates(["user_id", "event_type", "hour"]).select("user_id", "event_type", F.unix_seconds("hour").alias("hour"))


def bands(events: DataFrame, group: str, order: str, budget: int, shares: tuple[float, ...] = (0.8, 1.0, 1.5), most_rows: int = MOST_ROWS) -> DataFrame:
    """Rows at which a group's running count first reaches each share of its budget."""
    marks = [(s, -(-int(s * budget * 1000) // 1000)) for s in shares]
    out = running_count(events, "n", [group], [order], most_rows).filter(F.col("n").isin([m for _, m in marks]))
    share = F.coalesce(*[F.when(F.col("n") == m, F.lit(s)) for s, m in marks])
    return out.select(group, order, "n", share.alias("band"))


