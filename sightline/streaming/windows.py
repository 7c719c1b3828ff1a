"""Event streams: windows, sessions and running sums with watermarks. Each also takes a batch table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def replay(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, so many at a time; ts as a timestamp, as watermarks need it."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def table_stream(spark: SparkSession, path: str, schema: str, **options: object) -> DataFrame:
    """A stream of the Parquet file or folder at path, which only a pattern may name if it can be either."""
    return spark.readStream.schema(schema).options(**options).parquet(f"{path[:-1]}[{path[-1]}]")


def counts(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events and their value's sum for each window and type; tumbling without slide. Rows later than `late` go."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    per = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return per.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Each user's sessions: events with less than `gap` between neighbours."""
    per = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_each(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key's first row within the watermark; a row repeated later than that counts again."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def spend_so_far(ledger: DataFrame) -> DataFrame:
    """ledger(endpoint, cost) -> endpoint, calls, cost, updated as rows come."""
    return ledger.groupBy("endpoint").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost").alias("cost"))
