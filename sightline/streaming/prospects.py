"""A stored table of prospects, brought up to date by micro-batches of events; a batch that runs twice changes nothing.

A store holds events/batch=n (what came, append-only) and state/n (the state after batch n, for the readers). Each state is a
table of its own, complete once Spark has marked it so; the two last ones stay. A batch rewrites the whole state: its rows are
prospects, not events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.operators import prospects

_KEPT = 2


def _complete(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the states that have been written whole, in order."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    found = hadoop.Path(f"{store}/state/*/_SUCCESS")
    marks = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found)
    return sorted(int(m.getPath().getParent().getName()) for m in marks or [])


def _drop(spark: SparkSession, store: str, number: int) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/state/{number}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def apply(batch: DataFrame, number: int, store: str) -> None:
    """Merges a batch of events (prospects.EVENT) into the store as state `number`; run again it writes the same."""
    spark = batch.sparkSession
    came = f"{store}/events/batch={number}"
    batch.write.mode("overwrite").parquet(came)
    states = prospects.partial(spark.read.schema(prospects.EVENT).parquet(came))
    before = [n for n in _complete(spark, store) if n < number]
    if before:
        states = spark.read.parquet(f"{store}/state/{before[-1]}").unionByName(states)
    prospects.merged(states).write.mode("overwrite").parquet(f"{store}/state/{number}")
    for n in before[: 1 - _KEPT]:
        _drop(spark, store, n)


def upsert(stream: DataFrame, store: str, checkpoint: str) -> None:
    """Applies all that has come of a stream of events, batch by batch, and ends; started again it goes on where it stopped."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: apply(batch, number, store)).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def state(spark: SparkSession, store: str) -> DataFrame:
    """The last state that is complete; an empty one if there is none."""
    numbers = _complete(spark, store)
    if not numbers:
        return prospects.merged(prospects.partial(spark.createDataFrame([], prospects.EVENT)))
    return spark.read.parquet(f"{store}/state/{numbers[-1]}")


def history(spark: SparkSession, store: str) -> DataFrame:
    """All events that came, with the number of their batch."""
    return spark.read.schema(f"{prospects.EVENT}, batch long").parquet(f"{store}/events")
