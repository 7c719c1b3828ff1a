"""Change detection as a stream: each page's last snapshot is state, and a new one is judged against it as it comes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sightline.functions import urls as ux
from sightline.operators import drift

#: Snapshots of findings: a page's number, address and time, and what is compared.
SNAPSHOT = "id long, url string, ts timestamp, status_code int, title string, meta_description string, canonical string, robots string, h1 string, h2 array<string>, schema_types array<string>, schema_hash string, og map<string,string>, html_hash string, metrics map<string,double>, perf_score double"
_PAYLOAD = ", ".join(f for f in SNAPSHOT.split(", ") if f.split()[0] in drift.COLUMNS)
_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
PAIR = "url_hash string, id long, snapshot_id long, old string, new string"


class LastSnapshot(StatefulProcessor):
    """Holds a page's last snapshot and gives (url_hash, id, snapshot_id, old, new) for each that follows it.

    Rows of a page are taken by id within what comes at once; one whose id isn't over the last one's is late and goes.
    With `days`, an event-time timer ends a page's state so many days after its last snapshot (new is null in the row
    that says so); with `ttl_ms`, the state store forgets it after that time of the clock, without a row.
    """

    def __init__(self, days: float | None = None, ttl_ms: int | None = None) -> None:
        self.days, self.ttl = days, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "id long, seen long, payload string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        now = pd.concat(list(rows)).sort_values("id", kind="stable")
        out, timed = [], None if held is None else held[1]
        for number, seen, payload in zip(now["id"].tolist(), now["seen"].tolist(), now["payload"].tolist()):
            if held is not None and number <= held[0]:
                continue
            if held is not None:
                out.append((key[0], held[0], number, held[2], payload))
            held = (number, max(seen, held[1]) if held is not None else seen, payload)
        if held is not None:
            self.last.update(held)
            if self.days is not None and held[1] != timed:
                if timed is not None:
                    self.handle.deleteTimer(self._end(timed))
                self.handle.registerTimer(self._end(held[1]))
        yield pd.DataFrame(out, columns=["url_hash", "id", "snapshot_id", "old", "new"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        out = []
        if held is not None and self._end(held[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], held[0], None, held[2], None))
            self.last.clear()
        yield pd.DataFrame(out, columns=["url_hash", "id", "snapshot_id", "old", "new"]).astype({"snapshot_id": "Int64"})

    def close(self) -> None:
        pass

    def _end(self, seen: int) -> int:
        return int(seen + self.days * 86_400_000)


def pairs(snapshots: DataFrame, late: str = "1 hour", days: float | None = None, ttl_ms: int | None = None) -> DataFrame:
    """A stream of snapshots (SNAPSHOT) -> (url_hash, id, snapshot_id, old, new): neighbours of one page, as JSON.

    Snapshots without an address are of no page.
    One page's rows of a micro-batch are held together: bound what a trigger takes (maxFilesPerTrigger and the like).
    """
    rows = snapshots.withWatermark("ts", late).select(ux.url_hash(F.col("url")).alias("url_hash"), "id", "ts", F.unix_millis("ts").alias("seen"), F.to_json(F.struct(*drift.COLUMNS)).alias("payload")).where("url_hash is not null")
    mode = "ProcessingTime" if ttl_ms is not None else "EventTime"
    return rows.groupBy("url_hash").transformWithStateInPandas(LastSnapshot(days, ttl_ms), PAIR, "Append", mode)


def findings(found: DataFrame) -> DataFrame:
    """pairs() -> (url_hash, baseline_id, snapshot_id, rule, severity, triggered), as drift.replayed() has them."""
    both = found.where("new is not null").select("url_hash", "id", "snapshot_id", F.from_json("old", _PAYLOAD).alias("o"), F.from_json("new", _PAYLOAD).alias("n"))
    both = both.select("url_hash", "id", "snapshot_id", *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "on" for c in drift.COLUMNS])
    return drift.judged(both, "snapshot_id")


def unseen(found: DataFrame) -> DataFrame:
    """pairs() -> (url_hash, last_id): pages whose state has ended, as no snapshot of theirs came for long enough."""
    return found.where("new is null").select("url_hash", F.col("id").alias("last_id"))


@contextmanager
def _state_store(spark: SparkSession):
    """The state store that such operators need, for queries that start within; the session is then as it was."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    try:
        for k, v in _STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(stream: DataFrame, path: str, checkpoint: str, clock: bool = False) -> None:
    """Writes all that has come of a stream of appended rows to a Parquet table, and ends. Started again with the same checkpoint
    it goes on where it stopped, its state included. clock: the stream's state goes by the time of the clock (ttl_ms),
    so batches never end by themselves and it is stopped when nothing new is left."""
    with _state_store(stream.sparkSession):
        writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        query = (writer if clock else writer.trigger(availableNow=True)).start(path)
        if clock:
            # the first batch may be one that a stop cut off, with what had come by then; later ones look for what is new
            first = None
            while query.isActive:
                now = query.lastProgress
                first = now["batchId"] if first is None and now is not None else first
                if now is not None and now["batchId"] > first and not now["numInputRows"]:
                    break
                query.awaitTermination(1)
            if query.isActive:
                query.stop()
        query.awaitTermination()
