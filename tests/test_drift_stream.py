"""The drift stream: replay equals the batch rules, over restarts; late rows, ends of state, odd snapshots."""

import pytest
from pyspark.sql import functions as F

from sightline.operators import drift as batch
from sightline.plans.stream_queries import snapshots
from sightline.streaming import drift, windows

KEYS = ["url_hash", "baseline_id", "snapshot_id", "rule", "severity", "triggered"]


@pytest.fixture(autouse=True)
def one_partition(spark):
    """Each partition of each micro-batch starts a worker of its own; these tables have a few rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows(df):
    return sorted(tuple(r[k] for k in KEYS) for r in df.select(*KEYS).collect())


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet")


def put(df, folder, name):
    """One file of a stream's folder."""
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_replay_with_restarts_equals_the_batch(spark, events, tmp_path):
    """Four runs over one checkpoint, two files a trigger: state is there again after each restart."""
    made = snapshots(events)
    stream = windows.table_stream(spark, str(tmp_path / "in"), drift.SNAPSHOT, maxFilesPerTrigger=2, recursiveFileLookup=True)
    every = sorted(r.id for r in made.select("id").collect())
    cuts = [every[len(every) * k // 8] for k in range(8)] + [every[-1] + 1]
    for k in range(4):
        for j in (2 * k, 2 * k + 1):
            put(made.where(F.col("id").between(cuts[j], cuts[j + 1] - 1)), tmp_path / "in", f"part-{j}")
        drift.run(drift.findings(drift.pairs(stream)), str(tmp_path / "out"), str(tmp_path / "state"))
    got = rows(spark.read.parquet(str(tmp_path / "out")))
    want = rows(batch.replayed(made))
    assert got == want and any(r[-1] for r in got)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_replayed_agrees_with_findings_of_the_latest_baseline(spark, events):
    made = snapshots(events)
    last = made.groupBy(F.substring_index("url", "?", 1).alias("u")).agg(F.max("id").alias("id")).select("id")
    current = made.join(last, "id")
    want = batch.findings(current, made.join(last, "id", "left_anti"))
    got = batch.replayed(made).join(last.withColumnRenamed("id", "snapshot_id"), "snapshot_id")
    cut = lambda df: sorted(map(tuple, df.select("url_hash", "baseline_id", "rule", "severity", "triggered").collect()))
    assert cut(got) == cut(want) and want.count() > 0


def _snapshot(spark, rows):
    """rows(id, url, day, title): the rest is null."""
    named = spark.createDataFrame(rows, "id long, url string, day int, title string")
    made = named.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("day") * 86_400))
    for f in drift.SNAPSHOT.split(", "):
        name, kind = f.split(" ", 1)
        if name not in made.columns:
            made = made.withColumn(name, F.lit(None).cast(kind))
    return made.select(*[f.split()[0] for f in drift.SNAPSHOT.split(", ")])


def test_late_rows_and_ends_of_state(spark, tmp_path):
    """An older number that comes later goes; a page's state ends ten days after its last snapshot, and a row says so."""
    stream = windows.table_stream(spark, str(tmp_path / "in"), drift.SNAPSHOT, maxFilesPerTrigger=1, recursiveFileLookup=True)
    parts = [
        [(5, "https://a.example/x", 0, "one"), (6, "https://A.example:443/x/?utm_source=q", 1, None), (7, "https://b.example/", 0, "b")],
        [(4, "https://a.example/x", 2, "late"), (9, "https://a.example/x#top", 3, "two"), (8, None, 3, "no address")],
        [(20, "https://c.example/", 12, "c")],  # b has ended, a has not
        [(21, "https://b.example/", 14, "b again"), (22, "https://a.example/x", 15, "three")],
        [(30, "https://c.example/", 60, "c two")],
    ]
    for k, part in enumerate(parts):
        put(_snapshot(spark, part), tmp_path / "in", f"part-{k}")
        drift.run(drift.pairs(stream, late="0 seconds", days=10), str(tmp_path / "out"), str(tmp_path / "state"))
    found = spark.read.parquet(str(tmp_path / "out"))
    pairs = {(r.id, r.snapshot_id) for r in found.where("new is not null").collect()}
    assert pairs == {(5, 6), (6, 9), (9, 22), (20, 30)}
    assert sorted(r.last_id for r in drift.unseen(found).collect()) == [7, 21, 22]
    triggered = {(r.baseline_id, r.snapshot_id, r.rule) for r in drift.findings(found).where("triggered").collect()}
    assert (5, 6, "title_removed") in triggered and (6, 9, "title_changed") not in triggered


def test_state_with_a_time_to_live(spark, tmp_path):
    stream = windows.table_stream(spark, str(tmp_path / "in"), drift.SNAPSHOT, recursiveFileLookup=True)
    for k, number in enumerate((1, 2)):
        put(_snapshot(spark, [(number, "https://a.example/", 0, str(number))]), tmp_path / "in", f"part-{k}")
        drift.run(drift.pairs(stream, ttl_ms=3_600_000), str(tmp_path / "out"), str(tmp_path / "state"), clock=True)
    assert [(r.id, r.snapshot_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 2)]


def test_a_batch_that_a_stop_cut_off_comes_before_what_is_new(spark, tmp_path):
    """The last batch of the first run, which had no rows, has no commit: it runs again before the second file's."""
    stream = windows.table_stream(spark, str(tmp_path / "in"), drift.SNAPSHOT, recursiveFileLookup=True)
    commits = tmp_path / "state" / "commits"
    for number in (1, 2):
        put(_snapshot(spark, [(number, "https://a.example/", 0, str(number))]), tmp_path / "in", f"part-{number}")
        if number == 2:
            done = [int(f.name) for f in commits.iterdir() if f.name.isdigit()]
            assert max(done) > 0
            for f in (commits / str(max(done)), commits / f".{max(done)}.crc"):
                f.unlink(missing_ok=True)
            for later in (tmp_path / "state" / "offsets").iterdir():
                if later.name.strip(".").removesuffix(".crc").isdigit() and int(later.name.strip(".").removesuffix(".crc")) > max(done):
                    later.unlink()
        drift.run(drift.pairs(stream, ttl_ms=3_600_000), str(tmp_path / "out"), str(tmp_path / "state"), clock=True)
    assert [(r.id, r.snapshot_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 2)]


def test_replayed_of_nothing(spark, events):
    assert batch.replayed(snapshots(events.limit(0))).count() == 0
