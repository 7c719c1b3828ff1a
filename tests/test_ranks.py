"""Rank files: whole and cut reads, members and torn ends, matches that end a scan, filters in the reader."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from sightline.sources import ranks


def line(rank, host):
    return f"{rank}\t{rank * 0.5}\t{rank + 1}\t0.25\t{host}\n"


@pytest.fixture
def folder(tmp_path):
    """Three files: ordinary lines with odd ones among them, two gzip members, and one whose end is torn."""
    noise = [line(k, f"com.site{k * 7919 % 100003}x{os.urandom(12).hex()}") for k in range(30000)]
    (tmp_path / "a.gz").write_bytes(gzip.compress(("#harmonic\thost\n\n" + line(0, "com.example") + "".join(noise) + "x\ty\n" + "7\tz\t\tbad\tcom.example.shop\n" + line(30001, "org.com.example").rstrip()).encode()))
    (tmp_path / "b.gz").write_bytes(gzip.compress("".join(line(k, "com.example") for k in range(8)).encode()) + gzip.compress("".join(line(k, "a.com.example") for k in range(8, 25)).encode()))
    (tmp_path / "c.gz").write_bytes(gzip.compress("".join(noise).encode())[:200_000])
    (tmp_path / "_SUCCESS").write_bytes(b"")
    (tmp_path / "d.gz").write_bytes(gzip.compress(b""))
    return str(tmp_path)


def by_name(df):
    return {os.path.basename(r.file): r for r in df.collect()}


def test_scans_read_whole_files(spark, folder):
    got = by_name(ranks.scans(spark, folder, " WWW.example.com"))
    assert [(m.harmonic_rank, m.host_reversed) for m in got["a.gz"].matches] == [(0.0, "com.example"), (30001.0, "org.com.example")]
    assert [m.harmonic_rank for m in got["b.gz"].matches] == list(range(10)) and got["b.gz"].matches[9].host_reversed == "a.com.example"
    assert got["c.gz"].matches == [] and got["d.gz"].matches == [] and len(got) == 4
    assert not any(r.truncated_scan for r in got.values())
    assert all(r.bytes == os.path.getsize(f"{folder}/{n}") for n, r in got.items() if n in "a.gz c.gz")


def test_a_budget_cuts_what_follows(spark, folder):
    size = os.path.getsize(f"{folder}/a.gz")
    got = by_name(ranks.scans(spark, f"{folder}/a.gz", "example.com", max_bytes=size // 2))["a.gz"]
    assert [m.harmonic_rank for m in got.matches] == [0.0] and got.truncated_scan and got.bytes == size // 2
    exact = by_name(ranks.scans(spark, f"file://{folder}/a.gz", "example.com", max_bytes=size))["a.gz"]
    assert len(exact.matches) == 2 and exact.truncated_scan
    none = by_name(ranks.scans(spark, f"{folder}/a.gz", "example.com", max_bytes=0))["a.gz"]
    assert none.matches == [] and none.truncated_scan and none.bytes == 0
    early = by_name(ranks.scans(spark, f"{folder}/a.gz", "example.com", max_matches=1))["a.gz"]
    assert len(early.matches) == 1 and early.bytes < size and not early.truncated_scan


def test_rows_and_pushed_filters(spark, folder):
    """The same rows with filters in the reader as with filters in Spark, and the reader keeps none of them back."""
    conf = "spark.sql.python.filterPushdown.enabled"
    table = lambda: ranks.rows(spark, folder).select("file", "harmonic_rank", "harmonic_value", "pagerank_rank", "host_reversed", "truncated_scan")
    tests = [F.col("host_reversed") == "com.example", F.col("host_reversed").isin("com.example", "a.com.example"), F.col("host_reversed").startswith("com.ex") & (F.col("harmonic_rank") < 5), F.col("host_reversed").endswith(".shop"), F.col("host_reversed").isNull()]
    before = spark.conf.get(conf)
    try:
        for test in tests:
            out = []
            for on in ("false", "true"):
                spark.conf.set(conf, on)
                out.append(sorted(map(str, table().where(test).collect())))
            assert out[0] == out[1] and out[0]
        plan = table().where(tests[0])._jdf.queryExecution().executedPlan().toString()
        assert "Filter (" not in plan
        spark.conf.set(conf, "false")
        assert "Filter (" in table().where(tests[0])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(conf, before)
    assert ranks.rows(spark, folder).where("host_reversed is null").count() == 1
    bad = ranks.rows(spark, folder).where("host_reversed = 'com.example.shop'").collect()[0]
    assert (bad.harmonic_rank, bad.harmonic_value, bad.pagerank_rank, bad.pagerank_value) == (7.0, None, None, None)


def test_written_ranks_are_read_again(spark, tmp_path):
    made = spark.range(1000).selectExpr("cast(id as double) harmonic_rank", "id * 0.5D harmonic_value", "cast(999 - id as double) pagerank_rank", "0.25D pagerank_value", "concat('com.h', id) host_reversed")
    ranks.write(made, str(tmp_path / "r"), 3)
    back = ranks.rows(spark, str(tmp_path / "r"))
    assert back.select("file").distinct().count() == 3
    assert back.drop("file", "truncated_scan").exceptAll(made).count() == 0 and back.count() == 1000


def test_what_is_missing_or_out_of_range(spark, tmp_path):
    with pytest.raises(Exception, match="none"):
        ranks.rows(spark, str(tmp_path / "none")).count()
    with pytest.raises(Exception, match="maxMatches"):
        ranks.scans(spark, str(tmp_path), "a.example", max_matches=0).count()
    (tmp_path / "empty").mkdir()
    assert ranks.rows(spark, str(tmp_path / "empty")).count() == 0
