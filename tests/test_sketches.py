"""Sketches of days merged into weeks and months, against exact counts and ranks."""

import datetime
import random

from pyspark.sql import functions as F

from sightline.operators import sketches


def test_merged_days_are_within_their_errors(spark):
    rows = spark.range(120_000).selectExpr("id % 2 as k", "timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id % 28 as int)) as ts", "pmod(xxhash64(id), 40000) as user", "case when id % 10 > 0 then cast(pmod(xxhash64(id, 1), 100000) as double) end as v")
    days = sketches.daily(rows, ["k"], "ts", "user", "v")
    held = sketches.merged(days, ["k"], "month").select("k", "n", F.theta_sketch_estimate("ids").alias("theta"), F.hll_sketch_estimate("counter").alias("hll"), *[sketches.quantile(F.col("quantiles"), q).alias(f"q{int(q * 100)}") for q in (0.1, 0.5, 0.9)])
    exact = {r.k: r for r in rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user").alias("u"), F.count("v").alias("m")).collect()}
    for r in held.collect():
        assert r.n == exact[r.k].n
        assert abs(r.theta / exact[r.k].u - 1) < 0.06 and abs(r.hll / exact[r.k].u - 1) < 0.06
        for q in (0.1, 0.5, 0.9):
            rank = rows.where((F.col("k") == r.k) & (F.col("v") <= r[f"q{int(q * 100)}"])).count() / exact[r.k].m
            assert abs(rank - q) < 0.04


def test_returning_is_exact_for_small_sets(spark):
    draw = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = [(draw.choice(["a", "b", None]), start + datetime.timedelta(days=draw.choice([0, 3, 6, 7, 13, 21, 24])), draw.choice([None, *range(300)]), None) for _ in range(2000)]
    table = spark.createDataFrame(rows, "k string, ts timestamp, user long, v double").where("k is not null")
    days = sketches.daily(table, ["k"], "ts", "user", "v")
    periods = sketches.merged(days.unionByName(days.where("dayofmonth(day) = 1").withColumn("n", F.lit(0).cast("long"))), ["k"])  # a day that comes again changes nothing
    seen = {}
    for k, ts, user, _ in rows:
        if k:
            seen.setdefault((k, (ts - start).days // 7), []).append(user)
    want = {}
    for (k, w), users in seen.items():
        now, then = set(users) - {None}, set(seen.get((k, w - 1), [])) - {None}
        want[k, (start + datetime.timedelta(weeks=w)).date()] = (len(users), len(now), len(now & then), len(now - then))
    assert {(r.k, r.period): tuple(r)[2:] for r in sketches.returning(periods, ["k"]).collect()} == want
    assert {r.q for r in periods.select(sketches.quantile(F.col("quantiles"), 0.5).alias("q")).collect()} == {None}
    assert sketches.returning(sketches.merged(days.limit(0), ["k"]), ["k"]).count() == 0


def test_returning_is_exact_for_large_sets(spark):
    start = "timestamp '2024-01-01' + make_interval(0, 0, 0, cast(week * 7 as int))"
    rows = spark.range(40_000).selectExpr("id % 4 as week", "if(id % 4 = 3, id % 100, id % 9001) as user", "'a' as k", "1.0D as v").selectExpr("k", "user", "v", f"{start} as ts", "week")
    periods = sketches.merged(sketches.daily(rows, ["k"], "ts", "user", "v"), ["k"])
    got = {(r.period.day - 1) // 7: tuple(r)[2:] for r in sketches.returning(periods, ["k"], exact=sketches.ids(rows, ["k"], "ts", "user")).collect()}
    users = [{i % 100 if i % 4 == 3 else i % 9001 for i in range(w, 40_000, 4)} for w in range(4)]
    before = [set(), *users]
    assert got == {w: (10_000, len(u), len(u & b), len(u - b)) for w, (u, b) in enumerate(zip(users, before))}
