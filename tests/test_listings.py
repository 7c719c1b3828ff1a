"""Linking by name, address and phone against brute force; odd rows."""

import random

from pyspark.sql import functions as F

from sightline.operators import listings


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_within_one_edit_is_brute_force(spark):
    """Short alphabets and lengths, so that each kind of edit at each place occurs, under a key that most rows share."""
    draw = random.Random(2)
    text = lambda: "".join(draw.choice("abé") for _ in range(draw.randrange(1, 7))) if draw.random() > 0.05 else None
    a = [(i, draw.choice(["k", "k", "k", "j", None]), text()) for i in range(150)]
    b = [(i, draw.choice(["k", "k", "k", "j", None]), text()) for i in range(150)]
    want = {(i, j) for i, s, x in a for j, t, y in b if s and s == t and x and y and edits(x, y) <= 1}
    got = [tuple(r) for r in listings.within_one_edit(spark.createDataFrame(a, "a int, same string, text string"), spark.createDataFrame(b, "b int, same string, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_compared_and_consistency_of_odd_rows(spark):
    own = spark.createDataFrame([(1, "Acme, Inc.", "1 North Road", "+49 (30) 123-4567"), (2, "Beta", None, None), (3, None, "", "12")], "business int, name string, address string, phone string").withColumn("platform", F.lit("x"))
    rows = [(10, "maps", "ACME", "1 n. rd", "030 1234567"), (11, "maps", "Acne", "2 N Rd", "0301234567"), (12, "osm", "Other", "1 N Rd", "0049301234567"), (13, "osm", "beta gmbh", "x", None), (14, "osm", None, None, None), (15, "bing", "Acme store", "1 N Rd", "99")]
    made = spark.createDataFrame(rows, "listing int, platform string, name string, address string, phone string").withColumn("business", F.lit(0))
    got = {(r.business, r.listing): (r.name, r.address, r.phone, r.issues) for r in listings.compared(own, made).collect()}
    assert got == {(1, 10): ("exact", "exact", "exact", []), (1, 11): ("partial", "partial", "exact", []), (1, 12): ("conflicting", "exact", "exact", ["Critical: name"])}
    out = {r.business: (r.listings, r.share, r.unclaimed) for r in listings.consistency(listings.compared(own, made), own, ["maps", "bing", "osm"]).collect()}
    assert out == {1: (3, 6 / 9, ["bing"]), 2: (0, None, ["maps", "bing", "osm"]), 3: (0, None, ["maps", "bing", "osm"])}
    assert listings.compared(own.limit(0), made).count() == 0 and listings.linked(own, made.limit(0)).count() == 0


def test_links_without_and_with_keys_are_the_same_and_plans_are_small(spark):
    """Plans of the links once held each normal form some hundred times, too many for a small driver."""
    draw = random.Random(3)
    text = lambda: "".join(draw.choice("ab\U0001f600") for _ in range(draw.randrange(0, 6)))
    a, b = ([(i, draw.choice("kj"), text()) for i in range(90)] for _ in range(2))
    left, right = spark.createDataFrame(a, "a int, same string, text string"), spark.createDataFrame(b, "b int, same string, text string")
    all_, keyed = ({tuple(r) for r in listings.within_one_edit(left, right, few).collect()} for few in (1000, 0))
    assert all_ == keyed and len(all_) > 100
    own = spark.createDataFrame([(1, "Acme", "1 North Road", "1")], "business int, name string, address string, phone string")
    plan = listings.compared(own, own.selectExpr("business as listing", "name", "address", "phone", "'x' as platform"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") + plan.count("split(") == 0 and plan.count("Join") == 2
