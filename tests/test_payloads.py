"""Payloads of every shape, null stripping against plain recursion, key order, and generated blocks against the validator."""

import json
import random

from pyspark.sql import functions as F

from sightline.operators import jsonld, rules
from sightline.sources import envelopes


def stripped(v):
    if isinstance(v, dict):
        return {k: stripped(x) for k, x in v.items() if x is not None}
    return [stripped(x) for x in v] if isinstance(v, list) else v


def value(draw, depth):
    kind = draw.randrange(9 if depth else 6)
    if kind >= 6:
        n = draw.randrange(4)
        return {key(draw): value(draw, depth - 1) for _ in range(n)} if kind < 8 else [value(draw, depth - 1) for _ in range(n)]
    return [None, None, True, draw.randrange(99), 1.5, key(draw)][kind]


def key(draw):
    return "".join(draw.choice(['"', "\\", ",", ":", "null", '":null', "{", "}", '","a":null', "x", "é", "\n", " ", "\\\""]) for _ in range(draw.randrange(4)))


def test_without_nulls_is_plain_recursion(spark):
    draw = random.Random(1)
    values = [value(draw, 6) for _ in range(400)] + [{"a": None}, {"a": {"b": None}}, [None, {"a": None}], None, {"a\\": None, "b": "null"}]
    deep = None
    for i in range(200):
        deep = {"k": deep, "n": None, "v": i}
    texts = [json.dumps(v, ensure_ascii=bool(i % 2), separators=(",", ":") if i % 3 else (" , ", " : ")) for i, v in enumerate(values + [deep])] + ["{" + ",".join(f'"{i}":null' for i in range(100_000)) + '}', '{"a":"' + "\\\\" * 200_000 + '","b":null}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.s for r in df.select("i", envelopes.without_nulls(F.col("t")).alias("s")).orderBy("i").collect()]
    assert [json.loads(g) for g in got] == [stripped(json.loads(t)) for t in texts]
    assert spark.range(1).select(envelopes.without_nulls(F.lit(None).cast("string")).alias("s")).first().s is None


def test_items_of_odd_payloads(spark):
    rows = ['{"tasks":[{"result":[{"items":[{"title":"a"},null,7]},{"title":"b","items":{}},null]},{"result":{}},{},null]}', '[{"title":"c"},[1],"x"]', '{"title":"d","tasks":{}}', "[]", "5", "null", '"t"', "{", "", None, '{"tasks":null,"title":null,"link":"u"}']
    df = spark.createDataFrame(list(enumerate(rows)), "file int, payload string").withColumns({"note": F.lit("n")})
    got = [(r.file, r.pos, r.title, r.url, r.note) for r in envelopes.written(envelopes.normalized(df, "serp")).orderBy("file", "pos").collect()]
    none = lambda f, n: [(f, i, None, None, "n") for i in range(n)]
    want = [(0, 0, '"a"', None, "n"), *none(0, 3)[1:], (0, 3, '"b"', None, "n"), (0, 4, None, None, "n"), (1, 0, '"c"', None, "n"), *none(1, 3)[1:], (2, 0, '"d"', None, "n"), *none(4, 1), *none(5, 1), *none(6, 1), (10, 0, None, '"u"', "n")]
    assert got == want
    assert [r.item for r in envelopes.written(envelopes.normalized(df.where("file = 1"), "other")).collect()] == ['{"title":"c"}', "[1]", '"x"']
    one = {r.file: (r.status_code, r.cost_usd, r.row_count) for r in envelopes.envelopes(df).collect()}
    assert one[0] == (None, 0.0, 5) and one[3] == (None, 0.0, 0) and one[7] == (None, 0.0, 0) and one[10] == (None, 0.0, 1)
    costs = spark.createDataFrame([('{"status_code":200.5,"tasks":[{"cost":1},{"cost":"2"},{"cost":0.25},{}]}',)], "payload string")
    assert envelopes.envelopes(costs).first() == (None, 1.25, 0)
    assert envelopes.normalized(df.limit(0), "onpage").count() == 0


def test_keys_in_first_seen_order(spark):
    rows = [(2, '{"b":1,"c":null}'), (1, '{"z":1,"b":{"q":1}}'), (None, '{"a":1,"y":2}'), (3, "[1]"), (4, None), (5, "{"), (1, '{"z":1,"b":2}')]
    got = envelopes.key_union(spark.createDataFrame(rows, "o int, json string"), "o").orderBy("position").collect()
    assert [(r.position, r.key) for r in got] == [(0, "z"), (1, "b"), (2, "c"), (3, "a"), (4, "y")]
    assert envelopes.key_union(spark.createDataFrame([], "o int, json string"), "o").count() == 0


FULL = {
    "reservation": "'FoodEstablishmentReservation' as reservation_kind, 'P' as provider, 'S' as start, 4 as party_size, 'C' as customer_name",
    "order": "'N' as name, 'https://o.example/{x}' as order_url, 'M' as merchant, array('Cash', 'Card') as accepted_payment_method",
    "discussion": "'H' as headline, 'A' as author, '2024-01-01' as date, 'https://d.example/' as url, 'T' as text, 7 as likes",
    "profile": "'N' as name, 'https://p.example/' as url, 'W' as works_for, array('https://s.example') as same_as, array('x') as knows_about",
    "organization": "'N' as name, 'https://o.example/' as url, 'T' as telephone, array('https://s.example') as same_as",
    "local_business": "'LocalBusiness' as business_type, 'N' as name, 'https://l.example/' as url, '1 Road' as street, 1.5 as latitude, 2.5 as longitude, array('Mo-Fr') as hours",
}


def test_generated_blocks_pass_the_validator(spark):
    for kind, columns in FULL.items():
        page = jsonld.generated(spark.sql(f"select 'https://u.example/' as page, {columns}"), kind, script_tag=True).select(F.col("page").alias("url"), F.concat(F.lit("<html>"), "json").alias("html"))
        blocks = rules.jsonld_blocks(page)
        assert blocks.count() == 1, kind
        errors = [tuple(r) for r in rules.jsonld_issues(blocks).where("severity = 'error'").collect()]
        assert errors == [], kind
        block = json.loads(blocks.first().json)
        assert block == stripped(block) and block["@context"] == "https://schema.org"


def test_generated_without_what_rows_lack(spark):
    rows = spark.sql("select * from values (1, 'N', cast(null as string), array()), (2, null, 'E', array('s')) as t(json_id, name, email, same_as)").withColumn("telephone", F.lit(None))
    got = [json.loads(r.json) for r in jsonld.generated(rows, "organization").orderBy("json_id").collect()]
    head = {"@context": "https://schema.org", "@type": "Organization"}
    assert got == [head | {"name": "N"}, head | {"sameAs": ["s"], "contactPoint": {"@type": "ContactPoint", "contactType": "customer support", "email": "E"}}]
    order = json.loads(jsonld.generated(spark.range(1), "order").first().json)
    assert order["deliveryMethod"] == ["https://schema.org/OnSitePickup", "https://schema.org/ParcelService"] and "acceptedPaymentMethod" not in order
    assert order["priceSpecification"]["eligibleTransactionVolume"]["minPrice"] == 0 and order["target"]["inLanguage"] == "en-US"
    geo = spark.sql("select 'Store' as business_type, 1.5 as latitude, 'R' as region")
    assert json.loads(jsonld.generated(geo, "local_business").first().json) == {"@context": "https://schema.org", "@type": "Store"}
    assert jsonld.generated(rows.limit(0), "profile").count() == 0
    table = spark.sql("select 'Hotel' as reservation_kind, 'P' as provider")
    assert json.loads(jsonld.generated(table, "reservation").first().json)["reservationFor"] == {"@type": "Place", "name": "P"}


def test_parts_are_dealt_to_all_cores(spark, sf):
    from sightline.plans import payload_queries

    assert payload_queries._payloads(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
