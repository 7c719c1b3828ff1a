"""Commerce profiles member by member against plain Python over JSON of every shape."""

import itertools
import json

from pyspark.sql import functions as F

from sightline.operators import profiles


def plain(text):
    try:
        data = json.loads(text)
    except (TypeError, ValueError):
        return False, None, None, [], ["invalid-json"], []
    if not isinstance(data, dict):
        return True, None, None, [], ["profile-not-object"], []
    issues, unknown, caps, version, name = [], [], [], None, None
    if "version" not in data:
        issues.append("missing-version")
    elif not isinstance(data["version"], str):
        issues.append("version-not-string")
    else:
        version = data["version"]
    shop = data.get("merchant")
    if "merchant" not in data:
        issues.append("missing-merchant")
    elif isinstance(shop, dict):
        name = shop.get("name")
        if not (isinstance(name, str) and name):
            issues.append("merchant-name-empty")
    else:
        issues.append("merchant-not-object")
    held = data.get("capabilities")
    if "capabilities" not in data:
        issues.append("missing-capabilities")
    elif not isinstance(held, list):
        issues.append("capabilities-not-array")
    else:
        for i, c in enumerate(held):
            if not isinstance(c, dict):
                issues.append(f"capability-{i}-not-object")
                continue
            known = isinstance(c.get("id"), str) and c["id"]
            if known and known not in profiles.CAPABILITIES:
                unknown.append(known)
            tests = [(not known, "missing-id"), ("version" not in c, "missing-version"), ("endpoint" not in c, "missing-endpoint")]
            caps.append((i, [n for t, n in tests if t]))
    return True, version, None if name is None else str(name), caps, issues, unknown


def test_every_shape(spark):
    first = next(iter(profiles.CAPABILITIES))
    caps = [{"id": first, "version": "1", "endpoint": "e"}, {}, 3, None, [1], {"id": "", "version": None}, {"id": None, "endpoint": None}, {"id": "a.b"}, {"id": "a.b", "version": {"x": 1}, "endpoint": [2]}, {"id": 5}, "text"]
    versions = [{}, {"version": None}, {"version": "2"}, {"version": 2}, {"version": {}}, {"version": ""}]
    shops = [{}, {"merchant": None}, {"merchant": []}, {"merchant": {}}, {"merchant": {"name": ""}}, {"merchant": {"name": "n", "id": 4}}, {"merchant": {"name": 7}}, {"merchant": "m"}]
    lists = [{}, {"capabilities": None}, {"capabilities": {}}, {"capabilities": []}, {"capabilities": "x"}, {"capabilities": caps}, {"capabilities": caps[::-1]}]
    texts = [json.dumps({**a, **b, **c}) for a, b, c in itertools.product(versions, shops, lists)]
    texts += [None, "", "{", "[]", "null", "3", '"{}"', "[{}]", '{"x": {"version": "1"}}', json.dumps({"version": "1", "merchant": {"name": "n"}, "capabilities": [caps[0]] * 3000})]
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "i int, payload string, version2 string")
    got = {r.i: (r.valid_json, r.version, r.merchant_name, [(c.idx, c.issues) for c in r.capabilities], r.issues, r.unknown_capabilities) for r in profiles.parsed(rows).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_capabilities_and_summaries(spark):
    text = json.dumps({"version": "1", "merchant": {"name": "n"}, "capabilities": [{"id": "dev.ucp.shopping.cart", "version": 2, "endpoint": {"a": 1}}, 1, {"id": "x"}]})
    rows = profiles.parsed(spark.createDataFrame([(s, text) for s in (None, 200, 404, 500)], "status int, payload string"))
    held = profiles.capabilities(rows.where("status = 200")).orderBy("idx").collect()
    assert [tuple(r) for r in held] == [(200, 0, "dev.ucp.shopping.cart", "2", '{"a":1}', profiles.CAPABILITIES["dev.ucp.shopping.cart"], []), (200, 2, "x", None, None, profiles.UNKNOWN, ["missing-version", "missing-endpoint"])]
    said = rows.select("status", profiles.summary(F.col("status"), F.col("capabilities"), F.col("issues")).alias("s"))
    assert {r.status: r.s for r in said.collect()} == {None: "fetch-failed", 404: "no-ucp-profile (forward-looking opportunity)", 500: "http-500 on discovery", 200: "profile-found: 2 capabilities, 1 structural issues"}
    assert profiles.capabilities(profiles.parsed(rows.select("status", F.lit(None).cast("string").alias("payload")).limit(0))).count() == 0
