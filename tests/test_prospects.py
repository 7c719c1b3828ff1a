"""Prospects: a sequential store as brute force, any order of events and batches, batches that run twice, odd events."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from sightline.operators import prospects
from sightline.streaming import prospects as stream
from sightline.streaming import windows

FIELDS = [f.split()[0] for f in prospects.EVENT.split(", ")]
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def event(version, domain, kind, **rest):
    ts = START + timedelta(hours=version) if version is not None else None
    return tuple({"version": version, "ts": ts, "domain": domain, "kind": kind, **rest}.get(f) for f in FIELDS)


def drawn(n, seed):
    draw = random.Random(seed)
    stages = ["lead", "Qualified", "proposal sent", "Proposal-Sent", " WON", "lost", "nope", None]
    forms = ["https://www.{}.example/", "{}.example", " {}.EXAMPLE//", "http://{}.example"]
    out = []
    for v in range(n):
        kind = draw.choice(["add", "update", "update", "note", "audit", "audit", "call", None])
        site = draw.choice(forms).format(draw.choice("aaaaabcdefg"))
        out.append(event(v, site if draw.random() > 0.05 else None, kind, name=draw.choice([None, "n"]), email=draw.choice([None, "m"]), stage=draw.choice(stages), value=draw.choice([None, 1.5, 20.0]), text=draw.choice([None, "t", "u"]), score=draw.choice([None, 0.0, 40.0, 62.5]), report=draw.choice([None, "r"])))
    return out


def kept(raw):
    held = raw.strip()
    for start in ("https://", "http://", "www."):
        while held.startswith(start):
            held = held[len(start) :]
    return held.rstrip("/").lower()


def sequential(events):
    """What a store holds that takes events one by one, in the order of their versions."""
    store = {}
    for e in (dict(zip(FIELDS, x)) for x in sorted(events, key=lambda x: x[0])):
        if e["domain"] is None or e["kind"] not in prospects.KINDS:
            continue
        site, to = kept(e["domain"]), (e["stage"] or "").strip().lower().replace(" ", "_").replace("-", "_")
        if e["kind"] == "add":
            if site in store or to not in prospects.STAGES:
                continue
            store[site] = {"name": e["name"] or site, "email": e["email"], "stage": to, "value": e["value"], "created": e["version"], "updated": e["version"], "note": None, "audits": []}
            continue
        p = store.get(site)
        if p is None or (e["kind"] == "update" and e["stage"] is not None and to not in prospects.STAGES):
            continue
        p["updated"] = e["version"]
        if e["kind"] == "update":
            p["stage"] = to or p["stage"]
            p["value"] = p["value"] if e["value"] is None else e["value"]
        elif e["kind"] == "note":
            p["note"] = e["text"]
        else:
            p["audits"].insert(0, (e["version"], e["score"], e["report"]))
    return {d: (p["name"], p["email"], p["stage"], p["value"], p["created"], p["updated"], p["note"], p["audits"][:2]) for d, p in store.items()}


def collected(state):
    hours = lambda ts: round((ts.astimezone(timezone.utc) - START).total_seconds() / 3600)
    return {r.domain: (r["name"], r.email, r.stage, r.deal_value, hours(r.created_at), hours(r.updated_at), r.last_note, [(a.version, a.score, a.report) for a in r.audits]) for r in prospects.latest(state).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_folds_are_the_sequential_store(spark, seed):
    """Whole and in three parts that are merged in another order, with rows that come twice."""
    rows = drawn(150, seed)
    want = sequential(rows)
    made = lambda r: prospects.partial(spark.createDataFrame(r, prospects.EVENT))
    assert collected(prospects.merged(made(rows))) == want and want
    mixed = rows + rows[::3]
    random.Random(seed).shuffle(mixed)
    parts = [prospects.merged(made(mixed[k::3])) for k in range(3)]
    assert collected(prospects.merged(parts[2].unionByName(parts[0]).unionByName(parts[1]))) == want


def test_store_takes_batches_in_any_order_and_twice(spark, tmp_path):
    rows = drawn(120, 9)
    want = sequential(rows)
    draw = random.Random(1)
    for k in range(2):
        store, folder = str(tmp_path / f"store{k}"), tmp_path / f"in{k}"
        mixed = rows + rows[::4]
        draw.shuffle(mixed)
        events = windows.table_stream(spark, str(folder), prospects.EVENT, maxFilesPerTrigger=1, recursiveFileLookup=True)
        for j in range(2):  # two runs over one checkpoint, of two batches each
            for i in (0, 1):
                spark.createDataFrame(mixed[2 * j + i :: 4], prospects.EVENT).coalesce(1).write.parquet(str(folder / f"part-{j}-{i}"))
            stream.upsert(events, store, f"{store}-checkpoint")
        assert collected(stream.state(spark, store)) == want
        last = stream.history(spark, store).where("batch = 3").drop("batch").collect()
        stream.apply(spark.createDataFrame(last, prospects.EVENT), 3, store)
        assert collected(stream.state(spark, store)) == want
        assert stream.history(spark, store).count() == len(mixed)
        assert len(list((tmp_path / f"store{k}" / "state").iterdir())) == 2


def test_a_state_that_is_not_complete_is_not_read(spark, tmp_path):
    store = str(tmp_path / "s")
    assert stream.state(spark, store).count() == 0
    stream.apply(spark.createDataFrame([event(1, "a.example", "add", stage="lead")], prospects.EVENT), 0, store)
    more = spark.createDataFrame([event(2, "a.example", "update", stage="won")], prospects.EVENT)
    stream.apply(more, 1, store)
    (tmp_path / "s" / "state" / "1" / "_SUCCESS").unlink()
    assert collected(stream.state(spark, store))["a.example"][2] == "lead"
    stream.apply(more, 1, store)
    assert collected(stream.state(spark, store))["a.example"][2] == "won"


def test_deltas_and_stages(spark):
    rows = [event(1, "a.example", "add", stage="lead"), event(2, "a.example", "audit", score=40.0), event(3, "a.example", "audit", score=50.0), event(4, "a.example", "audit", score=45.5)]
    rows += [event(1, "b.example", "audit", score=9.0), event(2, "b.example", "add", stage="won"), event(3, "b.example", "audit", score=9.0)]
    rows += [event(1, "c.example", "add", stage="lost"), event(2, "c.example", "audit"), event(3, "c.example", "audit", score=3.0), event(None, "c.example", "audit", score=4.0)]
    rows += [event(5, "d.example", "audit", score=4.0), event(6, "d.example", "add", stage="what")]
    latest = prospects.latest(prospects.merged(prospects.partial(spark.createDataFrame(rows, prospects.EVENT))))
    got = {r.domain: (r.previous, r.current, r.delta, r.delta_pct, r.direction) for r in prospects.deltas(latest).collect()}
    assert got == {"a.example": (50.0, 45.5, -4.5, -9.0, "regressed"), "c.example": (0.0, 3.0, 3.0, 0.0, "improved")}
    assert [r.domain for r in prospects.in_stage(latest, " Won").collect()] == ["b.example"]
    with pytest.raises(ValueError, match="unknown stage"):
        prospects.in_stage(latest, "nope")
