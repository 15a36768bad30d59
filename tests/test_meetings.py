"""Meetings of records with values of rules: what is told from them without making events, and how crowds are spread."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.operators import alerts, committed, rollup
from tidemark.operators.committed import Table
from tidemark.plans import api

RULES = "alert_id long, owner_id string, match_kind string, match_value string, enabled boolean"


@pytest.fixture(scope="module")
def crowd(spark):
    """40 rules of one group that most records have, 20 of one part of a domain, 3 more."""
    rules = [(i, f"owner{i % 2}", "actor_group", "g", i % 9 != 0) for i in range(40)] + [(i, "owner1", "domain", "c_.test", True) for i in range(40, 60)]
    rules += [(60, "owner1", "exact", "name 7", True), (61, "owner0", "substring", "me 1", True), (62, "owner1", "domain", "test", True)]
    records = [(i, f"Name {i}", f"www.c{i % 12}.test" if i % 4 == 0 else None, "g" if i % 5 else None, dt.datetime(2026, 1, 1) + dt.timedelta(days=i % 50)) for i in range(900)]
    return spark.createDataFrame(records, "id long, victim_name string, victim_domain string, actor_group string, first_seen_at timestamp"), spark.createDataFrame(rules, RULES)


def plain(records, rules):
    out = set()
    for r in records.collect():
        name, domain = r.victim_name.lower(), r.victim_domain or ""
        for a in rules.where("enabled").collect():
            v = a.match_value
            host = domain.endswith(".test") and (v == "test" or len(domain.split(".")[1]) == 2)
            if {"actor_group": r.actor_group == v, "domain": host, "exact": name == v, "substring": v in f"{name} {domain}"}[a.match_kind]:
                out.add((a.alert_id, r.id))
    return out


def test_crowds_are_spread(crowd):
    """Records that meet a value of many rules go to many places, others to one; events are those of every pair."""
    met = alerts.meetings(*crowd)
    places = {(r.match_kind, r.match_value): r.n for r in met.groupBy("match_kind", "match_value").agg(F.count_distinct("_place").alias("n")).collect()}
    assert places["actor_group", "g"] > 200 and places["domain", "c_.test"] > 50
    assert places["exact", "name 7"] == places["substring", "me 1"] == places["domain", "test"] == 1
    found = [tuple(r) for r in alerts.match(*crowd).select("alert_id", "record_id").collect()]
    assert sorted(found) == sorted(plain(*crowd))


def test_hashes_in_blocks(crowd, monkeypatch):
    monkeypatch.setattr(alerts, "HASHES", 1)
    found = [tuple(r) for r in alerts.match(*crowd).select("alert_id", "record_id").collect()]
    assert sorted(found) == sorted(plain(*crowd))


def test_newest_events(crowd):
    """the newest events are those of all events in order."""
    records, rules = crowd
    seen = {r.id: r.first_seen_at for r in records.collect()}
    mine = {r.alert_id for r in rules.where("owner_id = 'owner1'").collect()}
    want = sorted((e for e in plain(records, rules) if e[0] in mine), key=lambda e: (seen[e[1]], e[1], e[0]), reverse=True)[:50]
    found = api.recent_events(alerts.meetings(records, rules), rules, records, "owner1", 50)
    assert [(r.alert_id, r.record_id) for r in found.collect()] == want


def test_counts(crowd):
    want = plain(*crowd)
    met = alerts.meetings(*crowd)
    assert {r.alert_id: r.event_count for r in alerts.counts(met, crowd[1]).collect()} == {a: sum(e[0] == a for e in want) for a in {a for a, _ in want}}
    assert alerts.triggered(met, crowd[1]).collect()[0][0] == len(want)
    assert alerts.triggered(met.where("false"), crowd[1]).collect()[0][0] == 0


@pytest.mark.parametrize("name", ["summary", "alerts_with_counts", "summary_kept", "leaks_per_day_kept"])
def test_no_events_are_made(spark, sf, monkeypatch, name):
    """F3, F4, F8, F11: counts don't need the events, which grow with records times rules."""
    def fails(*_):
        raise AssertionError("events are made")

    monkeypatch.setattr(alerts, "match", fails)
    monkeypatch.setattr(alerts, "expanded", fails, raising=False)
    assert registry.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["alert_match", "alerts_on_new", "events_if_absent"])
def test_events_are_not_shuffled(spark, sf, name):
    """events come of an explosion at the end, behind all exchanges."""
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "explode(_alerts" in plan and "Exchange" not in plan[: plan.index("explode(_alerts")]


def test_kept_meetings(spark, tmp_path, crowd):
    """Kept up with commits, meetings stand for as many events as matching anew; rules that share a value later don't count."""
    records, rules = crowd
    kept, met = Table(spark, f"{tmp_path}/r", "id", 4), Table(spark, f"{tmp_path}/m", "record_id", 4)
    kept.create(records.where("id < 600"))
    rollup.refresh_meetings(kept, met, rules)
    kept.update(records.where("id >= 500"), lambda old, new: old.where("id > 20").join(new.select("id"), "id", "left_anti").unionByName(new))
    rollup.refresh_meetings(kept, met, rules)
    rollup.refresh_meetings(kept, met, rules)
    assert rollup.triggered(met.read()).collect()[0][0] == alerts.match(kept.read(), rules).count() > 0


@pytest.mark.parametrize("name, columns", [("leaks_per_day_kept", 3), ("summary_kept", 5)])
def test_kept_tables_write_rows_once(spark, sf, monkeypatch, name, columns):
    """commits neither join the records anew nor deal them by bucket, and keep the columns that are asked for."""
    written, write = [], Table._write
    frame = type(spark.range(1))

    def watched(self, rows, schema):
        with monkeypatch.context() as m:
            m.setattr(frame, "repartition", lambda *_: (_ for _ in ()).throw(AssertionError("rows are dealt by bucket")))
            if "/records-" in self.folder and self.key == "id":
                written.append((rows._jdf.queryExecution().analyzed().toString(), len(schema)))
            return write(self, rows, schema)

    monkeypatch.setattr(Table, "_write", watched)
    assert registry.QUERIES[name](spark, sf).count() > 0
    assert len(written) == 2 and all("c_nationkey" not in plan and n == columns for plan, n in written)


@pytest.mark.parametrize("hashes", [1 << 23, 1])
def test_counted_without_an_exchange(crowd, monkeypatch, hashes):
    """the numbers of rules come of the pass, also if all values of a kind have one hash, or go in blocks."""
    records, rules = crowd
    want = {r.record_id: r.n for r in alerts.match(records, rules).groupBy("record_id").agg(F.count("*").alias("n")).collect()}
    monkeypatch.setattr(alerts, "HASHES", hashes)
    if hashes > 1:
        monkeypatch.setattr(alerts, "_hash", lambda kind, value: F.xxhash64(F.lit(kind) if kind in alerts.FIELDS else kind, F.isnull(value)))
    with alerts.counter(rules) as count:
        found = count(records)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r.record_id: r.n for r in found.groupBy("record_id").agg(F.sum("rules").alias("n")).collect()} == want


def test_large_commits_go_in_rounds(spark, tmp_path, crowd, monkeypatch):
    """a large commit and comparison take some buckets at a time, release what they shuffled, and leave nothing beside the versions."""
    monkeypatch.setattr(committed, "ROUND_ROWS", 300)
    records, rules = crowd
    kept, met = Table(spark, f"{tmp_path}/r", "id", 8), Table(spark, f"{tmp_path}/m", "record_id", 8)
    sizes, cleaned = [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def change(old, new):
        assert spark.conf.get(cleaned) == "true"
        sizes.append((old.count(), new.count()))
        return old.where("id > 20").join(new.select("id"), "id", "left_anti").unionByName(new)

    kept.create(records.where("id < 600"))
    rollup.refresh_meetings(kept, met, rules)
    batch = records.where("id >= 500").withColumn("actor_group", F.lit("g"))
    kept.update(batch, change)
    rollup.refresh_meetings(kept, met, rules)
    assert len(sizes) > 2 and sum(o for o, _ in sizes) == 600 and sum(n for _, n in sizes) == 400 and max(map(sum, sizes)) < 600
    assert spark.conf.get(cleaned) == "false"
    assert {r.id: r.actor_group for r in kept.read().collect()} == {r.id: r.actor_group for r in records.where("id > 20 and id < 500").union(batch).collect()}
    # Records that only changed are not matched again.
    then = records.where("id > 20 and id < 600").union(batch.where("id >= 600"))
    assert rollup.triggered(met.read()).collect()[0][0] == alerts.match(then, rules).count() > 0
    left = {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.parquet")}
    named = {f"{name}/{place}" for name, t in (("r", kept), ("m", met)) for v in t.versions() for place, _ in t.version(v).buckets.values()}
    assert left and {p.rsplit("/", 1)[0] for p in left} == named


@pytest.mark.parametrize("round_rows", [1 << 20, 300])
def test_changed_records_are_matched_again(spark, tmp_path, crowd, monkeypatch, round_rows):
    """meetings are those of the records as they are, also of some that changed their group, name or domain, or come twice."""
    monkeypatch.setattr(committed, "ROUND_ROWS", round_rows)
    records, rules = crowd
    kept, met = Table(spark, f"{tmp_path}/r", "id", 4), Table(spark, f"{tmp_path}/m", "record_id", 4)
    kept.create(records.where("id < 600").unionByName(records.where("id % 50 = 3").withColumn("victim_name", F.lit("me 1 too"))))
    rollup.refresh_meetings(kept, met, rules, again=True)
    assert rollup.triggered(met.read()).collect()[0][0] == alerts.match(kept.read(), rules).count()
    batch = records.where("id % 7 = 0 or id >= 550").withColumns({
        "actor_group": F.when(F.col("id") % 2 == 0, "g").otherwise("none"), "victim_name": F.when(F.col("id") % 3 == 0, "Name 7").otherwise(F.col("victim_name")),
        "victim_domain": F.when(F.col("id") % 14 != 0, F.col("victim_domain")),
    })
    kept.update(batch.union(batch.where("id % 5 = 0")), lambda old, new: old.where("id > 20").join(new.select("id"), "id", "left_anti").unionByName(new))
    rollup.refresh_meetings(kept, met, rules, again=True)
    want = {r.record_id: r.n for r in alerts.match(kept.read(), rules).groupBy("record_id").agg(F.count("*").alias("n")).collect()}
    assert {r.record_id: r.n for r in met.read().groupBy("record_id").agg(F.sum("rules").alias("n")).collect()} == want


def test_events_come_rule_by_rule(crowd):
    """events of records times rules are written in runs of one rule, which files hold in little space."""
    records, rules = crowd
    met = alerts.meetings(records, rules).withColumn("origin", F.lit("kept"))
    for events in (alerts.match(records, rules), alerts.expanded(met, rules)):
        found = [r.alert_id for r in events.select("alert_id").collect()]
        assert len(found) > 25_000 and sum(a != b for a, b in zip(found, found[1:])) < len(found) / 20


def test_chunks(monkeypatch):
    """Records without an id, or that come twice, stay; a chunk has no more records than it may, of one value and origin."""
    monkeypatch.setattr(alerts, "CHUNK", 2)
    ids, values, origin = [1, 2, None, 2, 5, 6, 7], ["x", "x", "x", "y", "x", "x", "x"], ["a", "a", "a", "a", "a", "b", None]
    met = pa.RecordBatch.from_pydict({"record_id": pa.array(ids, pa.int64()), "match_kind": ["k"] * 7, "match_value": values, "_place": pa.array(range(7), pa.int32()), "origin": origin})
    found = alerts._chunk(met).to_pylist()
    assert [(c["match_value"], c["origin"], c["_place"], c["_records"]) for c in found] == [("x", "a", 0, [1, 2]), ("x", "a", 2, [None, 5]), ("y", "a", 3, [2]), ("x", "b", 5, [6]), ("x", None, 6, [7])]
    assert alerts._chunk(met.slice(3, 2)).num_rows == 2
