"""Tables with commits: what is rewritten, what a cut-off commit leaves, conflicts, removal by age, kept counts."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import alerts, committed, rollup
from tidemark.operators.committed import Conflict, Table

NOW = "2026-01-31 12:00:00"


@pytest.fixture()
def table(spark, tmp_path):
    made = Table(spark, str(tmp_path / "t"), "id", 8)
    made.create(spark.range(100).selectExpr("id", "id * 2 as v"))
    return made


def replaced(old, new):
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


def held(t, number=None):
    return {r.id: r.v for r in t.read(number).collect()}


def test_only_touched_buckets(spark, table):
    before = table.version()
    assert before.rows == 100 and len(before.buckets) == 8
    batch = spark.createDataFrame([(7, -1), (1000, -2)], "id long, v long")
    _, after = table.update(batch, replaced)
    touched = set(table.touched(batch))
    assert {b for b in after.buckets if after.buckets[b] != before.buckets[b]} == touched and 1 <= len(touched) <= 2
    assert held(table) == {i: 2 * i for i in range(100)} | {7: -1, 1000: -2} and after.rows == 101
    assert held(table, 1) == {i: 2 * i for i in range(100)}  # readers of the old version go on
    gone, came = table.changes(before, after)
    assert 0 < gone.count() < 60 and came.count() == gone.count() + 1


def test_empty_tables(spark, tmp_path):
    t = Table(spark, str(tmp_path / "e"), "id", 4)
    with pytest.raises(ValueError):
        t.read()
    t.create(spark.range(0).selectExpr("id", "id as v"))
    assert t.read().count() == 0 and t.version().rows == 0
    t.update(spark.createDataFrame([(1, 1)], "id long, v long"), replaced)
    t.update(spark.createDataFrame([(1, 1)], "id long, v long"), lambda old, new: old.join(new, "id", "left_anti"))
    assert t.read().count() == 0 and t.versions() == [1, 2, 3]


def test_cut_off_before_the_manifest(spark, table, monkeypatch):
    """Data without a manifest are never seen, and go when they are old enough."""
    batch = spark.createDataFrame([(7, -1)], "id long, v long")
    with monkeypatch.context() as m:
        def fails(*_):
            raise RuntimeError("lost")

        m.setattr(Table, "_publish", fails)
        with pytest.raises(RuntimeError):
            table.update(batch, replaced)
    assert table.versions() == [1] and held(table)[7] == 14
    assert table.expire(time.time(), 3600) == ([], 0)  # too young to be sure
    assert table.expire(time.time() + 7200, 3600) == ([], 1)
    table.update(batch, replaced)
    assert held(table)[7] == -1


def test_what_was_written_is_verified(spark, table, monkeypatch):
    """Rows that don't reach the disk stop a commit."""
    read = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p, **k: read(self, *p, **k).limit(3) if len(p) == 1 and "/data/" in p[0] and "_bucket=" not in p[0] else read(self, *p, **k))
    with pytest.raises(OSError):
        table.update(spark.range(50).selectExpr("id", "id as v"), replaced)
    monkeypatch.undo()
    assert table.versions() == [1]


def test_removal_by_age(spark, table):
    for v in range(3):
        table.update(spark.createDataFrame([(v, -1)], "id long, v long"), replaced)
    assert table.expire(time.time(), 3600) == ([], 0) and table.versions() == [1, 2, 3, 4]
    gone, removed = table.expire(time.time() + 7200, 3600, keep=2)
    assert gone == [1, 2] and table.versions() == [3, 4] and held(table) == {i: 2 * i for i in range(100)} | {0: -1, 1: -1, 2: -1}
    table.expire(time.time() + 7200, 3600)
    assert held(table)[2] == -1 and len(held(table, 4)) == 100


def test_conflicts(spark, table):
    """Of two commits on one version, that of other buckets goes through, that of the same must start over."""
    base = table.version()
    mine = spark.createDataFrame([(7, -1)], "id long, v long")
    bucket = table.touched(mine)[0]
    other = next(i for i in range(100) if table.touched(spark.createDataFrame([(i,)], "id long"))[0] != bucket)
    table.commit(base, mine, replaced)
    table.commit(base, spark.createDataFrame([(other, -2)], "id long, v long"), replaced)
    assert held(table)[7] == -1 and held(table)[other] == -2
    with pytest.raises(Conflict):
        table.commit(base, mine, replaced)
    with pytest.raises(Conflict):  # a change that read what another has changed
        table.commit(base, spark.createDataFrame([(other, -3)], "id long, v long"), replaced, reads=mine.select("id"))
    with pytest.raises(ValueError):
        table.update(mine, lambda old, new: old.withColumn("id", F.col("id") + 1))


def test_two_claimers(spark, tmp_path, monkeypatch):
    """Both look at one version; the second to publish finds its request taken, and takes the next."""
    t = Table(spark, str(tmp_path / "r"), "id", 4)
    rows = [(i, "queued" if i > 2 else "succeeded", dt.datetime(2026, 1, 1, 0, i), None) for i in range(1, 6)]
    t.create(spark.createDataFrame(rows, "id long, status string, requested_at timestamp, started_at timestamp"))
    now, commit, first = F.to_timestamp(F.lit(NOW)), Table.commit, []

    def between(self, *a, **k):
        """While one claimer has read and not yet committed, another claims."""
        if not first:
            first.append(None)
            first[0] = committed.claim(t, now).first().id
        return commit(self, *a, **k)

    monkeypatch.setattr(Table, "commit", between)
    second = committed.claim(t, now).first()
    assert (first[0], second.id, second.status) == (3, 4, "running") and second.started_at == dt.datetime(2026, 1, 31, 12)
    assert committed.claim(t, now).first().id == 5 and committed.claim(t, now) is None
    assert {r.id: r.status for r in t.read().collect()} == {1: "succeeded", 2: "succeeded", 3: "running", 4: "running", 5: "running"}


def test_kept_counts(spark, tmp_path):
    """Rows come, go, and change day and group; counts and events stay those of a full recount, also after a refresh that was cut off."""
    schema = "id long, victim_name string, victim_domain string, actor_group string, first_seen_at timestamp"
    day = lambda d, h=0: dt.datetime(2026, 1, d, h)
    records = Table(spark, str(tmp_path / "r"), "id", 8)
    rows = {i: (i, f"name {i}", None, f"g{i % 3}", day(1 + i % 31, i % 24)) for i in range(60)}
    rules = spark.createDataFrame([(1, "substring", "name 1", True), (2, "actor_group", "g2", True)], "alert_id long, match_kind string, match_value string, enabled boolean")
    records.create(spark.createDataFrame(list(rows.values()), schema))
    counts, events = Table(spark, f"{tmp_path}/c", "day", 4), Table(spark, f"{tmp_path}/e", "record_id", 8)
    as_of = F.to_timestamp(F.lit(NOW))
    for step in range(4):
        rollup.refresh(records, counts)
        rollup.refresh_events(records, events, rules)
        rollup.refresh(records, counts)  # nothing to do
        want = {}
        for r in rows.values():
            want[r[4].date() if r[4] else None, r[3]] = want.get((r[4].date() if r[4] else None, r[3]), 0) + 1
        assert {(r.day, r.actor_group): r.n for r in counts.read().collect()} == want
        assert sorted(map(tuple, events.read().select("alert_id", "record_id").collect())) == sorted(map(tuple, alerts.match(records.read(), rules).select("alert_id", "record_id").collect()))
        assert events.version().rows == sum(f"name {r[0]}".startswith("name 1") + (r[3] == "g2") for r in rows.values())
        line = rollup.headline(records.read(), counts.read(), as_of).first()
        ago = lambda n: sum(r[4] is not None and r[4] >= dt.datetime(2026, 1, 31, 12) - dt.timedelta(days=n) for r in rows.values())  # noqa: E731, B023
        assert tuple(line) == (len(rows), ago(7), ago(30), len({r[3] for r in rows.values()}))
        batch = [(i, f"name {i}", None, "g0" if step else f"g{i % 3}", None if i == 7 else day(31, 13)) for i in range(step, 90, 7 + step) if i not in rows or i % 3 == 0]
        records.update(spark.createDataFrame(batch, schema), replaced)
        rows |= {b[0]: b for b in batch}
        gone = spark.createDataFrame([(step + 20,), (999,)], "id long")
        records.update(gone, lambda old, new: old.join(new, "id", "left_anti"))
        rows.pop(step + 20, None)
    assert {r.date: r.total for r in rollup.per_day(counts.read(), as_of, 3).collect()}.keys() == {"2026-01-29", "2026-01-30", "2026-01-31"}
