"""Replays of streams whose now stands still."""

import datetime as dt

from tidemark.operators import maintain
from tidemark.streaming import job


def test_a_long_replay_keeps_its_now(spark, tmp_path, monkeypatch):
    """runs whose hour is over while the replay goes on, but not at the moment that stands for now, stay."""
    t, real = dt.datetime(2026, 1, 1), job.time.time
    schema = "id long, status string, started_at timestamp"
    rows = [(1, "running", t), (2, "running", t + dt.timedelta(minutes=5)), (3, "running", t + dt.timedelta(hours=1)), (4, "succeeded", t), (5, "running", t - dt.timedelta(microseconds=1))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/runs")
    monkeypatch.setattr(job.time, "time", lambda: real() - 600)  # the replay began ten minutes ago

    def found(hours):
        as_of = int((t + dt.timedelta(hours=hours)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        runs = spark.readStream.schema(schema).parquet(f"{tmp_path}/runs")
        return {r.id: (r.status, r.error) for r in job.abandoned(runs, f"{tmp_path}/out", 3600, as_of).collect()}

    running = ("running", None)
    assert found(1) == {1: running, 2: running, 3: running, 4: ("succeeded", None), 5: ("failed", maintain.STOPPED)}


def test_runs_come_by_slots(spark, tmp_path, monkeypatch):
    """the state is called by slot, not by run; in a slot some runs end, one has no start, one no number, and a timer is not yet due for all."""
    t = dt.datetime(2026, 1, 1)
    schema = "id long, status string, started_at timestamp"
    rows = [(i, "running" if i % 3 else "succeeded", t + dt.timedelta(minutes=i % 200)) for i in range(3000)] + [(3001, "running", None), (None, "running", t), (4, "failed", t)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/runs")
    monkeypatch.setattr(job, "SLOTS", 4)
    as_of, calls = t + dt.timedelta(minutes=160), tmp_path / "calls"

    class Watched(job.Abandoned):
        def handleInputRows(self, *given):
            with calls.open("a") as f:
                f.write("r")
            yield from super().handleInputRows(*given)

        def handleExpiredTimer(self, **given):
            with calls.open("a") as f:
                f.write("t")
            yield from super().handleExpiredTimer(**given)

    monkeypatch.setattr(job, "Abandoned", Watched)

    def found():
        runs = spark.readStream.schema(schema).parquet(f"{tmp_path}/runs")
        return {r.id: (r.status, r.error) for r in job.abandoned(runs, f"{tmp_path}/out", 3600, int(as_of.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)).collect()}

    failed = ("failed", maintain.STOPPED)
    want = {i: failed if s == "running" and at and at < as_of - dt.timedelta(hours=1) else (s, None) for i, s, at in rows}
    assert found() == want and want[101] == ("running", None) and want[None] == want[98] == failed
    assert 1 <= calls.read_text().count("r") <= 4 and 1 <= calls.read_text().count("t") <= 4
