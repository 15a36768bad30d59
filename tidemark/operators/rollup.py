"""Counts that are kept up with the commits of a table of records instead of being counted anew.

``counts`` is a committed table of its own: records by the day they were first seen and by group. Its newest version
notes which version of the records it counts. ``refresh`` reads only the buckets of the records that differ since then, before
and after, and adds the difference: rows that came add one, rows that went take one away, rows that changed
their day or group do both. A refresh that is cut off changes nothing, and the next one starts from the same note.

``events`` is kept alike: alerts of records that a commit brought, without those of records that are gone. How many there are
stands in its manifest. ``meetings`` is the same without a row for each rule: a record that met any, with the number of rules that
it met then. It grows with the records alone, where events grow with the rules that share a value, too. An alert is raised when a
record comes, so records that only change keep what they met; with ``again`` those that changed in a column that they are matched by are
matched anew, and meetings are those of the records as they are. Versions are compared,
and both are written, in rounds (``committed``): only a part of the records is shuffled at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import alerts
from .committed import Table, Version, released

#: Columns that records are matched by.
_MATCHED = ["id", "victim_name", "victim_domain", "actor_group"]


def daily(records: DataFrame) -> DataFrame:
    """day, actor_group and n of records (of null first_seen_at under a null day)."""
    return records.groupBy(F.to_date("first_seen_at").alias("day"), "actor_group").agg(F.count("*").alias("n"))


def _added(counts: DataFrame, difference: DataFrame) -> DataFrame:
    """Counts after a difference (day, actor_group, n) is added, without those that come to nothing."""
    return counts.unionByName(difference).groupBy("day", "actor_group").agg(F.sum("n").alias("n")).where("n <> 0")


def refresh(records: Table, counts: Table) -> Version:
    """Bring the counts up to the newest version of the records; the first time, count all of them."""
    newest = records.version()
    if not counts.versions():
        return counts.create(daily(records.read(newest.number)), str(newest.number))
    base = counts.version()
    if int(base.note) == newest.number:
        return base
    before, after = records.changes(records.version(int(base.note)), newest)
    difference = _added(daily(after), daily(before).withColumn("n", -F.col("n")))
    # Counted once: the commit looks at its days before it adds it.
    place = f"{counts.folder}/differences/{base.note}-{newest.number}"
    with released(counts.spark):
        difference.write.mode("overwrite").parquet(place)
    return counts.commit(base, counts.spark.read.schema(difference.schema).parquet(place), _added, note=str(newest.number))


def _differing(before: DataFrame, after: DataFrame, again: bool) -> DataFrame:
    """Rows (those columns that records are matched by) of the records that came or went, with ``again`` also of those that changed:
    how often a row was there before (_was) and is after (_is). A record may have several rows."""
    old = before.select(*(_MATCHED if again else ["id"]), F.lit(1).alias("_was"), F.lit(0).alias("_is"))
    both = old.unionByName(after.select(*_MATCHED, F.lit(0).alias("_was"), F.lit(1).alias("_is")), allowMissingColumns=True)
    # One exchange: each version is shuffled once.
    rows = both.repartition("id").groupBy(*_MATCHED).agg(F.sum("_was").alias("_was"), F.sum("_is").alias("_is"))
    own = Window.partitionBy("id")
    came_or_went = (F.sum("_was").over(own) == 0) | (F.sum("_is").over(own) == 0)
    changed = F.max(F.col("_was") != F.col("_is")).over(own) if again else F.lit(False)
    return rows.withColumn("_differs", came_or_went | changed).where("_differs").drop("_differs")


def _refresh_met(records: Table, kept: Table, matched: Callable[[DataFrame], DataFrame], again: bool = False) -> Version:
    """Bring what ``matched`` makes of records (keyed by record_id) up to the newest version of the records."""
    newest = records.version()
    if not kept.versions():
        return kept.create(matched(records.read(newest.number)), str(newest.number))
    base = kept.version()
    place = f"{kept.folder}/differences/{base.note}-{newest.number}"
    kept.discard(place)  # of a refresh that was cut off
    schema = None
    for k, (before, after) in enumerate(records.changes_in_rounds(records.version(int(base.note)), newest)):
        # Its rows are read twice, for what came and for what went.
        differ = _differing(before, after, again)
        differ.write.option("compression", "zstd").parquet(f"{place}/{k}")
        differ = kept.spark.read.schema(differ.schema).parquet(f"{place}/{k}")
        fresh = matched(differ.select(*_MATCHED, F.explode(F.array_repeat(F.lit(True), F.col("_is").cast("int"))))).withColumn("gone", F.lit(False))
        gone = differ.where("_was > 0").select(F.col("id").alias("record_id"), F.lit(True).alias("gone"))
        fresh = fresh.unionByName(gone, allowMissingColumns=True)
        schema = fresh.schema
        fresh.write.mode("append").option("compression", "zstd").parquet(f"{place}/all")
        kept.discard(f"{place}/{k}")

    def change(rows: DataFrame, batch: DataFrame) -> DataFrame:
        return rows.join(batch.where("gone").select("record_id"), "record_id", "left_anti").unionByName(batch.where("not gone").drop("gone"))

    after = kept.commit(base, kept.spark.read.schema(schema).parquet(f"{place}/all"), change, note=str(newest.number))
    kept.discard(place)
    return after


def _is_new(records: Table, kept: Table) -> bool:
    """Whether the records have a version that is not in what is kept."""
    return not kept.versions() or int(kept.version().note) != records.version().number


def refresh_events(records: Table, events: Table, rules: DataFrame) -> Version:
    """Bring the alert events (alert_id, record_id, matched_on; keyed by record_id) up to the newest version of the records."""
    if not _is_new(records, events):
        return events.version()
    with released(events.spark):
        read = alerts.reader(rules)
        return _refresh_met(records, events, lambda rows: alerts.expanded(read(rows), rules).select("alert_id", "record_id", "matched_on"))


def refresh_meetings(records: Table, met: Table, rules: DataFrame, again: bool = False) -> Version:
    """Bring the meetings (record_id, rules; keyed by record_id) up to the newest version of the records; with ``again`` records
    that changed in what they are matched by are matched anew."""
    if not _is_new(records, met):
        return met.version()
    with released(met.spark), alerts.counter(rules) as count:
        return _refresh_met(records, met, count, again)


def triggered(met: DataFrame) -> DataFrame:
    """One row: the number of events that kept meetings stand for (alerts_triggered)."""
    return met.agg(F.coalesce(F.sum("rules"), F.lit(0)).alias("alerts_triggered"))


def per_day(counts: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """date and total of the last days from kept counts; days without records have 0."""
    last = F.to_date(as_of)
    calendar = counts.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    kept = counts.where((F.col("day") >= F.date_sub(last, days - 1)) & (F.col("day") <= last)).groupBy("day").agg(F.sum("n").alias("n"))
    return calendar.join(kept, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("date"), F.coalesce("n", F.lit(0)).alias("total"))


def headline(records: DataFrame, counts: DataFrame, as_of: Column) -> DataFrame:
    """One row: total_leaks, leaks_last_7_days, leaks_last_30_days and tracked_groups from kept counts. Of ``records`` only the
    two days that a window starts within are read, and none if it starts at midnight."""

    def recent(days: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("day") >= _next_midnight(as_of, days), F.col("n"))), F.lit(0))

    kept = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_leaks"), recent(7).alias("week"), recent(30).alias("month"), F.count_distinct("actor_group").alias("tracked_groups"))
    part = lambda days: (F.col("first_seen_at") >= as_of - F.make_dt_interval(days=F.lit(days))) & (F.col("first_seen_at") < _next_midnight(as_of, days).cast("timestamp"))
    rest = records.where(part(7) | part(30)).agg(F.count_if(part(7)).alias("part_7"), F.count_if(part(30)).alias("part_30"))
    return kept.crossJoin(rest).select(  # one row each
        "total_leaks", (F.col("week") + F.col("part_7")).alias("leaks_last_7_days"), (F.col("month") + F.col("part_30")).alias("leaks_last_30_days"), "tracked_groups"
    )


def _next_midnight(as_of: Column, days: int) -> Column:
    """The first day that lies wholly within the last ``days`` days."""
    start = as_of - F.make_dt_interval(days=F.lit(days))
    return F.when(F.date_trunc("day", start) == start, F.to_date(start)).otherwise(F.date_add(F.to_date(start), 1))
