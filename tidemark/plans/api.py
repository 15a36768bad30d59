"""The analyst's queries: listings, series, facets, summary, health, requests and alerts.

Every function takes tables as DataFrames and an explicit ``as_of`` moment, and returns a lazy
DataFrame. Parameters are checked before a plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import crawl_url, matches
from ..operators import alerts

SORTS = ("first_seen_at", "published_at", "victim_name")
OPEN = ("queued", "running")
#: Fixed value: the title of a record without name and domain.
UNNAMED = "Unnamed listing"
#: The columns of a listing that are shown as they are; the source's slug comes beside them.
LISTING = (
    "id", "dedupe_hash", "victim_name", "victim_domain", "victim_country", "victim_sector", "actor_group", "source_id", "source_url",
    "published_at", "published_at_raw", "first_seen_at", "last_seen_at", "status", "leak_type", "leak_size_bytes",
)


def listing(page: DataFrame) -> DataFrame:
    """The 17 columns of a listing, of a page whose records have them all."""
    return page.select(*LISTING, "source_slug")


def _within(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}, not {value}")
    return value


def since(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(days=F.lit(days))


def condition(group: str | None = None, status: str | None = None, source_id: int | None = None, country: str | None = None, sector: str | None = None, start: Column | None = None, end: Column | None = None, q: str | None = None, domains: bool = False) -> Column:
    """All filters that are given, in one condition; the times are inclusive. ``domains``: whether the
    records have a victim_domain for ``q`` to look at."""
    parts = [F.col(c) == v for c, v in (("actor_group", group), ("status", status), ("source_id", source_id), ("victim_country", country), ("victim_sector", sector)) if v is not None]
    if start is not None:
        parts.append(F.col("first_seen_at") >= start)
    if end is not None:
        parts.append(F.col("first_seen_at") <= end)
    if q is not None:
        parts.append(matches(F.coalesce("victim_name", F.lit("")), F.col("victim_domain") if domains else F.lit(None).cast("string"), F.lit(q)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def page(records: DataFrame, sources: DataFrame, where: Column, number: int = 1, limit: int = 25, sort: str = "first_seen_at", order: str = "desc") -> DataFrame:
    """One page of records with the slug of their source. Nulls sort as larger than any value; ids break ties.

    The page is cut before the join, so that only its rows meet the sources.
    """
    _within("number", number, 1, 1 << 30), _within("limit", limit, 1, 100)
    if sort not in SORTS or order not in ("asc", "desc"):
        raise ValueError(f"can't sort by {sort} {order}")
    by = F.col(sort).desc_nulls_first() if order == "desc" else F.col(sort).asc_nulls_last()
    rows = records.where(where).orderBy(by, "id").offset((number - 1) * limit).limit(limit)
    return rows.join(sources.select(F.col("id").alias("source_id"), F.col("slug").alias("source_slug")), "source_id", "left")


def total(records: DataFrame, where: Column, limit: int = 25) -> DataFrame:
    return records.where(where).agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / _within("limit", limit, 1, 100)))


def by_id(records: DataFrame, sources: DataFrame, key: int) -> DataFrame:
    return page(records, sources, F.col("id") == key, limit=1)


def per_day(records: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """date and total for each of the last days; days without records have 0."""
    last = F.to_date(as_of)
    first = F.date_sub(last, _within("days", days, 1, 365) - 1)
    calendar = records.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    inside = (F.col("first_seen_at") >= first.cast("timestamp")) & (F.col("first_seen_at") < F.date_add(last, 1).cast("timestamp"))
    counts = records.where(inside).groupBy(F.to_date("first_seen_at").alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counts, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("date"), F.coalesce("n", F.lit(0)).alias("total"))


def top(records: DataFrame, column: str, limit: int, name: str = "value", as_of: Column | None = None, days: int | None = None) -> DataFrame:
    """The most common values of a column, without nulls, in the trailing days if given."""
    rows = records.where(F.col(column).isNotNull())
    if days is not None:
        rows = rows.where(F.col("first_seen_at") >= since(as_of, _within("days", days, 1, 365)))
    counts = rows.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("total"))
    return counts.orderBy(F.desc("total"), name).limit(_within("limit", limit, 1, 100))


def source_summary(sources: DataFrame) -> DataFrame:
    """One row on the sources that are switched on."""
    return sources.where("enabled").agg(F.count("*").alias("active_sources"), F.max("last_success_at").alias("last_collection_at"), F.count_if(F.col("consecutive_failures") >= 3).alias("failing_sources"))


def summary(records: DataFrame, sources: DataFrame, triggered: DataFrame, as_of: Column) -> DataFrame:
    """The headline numbers in one row, from one pass over each table; ``triggered`` is one row, the number of alert events. ``rollup`` keeps them instead."""
    recent = lambda days: F.count_if(F.col("first_seen_at") >= since(as_of, days))
    a = records.agg(F.count("*").alias("total_leaks"), recent(7).alias("leaks_last_7_days"), recent(30).alias("leaks_last_30_days"), F.count_distinct("actor_group").alias("tracked_groups"))
    return a.crossJoin(source_summary(sources)).crossJoin(triggered.select("alerts_triggered"))  # one row each


def health() -> Column:
    failures = F.col("consecutive_failures")
    return F.when(~F.col("enabled"), "disabled").when(failures == 0, "healthy").when(failures < 3, "degraded").otherwise("failing")


def source_by_slug(sources: DataFrame, slug: str) -> DataFrame:
    return sources.where(F.col("slug") == slug).limit(1)


def source_list(sources: DataFrame, records: DataFrame, enabled: bool | None = None) -> DataFrame:
    """Sources by name, with their number of records, health and the address to collect from."""
    chosen = sources if enabled is None else sources.where(F.col("enabled") == enabled)
    counts = records.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("leak_count"))
    return chosen.join(counts, "id", "left").select("id", "slug", "name", "enabled", "consecutive_failures", F.coalesce("leak_count", F.lit(0)).alias("leak_count"), health().alias("health"), crawl_url(F.col("active_url"), F.col("base_url")).alias("crawl_url")).orderBy("name", "id")


def source_stats(sources: DataFrame) -> DataFrame:
    return sources.agg(F.count("*").alias("total"), F.count_if("enabled").alias("enabled"), F.count_if(F.col("enabled") & (F.col("consecutive_failures") >= 3)).alias("failing"))


def due(sources: DataFrame, as_of: Column, slugs: Sequence[str] | None = None) -> DataFrame:
    """Enabled sources never collected, or not within their interval."""
    rows = sources.where("enabled") if slugs is None else sources.where(F.col("enabled") & F.col("slug").isin(*slugs))
    waited = (F.unix_micros(as_of) - F.unix_micros("last_crawl_at")) / 1e6
    return rows.where(F.col("last_crawl_at").isNull() | (waited >= F.col("crawl_interval_seconds")))


def crawl_status(requests: DataFrame, runs: DataFrame, as_of: Column, stale_minutes: int = 60) -> DataFrame:
    """The newest request, the number queued, and whether collection is under way."""
    newest = F.max_by(F.struct("id", "status"), F.struct("requested_at", "id"))
    a = requests.agg(newest.alias("r"), F.count_if(F.col("status") == "queued").alias("queued"))
    b = runs.agg((F.count_if((F.col("status") == "running") & (F.col("started_at") > as_of - F.make_dt_interval(mins=F.lit(stale_minutes)))) > 0).alias("is_running"))
    return a.crossJoin(b).select(F.col("r.id").alias("latest_id"), F.col("r.status").alias("latest_status"), "queued", "is_running")


def newest(rows: DataFrame, by: str, limit: int) -> DataFrame:
    return rows.orderBy(F.col(by).desc_nulls_first(), F.desc("id")).limit(_within("limit", limit, 1, 100))


def new_since_sync(requests: DataFrame) -> DataFrame:
    """One row, ``since``: when the latest request started, if it succeeded; else null, and nothing counts as new."""
    latest = requests.agg(F.max_by(F.struct("status", "started_at"), F.struct("requested_at", "id")).alias("r"))
    return latest.select(F.when(F.col("r.status") == "succeeded", F.col("r.started_at")).alias("since"))


def latest_arrivals(records: DataFrame, requests: DataFrame, count: int = 6) -> DataFrame:
    """The newest records with title, monogram and whether the latest sync brought them."""
    title = F.coalesce("victim_name", "victim_domain", F.lit(UNNAMED))
    rows = newest(records, "first_seen_at", count).crossJoin(new_since_sync(requests))  # one row
    return rows.select("id", title.alias("title"), F.upper(F.substring(title, 1, 2)).alias("monogram"), F.coalesce(F.col("first_seen_at") >= F.col("since"), F.lit(False)).alias("is_new"))


def claim(requests: DataFrame) -> DataFrame:
    """The queued request that waits longest. A single writer marks it as running."""
    return requests.where("status = 'queued'").orderBy("requested_at", "id").limit(1)


def open_requests(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("status").isin(*OPEN))


def outcome(crawled: Column, failed: Column) -> Column:
    """A finished request's state."""
    return F.when(crawled == 0, "skipped").when(failed >= crawled, "failed").otherwise("succeeded")


def alert_list(rules: DataFrame, counts: DataFrame, owner: str) -> DataFrame:
    """An owner's rules with their number of events (``counts``: alert_id, event_count, of rules that have any)."""
    return rules.where(F.col("owner_id") == owner).join(counts, "alert_id", "left").select("alert_id", "match_kind", "match_value", "enabled", F.coalesce("event_count", F.lit(0)).alias("event_count"))


def alert_events(events: DataFrame, rules: DataFrame, records: DataFrame, owner: str) -> DataFrame:
    """An owner's events with rule and record."""
    own = rules.where(F.col("owner_id") == owner).select("alert_id", "match_kind", "match_value")
    named = records.select(F.col("id").alias("record_id"), "victim_name", "actor_group", "first_seen_at")
    return events.join(own, "alert_id").join(named, "record_id")


def recent_events(met: DataFrame, rules: DataFrame, records: DataFrame, owner: str, limit: int) -> DataFrame:
    """The newest of an owner's events with rule and record, by the record's first sighting, record and rule. ``met`` has
    the meetings of records with the owner's rules.

    Each record that meets a rule has an event at least, so the events looked for are among those of as many of the newest such records; only these are made.
    """
    _within("limit", limit, 1, 100)
    own = rules.where(F.col("owner_id") == owner)
    hits = alerts.certain(met, own).groupBy("record_id").agg(F.collect_list(F.struct(*alerts.PLACE)).alias("hits"))
    named = records.select(F.col("id").alias("record_id"), "victim_name", "actor_group", "first_seen_at")
    newest = hits.join(named, "record_id").orderBy(F.desc("first_seen_at"), F.desc("record_id")).limit(limit)
    events = alerts.expanded(newest.select("record_id", "victim_name", "actor_group", "first_seen_at", F.inline("hits")), own)
    events = events.select("alert_id", "record_id", "matched_on", "match_kind", "match_value", "victim_name", "actor_group", "first_seen_at")
    return events.orderBy(F.desc("first_seen_at"), F.desc("record_id"), F.desc("alert_id")).limit(limit)


def add_rule(rules: DataFrame, alert_id: int, owner: str, kind: str, value: str) -> DataFrame:
    """Rules with one more; its value is trimmed and in lower case."""
    value = value.strip().lower()
    if kind not in ("exact", "domain", "substring", "actor_group") or not 2 <= len(value) <= 200:
        raise ValueError(f"no rule of kind {kind!r} for {value!r}")
    new = rules.sparkSession.createDataFrame([(alert_id, owner, kind, value, True)], "alert_id long, owner_id string, match_kind string, match_value string, enabled boolean")
    return rules.unionByName(new)


def patch_rule(rules: DataFrame, alert_id: int, owner: str, enabled: bool) -> DataFrame:
    mine = (F.col("alert_id") == alert_id) & (F.col("owner_id") == owner)
    return rules.withColumn("enabled", F.when(mine, F.lit(enabled)).otherwise(F.col("enabled")))


def delete_rule(rules: DataFrame, alert_id: int, owner: str) -> DataFrame:
    return rules.where(~((F.col("alert_id") == alert_id) & (F.col("owner_id") == owner)))


def before_end(pages: DataFrame, least: int = 50) -> DataFrame:
    """Pages (listing, page_no, text) before the first that is missing or too short."""
    bad = F.col("text").isNull() | (F.length(F.btrim("text", F.lit(" \t\n\r\f\x0b"))) < least)
    ends = pages.groupBy("listing").agg(F.min(F.when(bad, F.col("page_no"))).alias("_end"))
    return pages.join(ends, "listing").where("_end is null or page_no < _end").drop("_end")
