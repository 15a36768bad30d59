"""Keyed maintenance without MERGE: fold a batch, join it with the last snapshot, write a new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

#: Columns of which the latest known value stays.
MERGED = ("victim_name", "victim_domain", "victim_country", "victim_sector", "published_at", "published_at_raw", "leak_size_bytes", "source_url")
#: Columns that the first sighting sets for good.
FIRST = ("actor_group", "source_id", "leak_type")
#: Fixed value: the error of work that was given up.
STOPPED = "worker stopped before this crawl finished"


def fold(batch: DataFrame, key: str = "dedupe_hash", seq: str = "seq") -> DataFrame:
    """One row for each key of a batch, as if its rows had been applied in order of ``seq``.

    Partial aggregates combine before the shuffle, so that a hot key is no burden.
    """
    merged = [c for c in MERGED if c in batch.columns]
    firsts = [c for c in FIRST if c in batch.columns]
    keep = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c)
    known = F.max_by("status", F.when(F.col("status") != "unknown", F.col(seq)))
    latest = [F.max_by(c, seq).alias(c) for c in ("extraction",) if c in batch.columns]
    return batch.groupBy(key).agg(*map(keep, merged), *[F.min_by(c, seq).alias(c) for c in firsts], F.coalesce(known, F.lit("unknown")).alias("status"), *latest, F.count("*").alias("sightings"))


def upsert(snapshot: DataFrame, folded: DataFrame, now: Column, key: str = "dedupe_hash") -> DataFrame:
    """The next snapshot. ``folded`` is what ``fold`` returns; is_new marks keys that were absent."""
    merged = [c for c in MERGED if c in folded.columns and c in snapshot.columns]
    firsts = [c for c in FIRST if c in folded.columns and c in snapshot.columns]
    old, new = snapshot.alias("old"), folded.alias("new")
    there, seen = F.col(f"old.{key}").isNotNull(), F.col(f"new.{key}").isNotNull()
    status = F.when(~seen | (there & (F.col("new.status") == "unknown")), F.col("old.status")).otherwise(F.col("new.status"))
    return old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer").select(
        F.coalesce(f"new.{key}", f"old.{key}").alias(key),
        *[F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in merged],
        *[F.when(there, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in firsts],
        *[F.when(seen, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in ("extraction",) if c in folded.columns and c in snapshot.columns],
        status.alias("status"),
        F.when(there, F.col("old.first_seen_at")).otherwise(now).alias("first_seen_at"),
        F.when(seen, now).otherwise(F.col("old.last_seen_at")).alias("last_seen_at"),
        (~there).alias("is_new"),
        F.coalesce("new.sightings", F.lit(0)).alias("sightings"),
    )


def outcome(merged: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row: inserted, updated, skipped."""
    counts = merged.agg(F.count_if("is_new").alias("inserted"), F.coalesce(F.sum(F.col("sightings") - F.col("is_new").cast("int")), F.lit(0)).alias("updated"))
    return counts if skipped is None else counts.crossJoin(F.broadcast(skipped.agg(F.count("*").alias("skipped"))))


def changed_pages(fetched: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Pages whose content is new for their source: the first of each hash that isn't known.

    ``fetched``: id, source_id, content_sha256; ``known``: source_id, content_sha256.
    """
    first = fetched.groupBy("source_id", "content_sha256").agg(F.min("id").alias("id"))
    return first if known is None else first.join(known, ["source_id", "content_sha256"], "left_anti")


def absent(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-if-absent: one row for each key that doesn't exist yet."""
    return rows.dropDuplicates(keys).join(existing, keys, "left_anti")


def sync(existing: DataFrame, definitions: DataFrame) -> DataFrame:
    """Sources after their definitions are applied: configuration is taken over, health and
    ``enabled`` stay; new sources take all of the definition."""
    config = [c for c in definitions.columns if c not in ("slug", "enabled")]
    state = [c for c in existing.columns if c not in definitions.columns]
    old, new = existing.alias("old"), definitions.alias("new")
    pick = lambda c: F.when(F.col("new.slug").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
    return old.join(new, F.col("old.slug") == F.col("new.slug"), "full_outer").select(F.coalesce("old.slug", "new.slug").alias("slug"), *map(pick, config), F.coalesce("old.enabled", "new.enabled").alias("enabled"), *[F.col(f"old.{c}").alias(c) for c in state], F.col("old.slug").isNull().alias("is_new"))


def prune(existing: DataFrame, keep: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources whose slug is kept, and records with the source of pruned ones set to null."""
    kept = existing.join(keep.select("slug").distinct(), "slug", "left_semi")
    ids = kept.select(F.col("id").alias("_kept"))
    marked = records.join(ids, F.col("source_id") == F.col("_kept"), "left")
    return kept, marked.withColumn("source_id", F.col("_kept")).drop("_kept")


def record_mirrors(existing: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Mirrors after sightings (source_id, onion_host, url, status, seq) are recorded.

    Rejected stays rejected; a candidate takes the status of its sightings in turn, until one
    makes it something else; any other status stays.
    """
    first_set = F.min_by("status", F.when(F.col("status") != "candidate", F.col("seq")))
    folded = seen.groupBy("source_id", "onion_host").agg(F.min_by("url", "seq").alias("url"), F.coalesce(first_set, F.lit("candidate")).alias("status"), F.count("*").alias("sightings"))
    old, new = existing.alias("old"), folded.alias("new")
    both = (F.col("old.source_id") == F.col("new.source_id")) & (F.col("old.onion_host") == F.col("new.onion_host"))
    status = F.when(F.col("old.status") == "candidate", F.coalesce("new.status", "old.status")).otherwise(F.coalesce("old.status", "new.status"))
    return old.join(new, both, "full_outer").select(
        F.coalesce("old.source_id", "new.source_id").alias("source_id"), F.coalesce("old.onion_host", "new.onion_host").alias("onion_host"), F.coalesce("old.url", "new.url").alias("url"), status.alias("status"),
        (F.coalesce("old.times_seen", F.lit(0)) + F.coalesce("new.sightings", F.lit(0))).alias("times_seen"),
        F.when(F.col("new.source_id").isNotNull(), now).otherwise(F.col("old.last_seen_at")).alias("last_seen_at"),
    )


def failover(mirrors: DataFrame, most: int = 5) -> DataFrame:
    """For each source the addresses worth trying, the best first."""
    order = Window.partitionBy("source_id").orderBy((F.col("status") == "approved").desc(), F.col("last_ok_at").desc_nulls_last(), F.col("times_seen").desc(), "onion_host")
    return mirrors.where(F.col("status").isin("approved", "self_declared")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def expire(rows: DataFrame, as_of: Column, seconds: int, keep_error: bool) -> DataFrame:
    """Running rows older than ``seconds`` become failed; runs keep an error that they have."""
    stale = (F.col("status") == "running") & (F.col("started_at") < as_of - F.make_dt_interval(secs=F.lit(seconds)))
    error = F.coalesce("error", F.lit(STOPPED)) if keep_error else F.lit(STOPPED)
    return rows.withColumns({"error": F.when(stale, error).otherwise(F.col("error")), "finished_at": F.when(stale, as_of).otherwise(F.col("finished_at")), "status": F.when(stale, "failed").otherwise(F.col("status"))})


def failure_streak(runs: DataFrame) -> DataFrame:
    """For each source the number of finished runs that failed since its last success."""
    done = runs.where("status <> 'running'")
    last = done.groupBy("source_id").agg(F.max(F.when(F.col("status") == "succeeded", F.struct("started_at", "id"))).alias("good"))
    joined = done.join(last, "source_id")
    return joined.groupBy("source_id").agg(F.count_if(F.col("good").isNull() | (F.struct("started_at", "id") > F.col("good"))).alias("consecutive_failures"))


def repair(records: DataFrame, fixes: DataFrame) -> DataFrame:
    """Re-key records (actor_group, victim_name -> victim_domain, new_hash), or merge them into the
    record that already has the new key, which keeps the earlier first sighting."""
    fixes = fixes.select("actor_group", F.lower("victim_name").alias("_name"), F.col("victim_domain").alias("_domain"), F.col("new_hash").alias("_hash")).dropDuplicates(["actor_group", "_name"])
    oldest = records.groupBy("actor_group", F.lower("victim_name").alias("_name")).agg(F.min_by("id", F.struct("first_seen_at", "id")).alias("id"))
    chosen = oldest.join(fixes, ["actor_group", "_name"]).select("id", "_domain", "_hash")
    moved = records.join(chosen, "id", "left")
    # Rows that end up under one key: the one that had it stays, with the earliest sighting of all.
    target = moved.withColumn("_key", F.coalesce("_hash", "dedupe_hash")).withColumn("_own", F.col("_key") == F.col("dedupe_hash"))
    first = target.groupBy("_key").agg(F.min("first_seen_at").alias("_first"), F.max_by("id", F.struct(F.col("_own"), -F.col("id"))).alias("id"))
    kept = target.drop("_key").join(first, "id")
    return kept.withColumns({"first_seen_at": F.col("_first"), "victim_domain": F.coalesce("_domain", "victim_domain"), "dedupe_hash": F.col("_key")}).select(records.columns)


def without_fragment_names(records: DataFrame, fragments: list[str]) -> DataFrame:
    """Names made of fragments alone are blanked where a domain identifies the record."""
    only = F.forall(F.split(F.lower("victim_name"), " "), lambda w: F.btrim(w, F.lit(".,")).isin(*fragments))
    return records.withColumn("victim_name", F.when(F.col("victim_domain").isNull() | ~only, F.col("victim_name")))


def absent_count(rows: DataFrame, existing: DataFrame, key: str = "dedupe_hash") -> DataFrame:
    """What an upsert would do, without doing it: one row, the keys that are new and those known."""
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    return rows.select(key).distinct().join(known, key, "left").agg(F.count_if(F.col("_known").isNull()).alias("new_keys"), F.count_if("_known").alias("known_keys"))


def list_mirrors(mirrors: DataFrame, sources: DataFrame, slug: str | None = None) -> DataFrame:
    """Mirrors with the slug of their source, of one source if given, by slug and then the most seen first."""
    chosen = sources if slug is None else sources.where(F.col("slug") == slug)
    listed = mirrors.join(chosen.select(F.col("id").alias("source_id"), "slug"), "source_id").drop("source_id")
    return listed.orderBy("slug", F.desc("times_seen"), "onion_host")


def set_mirror_status(mirrors: DataFrame, sources: DataFrame, changes: DataFrame) -> DataFrame:
    """Mirrors after changes (slug, onion_host, status); of several for one mirror the least status counts."""
    ids = sources.select(F.col("id").alias("source_id"), "slug")
    wanted = changes.join(ids, "slug").groupBy("source_id", "onion_host").agg(F.min("status").alias("_status"))
    return mirrors.join(wanted, ["source_id", "onion_host"], "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def promote(sources: DataFrame, mirrors: DataFrame, chosen: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Sources that are collected at their chosen mirror (source_id, onion_host, url) from now on, and
    mirrors with the time it worked. The base address stays."""
    one = chosen.groupBy("source_id").agg(F.min(F.struct("url", "onion_host")).alias("_c"))
    moved = sources.join(one.select(F.col("source_id").alias("id"), "_c"), "id", "left").withColumn("active_url", F.coalesce("_c.url", "active_url")).drop("_c")
    hosts = one.select("source_id", F.col("_c.onion_host").alias("onion_host"), F.lit(True).alias("_ok"))
    worked = mirrors.join(hosts, ["source_id", "onion_host"], "left").withColumn("last_ok_at", F.when(F.col("_ok"), now).otherwise(F.col("last_ok_at"))).drop("_ok")
    return moved, worked


def _of(sources: DataFrame, slugs: DataFrame | None) -> DataFrame:
    """Sources with ``_named``: whether their slug is among those given; all are if none are given."""
    if slugs is None:
        return sources.withColumn("_named", F.lit(True))
    named = slugs.select("slug").distinct().withColumn("_named", F.lit(True))
    return sources.join(named, "slug", "left").withColumn("_named", F.coalesce("_named", F.lit(False)))


def clear_active_url(sources: DataFrame, slugs: DataFrame) -> DataFrame:
    """Named sources (slug) go back to their base address."""
    return _of(sources, slugs).withColumn("active_url", F.when(~F.col("_named"), F.col("active_url"))).drop("_named")


def set_enabled(sources: DataFrame, enabled: bool, slugs: DataFrame | None = None) -> DataFrame:
    """Switch all sources, or the named ones (slug), on or off."""
    return _of(sources, slugs).withColumn("enabled", F.when(F.col("_named"), F.lit(enabled)).otherwise(F.col("enabled"))).drop("_named")


def finish_requests(requests: DataFrame, results: DataFrame, now: Column, longest: int = 1000) -> DataFrame:
    """Requests after results (id, status, error) arrive: state, time, and the error, cut, or null if empty."""
    done = results.select("id", F.col("status").alias("_status"), F.col("error").alias("_error"))
    rows = requests.join(done, "id", "left")
    ended = F.col("_status").isNotNull()
    error = F.nullif(F.substring("_error", 1, longest), F.lit(""))
    finished = F.col("finished_at") if "finished_at" in requests.columns else F.lit(None).cast("timestamp")
    return rows.withColumns({"error": F.when(ended, error).otherwise(F.col("error")), "finished_at": F.when(ended, now).otherwise(finished), "status": F.coalesce("_status", "status")}).drop("_status", "_error")


def start_crawls(runs: DataFrame, started: DataFrame) -> DataFrame:
    """Runs with one more, as running, for each of ``started`` (id, source_id, started_at)."""
    return runs.unionByName(started.select("id", "source_id", "started_at", F.lit("running").alias("status")), allowMissingColumns=True)


#: What a finished run records of its crawl.
METRICS = ("pages_fetched", "pages_changed", "bytes_fetched", "error")


def finish_crawls(runs: DataFrame, results: DataFrame, sources: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Runs after ``results`` (id, status and ``METRICS``), and the health of their sources.

    A source's failures are counted on from what they were, over its results in order of the runs'
    ids: a success sets them to 0.
    """
    done = results.select("id", F.col("status").alias("_status"), *[F.col(c).alias(f"_{c}") for c in METRICS])
    ended = F.col("_status").isNotNull()
    kept = lambda c: F.col(c) if c in runs.columns else F.lit(None).cast(results.schema[c].dataType if c in results.columns else "timestamp")
    rows = runs.join(done, "id", "left")
    rows = rows.withColumns({**{c: F.when(ended, F.col(f"_{c}")).otherwise(kept(c)) for c in METRICS}, "finished_at": F.when(ended, now).otherwise(kept("finished_at")), "status": F.coalesce("_status", "status")})
    finished = rows.drop("_status", *[f"_{c}" for c in METRICS])
    outcomes = results.select("id", "status").join(runs.select("id", "source_id"), "id")
    good = F.max(F.when(F.col("status") == "succeeded", F.col("id")))
    last = outcomes.groupBy("source_id").agg(good.alias("_good"))
    since = outcomes.join(last, "source_id").groupBy("source_id").agg(F.max("_good").alias("_good"), F.count_if(F.col("_good").isNull() | (F.col("id") > F.col("_good"))).cast("int").alias("_failed"))
    joined = sources.join(since.withColumnRenamed("source_id", "id"), "id", "left")
    ran, won = F.col("_failed").isNotNull(), F.col("_good").isNotNull()
    health = joined.withColumns({
        "last_crawl_at": F.when(ran, now).otherwise(F.col("last_crawl_at")), "last_success_at": F.when(won, now).otherwise(F.col("last_success_at")),
        "consecutive_failures": F.when(won, F.col("_failed")).when(ran, F.col("consecutive_failures") + F.col("_failed")).otherwise(F.col("consecutive_failures")),
    })
    return finished, health.drop("_good", "_failed")


def mark_extracted(pages: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Pages of which ``done`` (id) were extracted now."""
    marked = done.select("id").distinct().withColumn("_done", F.lit(True))
    return pages.join(marked, "id", "left").withColumn("extracted_at", F.when(F.col("_done"), now).otherwise(F.col("extracted_at"))).drop("_done")


def claim(requests: DataFrame, now: Column) -> DataFrame:
    """Requests after the queued one that waits longest is claimed: running, from now. A single writer does this."""
    first = requests.where("status = 'queued'").agg(F.min(F.struct("requested_at", "id")).alias("_first"))  # one row
    mine = F.col("_first.id") == F.col("id")
    started = F.col("started_at") if "started_at" in requests.columns else F.lit(None).cast("timestamp")
    rows = requests.crossJoin(F.broadcast(first))
    return rows.withColumns({"started_at": F.when(mine, now).otherwise(started), "status": F.when(mine, "running").otherwise(F.col("status"))}).drop("_first")


def save_snapshot(table: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a snapshot under ``name`` (names are times, and sort by them), verify it, point to it, and return it.

    It is read back: its columns and its number of rows must be those of what was to be written. The pointer is a row of its
    own, written after that; readers follow it (``open_snapshot``), so a snapshot that was cut off or that isn't whole is never seen.
    """
    spark, seen = table.sparkSession, Observation()
    path = f"{folder}/data/snapshot={name}"
    table.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").parquet(path)
    saved = spark.read.parquet(path)
    rows = saved.count()
    if saved.dtypes != table.dtypes or rows != seen.get["rows"]:
        raise OSError(f"snapshot {name} is not what was to be saved")
    spark.createDataFrame([(name, rows)], "name string, rows long").write.mode("overwrite").parquet(f"{folder}/pointers/pointer={name}")
    return saved


def snapshots(spark, folder: str, keep: int = 7) -> DataFrame:
    """name, rows and place of the newest ``keep`` finished snapshots."""
    listed = spark.read.parquet(f"{folder}/pointers").select("name", "rows")
    return listed.orderBy(F.desc("name")).limit(keep).withColumn("place", F.row_number().over(Window.orderBy(F.desc("name"))))


def open_snapshot(spark, folder: str) -> DataFrame:
    """The newest finished snapshot."""
    name = snapshots(spark, folder, 1).first()["name"]
    return spark.read.parquet(f"{folder}/data/snapshot={name}")


def remove_snapshots(spark, folder: str, before: str, keep: int = 1) -> list[str]:
    """Remove snapshots whose name, a time, is before ``before``, finished or cut off, but for the newest ``keep`` finished
    ones; first their pointers, then their data. Returns their names."""
    kept = {r["name"] for r in snapshots(spark, folder, keep).collect()}
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = {f.getPath().getName().removeprefix("snapshot=") for f in files.listStatus(path(f"{folder}/data"))}
    gone = sorted(n for n in held if n < before and n not in kept)
    for name in gone:
        files.delete(path(f"{folder}/pointers/pointer={name}"), True)
        files.delete(path(f"{folder}/data/snapshot={name}"), True)
    return gone


def roll_up(results: DataFrame) -> DataFrame:
    """One row for each collection run of ``results`` (run_id, slug, status, inserted, updated, new_ids): how many of its sources
    were collected and failed, what they brought in all, the slugs of the failed and the ids of the new records, in order.

    A run has at most one result a source, so its lists are bounded by the sources and what a crawl brings."""
    failed = F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("slug"))))
    return results.groupBy("run_id").agg(
        F.count("*").alias("crawled"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("inserted"), F.lit(0)).alias("inserted"), F.coalesce(F.sum("updated"), F.lit(0)).alias("updated"),
        failed.alias("failed_slugs"), F.array_sort(F.flatten(F.collect_list("new_ids"))).alias("new_ids"),
    )


def add_request(requests: DataFrame, request_id: int, slug: str | None, as_of: Column) -> DataFrame:
    """Requests with one more, unless one is open already: then that one serves."""
    new = requests.sparkSession.range(request_id, request_id + 1).select("id", F.lit("queued").alias("status"), F.lit(slug).cast("string").alias("source_slug"), as_of.alias("requested_at"))
    is_open = requests.where(F.col("status").isin("queued", "running")).select(F.lit(request_id).cast("long").alias("id")).limit(1)
    return requests.unionByName(new.join(is_open, "id", "left_anti"), allowMissingColumns=True)
