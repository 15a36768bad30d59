"""Stand-in tables of disclosure monitoring over the driver's star schema.

Each view is built by DataFrame operations from the given Parquet tables, so that its rows
grow with them; ``SQL`` has the same views for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import dedupe_hash

#: "Now" for queries over orders and over events: fixed, so that results can be compared.
AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


def at(moment: str) -> Column:
    return F.to_timestamp(F.lit(moment))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each disclosed record: orders with their customer and nation."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "countdown").otherwise("unknown")
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.col("c_name").alias("victim_name"),
        F.lower(F.replace(F.trim("o_orderpriority"), F.lit(" "), F.lit("-"))).alias("actor_group"),
        status.alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("first_seen_at"),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate").cast("timestamp")).alias("published_at"),
        F.col("o_totalprice").cast("long").alias("leak_size_bytes"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("n_name")).alias("victim_country"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("c_mktsegment")).alias("victim_sector"),
        (F.col("o_custkey") % 120).alias("source_id"),
    )


def listed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with all the columns of a listing."""
    rows = named_records(spark, sf_dir)
    identity = dedupe_hash(F.col("actor_group"), F.col("victim_domain"), F.col("victim_name"))
    return rows.withColumns({
        "dedupe_hash": identity, "source_url": F.concat(F.lit("http://s"), F.col("source_id"), F.lit(".test/")), "published_at_raw": F.date_format("published_at", "d MMM yyyy"),
        "last_seen_at": F.col("first_seen_at") + F.make_dt_interval(days=(F.col("id") % 9).cast("int")), "leak_type": F.lit("ransomware"),
    })


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each monitored source: suppliers."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("id"),
        F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]+", "-")).alias("slug"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("http://"), F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]+", "-")), F.lit(".test/")).alias("base_url"),
        F.when(key % 4 == 0, F.concat(F.lit("http://m"), key.cast("string"), F.lit(".test/"))).when(key % 4 == 1, F.lit("")).alias("active_url"),
        (key % 5).cast("int").alias("consecutive_failures"),
        (key % 7 != 0).alias("enabled"),
        (key % 3 * 3600 + 3600).cast("int").alias("crawl_interval_seconds"),
        F.when(key % 6 != 0, at(EVENTS_AS_OF) - F.make_dt_interval(mins=(key % 300).cast("int"))).alias("last_crawl_at"),
        F.when(key % 6 > 1, at(EVENTS_AS_OF) - F.make_dt_interval(mins=(key % 500).cast("int"))).alias("last_success_at"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each collection run: events, by user as source."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "running").otherwise("succeeded")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("started_at"), F.col("value").alias("value")
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each on-demand request: events again."""
    state = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").otherwise("succeeded")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), state.alias("status"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("source-"), F.col("user_id"))).alias("source_slug"),
        F.col("ts").cast("timestamp").alias("requested_at"), F.when(F.col("event_type") == "error", F.repeat(F.col("props"), F.lit(40))).alias("error"),
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each alert rule: parts. Each names a customer, a part of a name, a domain or a group.

    Groups have few names; only one rule in 50 has one that exists.
    """
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("exact", "actor_group", "substring", "domain"))), (k % 4 + 1).cast("int"))
    existing = F.concat((k % 5 + 1).cast("string"), F.element_at(F.array(*map(F.lit, ("-urgent", "-high", "-medium", "-not-specified", "-low"))), (k % 5 + 1).cast("int")))
    value = (
        F.when(k % 4 == 0, F.concat(F.lit("customer#"), F.lpad(k.cast("string"), 9, "0")))
        .when(k % 4 == 1, F.when(k % 200 == 1, existing).otherwise(F.concat(F.lit("group-"), k)))
        .when(k % 4 == 2, F.when(k % 100 == 2, F.concat(F.lit("#"), F.lpad(k.cast("string"), 9, "0"))).otherwise(F.concat(F.lpad(k.cast("string"), 7, "0"))))
        .otherwise(F.when(k % 100 == 3, F.concat(F.lit("c"), k, F.lit("_.test"))).otherwise(F.concat(F.lit("c"), k, F.lit(".test"))))
    )
    return table(spark, sf_dir, "part").select(k.alias("alert_id"), F.concat(F.lit("owner"), k % 5).alias("owner_id"), kind.alias("match_kind"), value.alias("match_value"), (k % 9 != 0).alias("enabled"))


def named_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a domain, for alert rules."""
    host = F.concat(F.lit("www"), F.col("id") % 3, F.lit(".c"), F.regexp_extract("victim_name", "([1-9][0-9]*)$", 1), F.lit(".test"))
    return records(spark, sf_dir).withColumn("victim_domain", F.when(F.col("id") % 4 == 0, host))


_SLUG = "lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '-', 'g'))"
#: The same views for the oracle, as common table expressions.
SQL = {
    "records": """records AS (SELECT o_orderkey AS id, c_name AS victim_name, lower(replace(trim(o_orderpriority), ' ', '-')) AS actor_group,
        CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'countdown' ELSE 'unknown' END AS status, o_orderdate AS first_seen_at,
        CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS published_at, CAST(trunc(o_totalprice) AS BIGINT) AS leak_size_bytes,
        CASE WHEN o_orderkey % 7 <> 0 THEN n_name END AS victim_country, CASE WHEN o_orderkey % 11 <> 0 THEN c_mktsegment END AS victim_sector, o_custkey % 120 AS source_id
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "sources": f"""sources AS (SELECT s_suppkey AS id, {_SLUG} AS slug, s_name AS name, 'http://' || {_SLUG} || '.test/' AS base_url,
        CASE s_suppkey % 4 WHEN 0 THEN 'http://m' || s_suppkey || '.test/' WHEN 1 THEN '' END AS active_url, CAST(s_suppkey % 5 AS INTEGER) AS consecutive_failures,
        s_suppkey % 7 <> 0 AS enabled, CAST(s_suppkey % 3 * 3600 + 3600 AS INTEGER) AS crawl_interval_seconds,
        CASE WHEN s_suppkey % 6 <> 0 THEN TIMESTAMP '{EVENTS_AS_OF}' - to_minutes(CAST(s_suppkey % 300 AS INTEGER)) END AS last_crawl_at,
        CASE WHEN s_suppkey % 6 > 1 THEN TIMESTAMP '{EVENTS_AS_OF}' - to_minutes(CAST(s_suppkey % 500 AS INTEGER)) END AS last_success_at FROM supplier)""",
    "runs": """runs AS (SELECT event_id AS id, user_id AS source_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'succeeded' END AS status,
        ts AS started_at, value FROM events)""",
    "requests": """requests AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status,
        CASE WHEN event_id % 3 > 0 THEN 'source-' || user_id END AS source_slug, ts AS requested_at, CASE WHEN event_type = 'error' THEN repeat(props, 40) END AS error FROM events)""",
    "rules": """rules AS (SELECT p_partkey AS alert_id, 'owner' || (p_partkey % 5) AS owner_id, CASE p_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'actor_group' WHEN 2 THEN 'substring' ELSE 'domain' END AS match_kind,
        CASE p_partkey % 4 WHEN 0 THEN 'customer#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')
        WHEN 1 THEN CASE WHEN p_partkey % 200 = 1 THEN (p_partkey % 5 + 1) || CASE p_partkey % 5 WHEN 0 THEN '-urgent' WHEN 1 THEN '-high' WHEN 2 THEN '-medium' WHEN 3 THEN '-not-specified' ELSE '-low' END ELSE 'group-' || p_partkey END
        WHEN 2 THEN CASE WHEN p_partkey % 100 = 2 THEN '#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') ELSE lpad(CAST(p_partkey AS VARCHAR), 7, '0') END
        ELSE CASE WHEN p_partkey % 100 = 3 THEN 'c' || p_partkey || '_.test' ELSE 'c' || p_partkey || '.test' END END AS match_value, p_partkey % 9 <> 0 AS enabled FROM part)""",
    "named": """named AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'www' || (id % 3) || '.c' || regexp_extract(victim_name, '([1-9][0-9]*)$', 1) || '.test' END AS victim_domain FROM records)""",
}


def sql(views: str, query: str) -> str:
    """``query`` behind the views it names (comma-separated)."""
    return "WITH " + ", ".join(SQL[v.strip()] for v in views.split(",")) + " " + query
