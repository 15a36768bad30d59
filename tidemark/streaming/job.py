"""Structured Streaming forms: daily counts, keyed state with timers, first contents and alerts on arrival.

What a stream knows of its keys is in Spark's state store; what it puts out is in a folder that all executors share:
under a batch's number, or in a committed table by key. So a batch that runs again after a failure replaces its own
result only.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions.text import content_hash
from ..operators import alerts, committed, maintain

#: After so long a timer of a replay that goes off too early is looked at again.
AGAIN_MS = 3_600_000
#: Slots that runs are dealt to; each has its open runs in one value of the state, and one timer.
SLOTS = 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where that is unset on one machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream, with a time that watermarks accept.

    The source takes a single file only by a pattern.
    """
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def page_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of pages: source and hash of the content."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.readStream.schema(schema).parquet(f"{sf_dir}/document[s].parquet")
    return docs.select(F.col("source").alias("source_id"), content_hash(F.col("text")).alias("content_sha256"))


def drain(frame: DataFrame, each, mode: str, folder: str) -> None:
    """Process what is there in micro-batches, then stop."""
    query = frame.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def settle(frame: DataFrame, each, mode: str, folder: str) -> None:
    """Process what is there in micro-batches, then stop: for frames with timers on the clock, which never end by themselves
    since there may be another to go off. The batch behind the last input looks at them once more."""
    query = frame.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="0 seconds").start()
    try:
        while not query.awaitTermination(0.1):
            if (done := query.lastProgress) and not done["numInputRows"]:
                break
    finally:
        query.stop()


def daily_counts(events: DataFrame, folder: str, late: str | None = None) -> DataFrame:
    """date, event_type, total: counts of one-day windows, of all rows in whatever order they come.

    Each batch writes its own counts, which are added up at the end. For live input, ``late`` bounds
    the state instead: a watermark; rows that are later than that may be dropped.
    """

    def each(batch: DataFrame, number: int) -> None:
        day = F.to_date("window.start" if late else "ts").alias("date")
        counts = batch.select(day, "event_type", "total") if late else batch.groupBy(day, "event_type").agg(F.count("*").alias("total"))
        counts.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/counts/number={number}")

    if late:
        drain(events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("total")), each, "update", folder)
    else:
        drain(events.select("ts", "event_type"), each, "append", folder)
    saved = events.sparkSession.read.parquet(f"{folder}/counts").groupBy("date", "event_type")
    return saved.agg((F.max_by("total", "batch") if late else F.sum("total")).alias("total"))


def sightings(events: DataFrame) -> DataFrame:
    """Events as sightings of what their user stands for: key, number, time, state and value."""
    status = F.when(F.col("event_type") == "error", "removed").when(F.col("event_type") == "signup", "unknown").otherwise("published")
    value = F.when(F.col("event_type") != "view", F.col("value").cast("long"))
    return events.select(F.col("user_id").cast("string").alias("dedupe_hash"), F.col("event_id").alias("seq"), "ts", status.alias("status"), value.alias("leak_size_bytes"))


def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """A table's rows with those of a batch put in, a row a key: the last that came of it."""
    last = new.groupBy("key").agg(F.max_by(F.struct(*[c for c in new.columns if c not in ("key", "step")]), "step").alias("row"))
    return old.join(last.select("key"), "key", "left_anti").unionByName(last.select("key", "row.*"))


def state_of(events: DataFrame, processor: StatefulProcessor, key: str, schema: str, folder: str, buckets: int = 16) -> committed.Table:
    """Run a stateful processor over a stream, by ``key``; its state is in RocksDB, so a batch touches only the keys it has
    rows or timers of. What it puts out (``schema`` behind key and step) replaces the key's row in a committed
    table, which a batch that runs again does alike."""
    spark = events.sparkSession
    kept = committed.Table(spark, f"{folder}/table", "key", buckets)
    if not kept.versions():
        kept.create(spark.createDataFrame([], f"key string, {schema}"))

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            if not rows.isEmpty():
                kept.update(rows, _replaced)
        finally:
            rows.unpersist()

    _processed(events.withColumn("key", F.col(key).cast("string")), processor, "key", schema, each, folder, False)
    return kept


def _processed(rows: DataFrame, processor: StatefulProcessor, by: str, schema: str, each: Callable[[DataFrame, int], None], folder: str, timers: bool) -> None:
    """Run a stateful processor over a stream, by a column, and give what each batch puts out (key, step and ``schema``) to a function."""
    spark = rows.sparkSession
    setting, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(setting, ROCKSDB)
    try:
        out = rows.groupBy(by).transformWithStateInPandas(processor, f"key string, step int, {schema}", "Update", "ProcessingTime" if timers else "None")
        (settle if timers else drain)(out, each, "update", folder)
    finally:
        spark.conf.set(setting, before)


class Seen(StatefulProcessor):
    """What is known of a key after its sightings, in whatever order they come: the state and the value of the latest that has
    one, by their number, and the times of the first and the last."""

    FIELDS = "status string, status_seq long, leak_size_bytes long, size_seq long, first_seen_at timestamp, last_seen_at timestamp"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", self.FIELDS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        status, status_seq, size, size_seq, first, last = self.known.get() if self.known.exists() else ("unknown", -1, None, -1, None, None)
        for part in rows:
            telling = part[part["status"] != "unknown"]
            if len(telling) and (top := telling.loc[telling["seq"].idxmax()])["seq"] > status_seq:
                status, status_seq = top["status"], int(top["seq"])
            sized = part[part["leak_size_bytes"].notna()]
            if len(sized) and (top := sized.loc[sized["seq"].idxmax()])["seq"] > size_seq:
                size, size_seq = int(top["leak_size_bytes"]), int(top["seq"])
            if part["ts"].notna().any():
                low, high = part["ts"].min().to_pydatetime(), part["ts"].max().to_pydatetime()
                first, last = min(first or low, low), max(last or high, high)
        self.known.update((status, status_seq, size, size_seq, first, last))
        size = pd.array([size], "Int64")
        yield pd.DataFrame({"key": [key[0]], "step": [0], "status": [status], "leak_size_bytes": size, "first_seen_at": pd.to_datetime([first]), "last_seen_at": pd.to_datetime([last])})

    def close(self) -> None:
        pass


def keyed_state(events: DataFrame, folder: str) -> DataFrame:
    """Each source's record after all batches: state, value, first and last sighting.

    A sighting arrives at its own time. Late ones count by their number: they never undo what a later one said, and the
    result is that of ``maintain.fold`` over all rows, however files and batches divide them. A restart with the
    same folder goes on from the state.
    """
    kept = state_of(sightings(events), Seen(), "dedupe_hash", "status string, leak_size_bytes long, first_seen_at timestamp, last_seen_at timestamp", folder)
    return kept.read().withColumnRenamed("key", "dedupe_hash")


class Abandoned(StatefulProcessor):
    """Runs that are given up when their time is over. They come by slots: a slot keeps its open runs and one timer, for the run
    whose time is over first. Ended runs leave nothing, and no call is made for a single run."""

    def __init__(self, seconds: int, as_of_ms: int | None = None):
        self.seconds, self.as_of = seconds, as_of_ms
        self.ahead = 0 if as_of_ms is None else int(time.time() * 1000) - as_of_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "runs array<string>, since array<long>")

    def _over(self, since: int) -> int:
        """When a run's time is over, in the events' time; strictly later than its limit counts."""
        return since + self.seconds * 1000 + 1

    def _known(self) -> dict[str, int]:
        return dict(zip(*self.open.get())) if self.open.exists() else {}

    def _keep(self, known: dict[str, int], earliest: int = 0) -> None:
        """Keep these open runs, and look at them when the first is over."""
        if not known:
            self.open.clear()
            return
        self.open.update((list(known), list(known.values())))
        self.handle.registerTimer(max(self._over(min(known.values())) + self.ahead, earliest))

    @staticmethod
    def _rows(keys: list[str], step: int, status: list[str], error: str | None) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series(keys, dtype=object), "step": np.int32(step), "status": pd.Series(status, dtype=object), "error": pd.Series([error] * len(keys), dtype=object)})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows), ignore_index=True)
        # Of several rows of a run the one furthest on counts: a run that has ended is not running again.
        part = part.iloc[np.argsort((part["status"] != "running").to_numpy(), kind="stable")].drop_duplicates("key", keep="last")
        known = self._known()
        before = dict(known)
        running = (part["status"] == "running").to_numpy() & part["since"].notna().to_numpy()  # one without a start is never over
        for run in part["key"][~running]:
            known.pop(run, None)
        known.update(zip(part["key"][running], map(int, part["since"][running])))
        if known != before:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self._keep(known)
        yield self._rows(part["key"].tolist(), 0, part["status"].tolist(), None)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        # In a replay now stands still while this machine's clock goes on: what isn't over by then is looked at again later.
        known, clock = self._known(), timerValues.getCurrentProcessingTimeInMs()
        now = max(clock, expiredTimerInfo.getExpiryTimeInMs()) if self.as_of is None else self.as_of
        over = [run for run, since in known.items() if self._over(since) <= now]
        for run in over:
            del known[run]
        self._keep(known, 0 if self.as_of is None else clock + AGAIN_MS)
        if over:
            yield self._rows(over, 1, ["failed"] * len(over), maintain.STOPPED)

    def close(self) -> None:
        pass


def abandoned(runs: DataFrame, folder: str, seconds: int, as_of_ms: int | None = None) -> DataFrame:
    """id, status and error of a stream of runs (id, status, started_at): a run that is running for more than ``seconds``
    fails when a timer goes off. For a replay, ``as_of_ms`` is the moment that stands for now, however long the replay takes.

    Each batch writes its own rows; the last of a run counts when they are read."""
    kind = runs.schema["id"].dataType

    def each(batch: DataFrame, number: int) -> None:
        batch.select(F.col("key").cast(kind).alias("id"), "step", "status", "error").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/rows/number={number}")

    dealt = runs.select(F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int").alias("slot"), F.col("id").cast("string").alias("key"), "status", F.unix_millis("started_at").alias("since"))
    with committed.released(runs.sparkSession):
        _processed(dealt, Abandoned(seconds, as_of_ms), "slot", "status string, error string", each, folder, True)
    told = runs.sparkSession.read.parquet(f"{folder}/rows").groupBy("id")
    return told.agg(F.max_by(F.struct("status", "error"), F.struct("number", "step")).alias("last")).select("id", "last.status", "last.error")


def alerts_on_arrival(events: DataFrame, rules: DataFrame, folder: str) -> DataFrame:
    """alert_id, record_id and matched_on of a stream of records: each batch is matched by itself, and only
    its records that no batch before it had, by the ids in the state store. A batch that runs again replaces its own
    alerts. Of several rows of an id the first to come counts; rows without an id aren't records.

    ``events``: id, victim_name, victim_domain, actor_group; ``rules`` as in ``alerts.match``.
    """

    def each(batch: DataFrame, number: int) -> None:
        alerts.match(batch, rules).write.mode("overwrite").parquet(f"{folder}/alerts/number={number}")

    drain(events.where(F.col("id").isNotNull()).dropDuplicates(["id"]), each, "append", folder)
    return events.sparkSession.read.parquet(f"{folder}/alerts").drop("number")


def first_within(events: DataFrame, keys: list[str], within: str, folder: str) -> DataFrame:
    """The keys of a stream of events (with time ``ts``), each once for as long as it may come again: the state forgets a key
    when the watermark has passed its time by ``within``. Events that are later than that are dropped."""

    def each(batch: DataFrame, number: int) -> None:
        batch.select(keys).write.mode("overwrite").parquet(f"{folder}/keys/number={number}")

    drain(events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys), each, "append", folder)
    return events.sparkSession.read.parquet(f"{folder}/keys").drop("number")


def first_contents(pages: DataFrame, folder: str) -> DataFrame:
    """Each (source_id, content_sha256) of a stream of pages once, however often it comes.

    The state keeps every hash seen, as the batch form's table of known pages does; ``first_within`` is the form whose
    state is bounded.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/contents/number={number}")

    drain(pages.select("source_id", "content_sha256").dropDuplicates(), each, "append", folder)
    return pages.sparkSession.read.parquet(f"{folder}/contents").drop("number")
