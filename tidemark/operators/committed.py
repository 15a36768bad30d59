"""Keyed tables with commits, in a folder that all executors share.

Rows lie in buckets by a hash of their key, as Parquet files that never change. A commit writes anew only the buckets
that a batch touches and then publishes a manifest: a JSON file under the next version's number that names the
folder of every bucket, with its rows. Readers follow the newest manifest, so data of a commit that was cut
off are never seen, and a reader's version stays as it is while others commit.

A manifest is published by a rename that fails if the version exists (in HDFS at once; on a local disk, which tests
use, by a look before it). A writer that finds its version taken looks
at what has been committed since it read: if none of its own buckets, its buckets go on top of those;
else ``Conflict`` is raised and the caller starts over from the newest version (``update`` does).

Before the manifest is published, what was written is read back: its schema and the number of rows must be those
of the data that were to be written. ``expire`` removes versions beyond an age, and the folders that no
version left names, if they are older than that as well (a younger one may be a commit under way).

A large commit goes in rounds: some buckets at a time are read, changed and written, and what a round has shuffled is
removed from the disks before the next one begins. The batch is then laid down by bucket first, so each round
reads its part alone. A change must therefore not look beyond the buckets of its keys, unless ``reads`` is given.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a bucket that go to one file.
FILE_ROWS = 1_000_000
#: Rows from which a round of a commit or a comparison is full, and most rounds.
ROUND_ROWS, ROUNDS = 1 << 20, 8

_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Within, Spark removes the shuffle files of an action when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANED)
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANED, before)


class Conflict(Exception):
    """Another commit has changed what this one read."""


@dataclass(frozen=True)
class Version:
    """A manifest: its number, and folder and rows of each bucket that has any."""

    number: int
    schema: T.StructType
    buckets: dict[int, tuple[str, int]]
    #: What the writer had to say, such as the version of another table that this one is made from.
    note: str = ""

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.buckets.values())


class Table:
    """A table keyed by ``key`` in ``folder``, whose rows lie in ``buckets`` buckets."""

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 32):
        self.spark, self.folder, self.key, self.buckets = spark, folder, key, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Manifests

    def _manifest(self, number: int) -> str:
        return f"{self.folder}/manifests/{number:012d}.json"

    def versions(self) -> list[int]:
        """The numbers of all versions that are kept, in order."""
        place = self._path(f"{self.folder}/manifests")
        if not self._files.exists(place):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self, number: int | None = None) -> Version:
        """A version, the newest if no number is given."""
        if number is None:
            numbers = self.versions()
            if not numbers:
                raise ValueError(f"no version in {self.folder}")
            number = numbers[-1]
        said = json.loads("".join(r.value for r in self.spark.read.text(self._manifest(number), wholetext=True).collect()))
        return Version(number, T.StructType.fromJson(said["schema"]), {int(k): (place, rows) for k, (place, rows) in said["buckets"].items()}, said["note"])

    def _publish(self, version: Version) -> None:
        """Write the manifest under another name and move it to its own, which must not exist."""
        said = {"schema": json.loads(version.schema.json()), "buckets": {k: list(v) for k, v in sorted(version.buckets.items())}, "note": version.note}
        draft, place = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}"), self._path(self._manifest(version.number))
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(said), "utf-8"))
        out.close()
        if self._files.exists(place) or not self._files.rename(draft, place):
            self._files.delete(draft, False)
            raise Conflict(f"version {version.number} exists")

    # Data

    def at(self, version: Version, buckets: list[int]) -> DataFrame:
        """The rows of a version in some buckets."""
        places = sorted(version.buckets[b][0] for b in buckets if b in version.buckets)
        if not places:
            return self.spark.createDataFrame([], version.schema)
        return self.spark.read.schema(version.schema).parquet(*[f"{self.folder}/{p}" for p in places])

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the newest if no number is given."""
        version = self.version(number)
        return self.at(version, list(version.buckets))

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets that hold these keys."""
        return sorted(self._rows(keys))

    def _rows(self, keys: DataFrame) -> dict[int, int]:
        """The number of these keys in each bucket that has any."""
        return {r[0]: r[1] for r in keys.groupBy(self._bucket()).count().collect()}  # at most ``buckets``

    def rounds(self, rows: dict[int, int]) -> list[list[int]]:
        """Buckets with so many rows, dealt to as few rounds as keep each near ROUND_ROWS, of about as many rows each."""
        n = min(ROUNDS, -(-sum(rows.values()) // ROUND_ROWS), len(rows))
        dealt: list[list[int]] = [[] for _ in range(max(n, 1))]
        for b in sorted(rows, key=lambda b: (-rows[b], b)):
            min(dealt, key=lambda part: sum(rows[x] for x in part)).append(b)
        return [sorted(part) for part in dealt]

    @contextmanager
    def _laid(self, batch: DataFrame, rounds: list[list[int]]) -> Iterator[Callable[[list[int]], DataFrame]]:
        """A function that gives the batch's rows of a round."""
        if len(rounds) < 2:
            yield lambda _: batch
            return
        place = f"{self.folder}/batches/{uuid.uuid4().hex}"
        batch.withColumn("_bucket", self._bucket()).write.option("compression", "zstd").partitionBy("_bucket").parquet(place)
        try:
            laid = self.spark.read.schema(T.StructType([*batch.schema, T.StructField("_bucket", T.IntegerType())])).parquet(place)
            yield lambda part: laid.where(F.col("_bucket").isin(part)).drop("_bucket")
        finally:
            self.discard(place)

    def _write(self, rows: DataFrame, schema: T.StructType) -> dict[int, tuple[str, int]]:
        """Write rows to a new folder, read them back, and return where each bucket is."""
        commit, seen = f"data/{uuid.uuid4().hex}", Observation()
        place = f"{self.folder}/{commit}"
        dealt = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).observe(seen, F.count("*").alias("rows"))
        # Each task writes its own rows of every bucket: dealing them by bucket first would write all rows to disk once more.
        # It sorts them by bucket anyway; keys in order take less space.
        dealt.withColumn("_bucket", self._bucket()).sortWithinPartitions("_bucket", self.key).write.option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").partitionBy("_bucket").parquet(place)
        try:
            expected = seen.get["rows"]
        except Py4JJavaError:  # no metrics come of a plan that is found to be empty before it runs
            expected = 0
        if not expected:
            return {}
        saved = self.spark.read.parquet(place)
        found = dict(saved.dtypes)
        counts = {r[0]: r[1] for r in saved.groupBy("_bucket").agg(F.count("*")).collect()}
        if sum(counts.values()) != expected or any(found.get(f.name) != f.dataType.simpleString() for f in schema):
            raise OSError(f"{place} does not hold what was written")
        return {b: (f"{commit}/_bucket={b}", n) for b, n in counts.items()}

    def create(self, rows: DataFrame, note: str = "") -> Version:
        """The first version."""
        # Everything may be null, within arrays and structs too, whatever the first rows say.
        schema = T.DataType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes))
        with released(self.spark):
            first = Version(1, schema, self._write(rows, schema), note)
        self._files.mkdirs(self._path(f"{self.folder}/manifests"))
        self._publish(first)
        return first

    def commit(self, base: Version, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], reads: DataFrame | None = None, note: str = "") -> Version:
        """The next version: in the buckets that ``batch`` has keys of, rows are what ``change(rows, batch)`` makes
        of them as of ``base``; it must keep keys in their buckets, and columns, and is called once a round. ``reads`` has
        the keys that the change depends on, if more than those of the batch; it is then called once for all."""
        made: dict[int, tuple[str, int]] = {}
        with released(self.spark):
            keys = self._rows(batch if reads is None else batch.select(self.key).union(reads.select(self.key)))
            mine = sorted(keys)
            rounds = [mine] if reads is not None else self.rounds({b: n + base.buckets.get(b, ("", 0))[1] for b, n in keys.items()})
            with self._laid(batch, rounds) as laid:
                for part in rounds:
                    wrote = self._write(change(self.at(base, part), laid(part)), base.schema)
                    if set(wrote) - set(part):
                        raise ValueError("a change moved rows to buckets that it did not read")
                    made |= wrote
        while True:
            newest = self.version()
            if any(newest.buckets.get(b) != base.buckets.get(b) for b in mine):
                raise Conflict(f"version {newest.number} changed what version {base.number} had")
            merged = {b: v for b, v in newest.buckets.items() if b not in mine} | made
            try:
                self._publish(after := Version(newest.number + 1, base.schema, merged, note))
                return after
            except Conflict:
                continue  # another version was published just now: look at it

    def update(self, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], tries: int = 10) -> tuple[Version, Version]:
        """``commit`` on the newest version, again if another commit came between. The versions before and after."""
        for left in reversed(range(tries)):
            base = self.version()
            try:
                return base, self.commit(base, batch, change)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def changes(self, before: Version, after: Version) -> tuple[DataFrame, DataFrame]:
        """The rows before and after in the buckets that differ: all that a reader of both need look at."""
        differ = self._differing(before, after)
        return self.at(before, differ), self.at(after, differ)

    def changes_in_rounds(self, before: Version, after: Version) -> Iterator[tuple[DataFrame, DataFrame]]:
        """The same, some buckets at a time: all rows of a key come together."""
        for part in self.rounds({b: sum(v.buckets.get(b, ("", 0))[1] for v in (before, after)) for b in self._differing(before, after)}):
            yield self.at(before, part), self.at(after, part)

    @staticmethod
    def _differing(before: Version, after: Version) -> list[int]:
        return [b for b in {*before.buckets, *after.buckets} if before.buckets.get(b) != after.buckets.get(b)]

    def discard(self, place: str) -> None:
        """Remove a folder below the table's own that no version names."""
        self._files.delete(self._path(place), True)

    def expire(self, now: float, seconds: float, keep: int = 1) -> tuple[list[int], int]:
        """Remove versions older than ``seconds`` before ``now`` (seconds since 1970), but for the newest ``keep``, and
        folders of data as old that no other version names. Returns the versions and the number of folders removed."""
        oldest = int((now - seconds) * 1000)
        numbers = self.versions()
        gone = [n for n in numbers[:-keep] if self._files.getFileStatus(self._path(self._manifest(n))).getModificationTime() < oldest]
        for n in gone:
            self._files.delete(self._path(self._manifest(n)), False)
        used = {place.rsplit("/", 1)[0] for n in self.versions() for place, _ in self.version(n).buckets.values()}
        removed = 0
        for f in self._files.listStatus(self._path(f"{self.folder}/data")):
            if f"data/{f.getPath().getName()}" not in used and f.getModificationTime() < oldest:
                removed += bool(self._files.delete(f.getPath(), True))
        return gone, removed


def claim(requests: Table, now: F.Column, tries: int = 10) -> DataFrame | None:
    """Claim the queued request (id, status, requested_at, started_at) that waits longest: it is running from now
    on, and returned. None if none is queued. Of several claimers at once each gets another request."""
    for _ in range(tries):
        base = requests.version()
        queued = requests.read(base.number).where("status = 'queued'").orderBy("requested_at", "id").limit(1)
        first = queued.select("id").collect()
        if not first:
            return None
        mine = queued.sparkSession.createDataFrame([(first[0].id,)], T.StructType([base.schema["id"]]))
        try:
            after = requests.commit(base, mine, lambda rows, _: _started(rows, first[0].id, now))
            return requests.read(after.number).where(F.col("id") == first[0].id)
        except Conflict:
            continue
    raise Conflict(f"no request could be claimed in {tries} tries")


def _started(rows: DataFrame, request: int, now: F.Column) -> DataFrame:
    one = (F.col("id") == request) & (F.col("status") == "queued")
    return rows.withColumns({"started_at": F.when(one, now).otherwise(F.col("started_at")), "status": F.when(one, "running").otherwise(F.col("status"))})
