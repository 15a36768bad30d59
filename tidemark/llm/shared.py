"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A table of at most this many rows, each of a few dozen bytes, may be broadcast.
BROADCAST_ROWS = 100_000


def _checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where that setting is absent (tests, a single machine), a temporary folder is set; on a
    cluster that is refused, since executors would not share it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcast if its counted rows are few; else leave the join to shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: A key with more than one in so many rows is looked up by broadcast.
HEAVY = 1000


def looked_up(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with the one row a key of ``right``, whose column ``rows`` counts a key's rows in ``left``
    of ``total``. Keys with more than one row in ``HEAVY`` are fewer than ``HEAVY``: they are broadcast, so that
    no task gets all rows of a frequent key. The column ``rows`` stays."""
    heavy = right.where(F.col(rows) * HEAVY > total)
    light = left.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return left.join(F.broadcast(heavy), key).unionByName(light.join(right.where(F.col(rows) * HEAVY <= total), key, how))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(columns: list[str], name: str) -> str:
    """``name``, with a number behind it if a column has that name already (in any case)."""
    taken, out, n = {c.lower() for c in columns}, name, 0
    while out.lower() in taken:
        n += 1
        out = f"{name}{n}"
    return out


def named(column: str) -> Column:
    """The column of just that name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def every(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def set_aside(docs: DataFrame, added: list[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns that are named as those in ``added`` under fresh names, and the columns
    that give all of ``docs`` their names back: for callers that want a filter or a new text alone."""
    clash, away = {a.lower() for a in added}, {}
    for c in docs.columns:
        away[c] = fresh([*docs.columns, *added, *away.values()], c) if c.lower() in clash else c
    return docs.select([named(c).alias(a) for c, a in away.items()]), [named(a).alias(c) for c, a in away.items()]


def uniform(*parts: Column) -> Column:
    """A hash of the parts as a double in [0, 1), from 52 bits of MD5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def text_groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive rows whose sizes add up to about ``most``, at least one row each."""
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


#: What operators keep in a worker between tasks, by operator.
_kept: dict[str, dict] = {}


def worker_cache(operator: str) -> dict:
    """A dictionary that stays in the worker as long as its tasks are of this operator."""
    return _kept.setdefault(operator, {})


def make_room(operator: str | None = None) -> None:
    """Forget what other operators keep in this worker, and give unused memory back to the system.

    Workers live on between stages, and what each has freed but not returned adds up.
    """
    for name in list(_kept):
        if name != operator:
            _kept.pop(name).clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(df: DataFrame, keep: list[str], added: dict[str, str], fn: Callable, text: str = "text", most: int = 1 << 20, arrow: bool = False, operator: str | None = None, key: str | None = None) -> DataFrame:
    """One pass over the texts without a shuffle: ``fn`` turns a list of them (null: empty), or with
    ``arrow`` an Arrow array, into one list or array for each column of ``added`` (name: type).
    Columns of ``keep`` pass through as Arrow arrays, so that their nulls and large integers survive.
    ``operator`` names whose cache may stay in the worker. With ``key``, ``fn`` gets the list of that kept
    column's values besides.
    """
    keep = [c for c in keep if c.lower() not in {a.lower() for a in added}]
    types = T.StructType([T.StructField(n, T.DataType.fromDDL(t)) for n, t in added.items()])
    schema = T.StructType([df.schema[c] for c in keep] + types.fields)
    kinds = [to_arrow_type(f.dataType) for f in types]
    names = [*keep, *added]
    at = keep.index(key) if key else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(operator)
        for batch in batches:
            column = batch.column(len(keep))
            # Only a group's texts become Python objects at a time.
            for start, end in text_groups(pc.fill_null(pc.binary_length(column), 0).to_pylist(), most):
                part = pc.fill_null(column.slice(start, end - start), "")
                given = [part if arrow else part.to_pylist()] + ([] if at is None else [batch.column(at).slice(start, end - start).to_pylist()])
                made = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(fn(*given), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(start, end - start) for i in range(len(keep))] + made, names=names)
        make_room(operator)

    # Numbered on the way in: Spark looks the columns of a map up by name, and takes dots in names for fields.
    return df.select(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)], named(text).alias("text")).mapInArrow(run, schema)
