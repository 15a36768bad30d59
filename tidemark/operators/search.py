"""Full-text search over names and domains by an inverted index.

The index is a committed table keyed by term: for each term and block of ids (``BLOCK`` consecutive ones) the sorted ids of
the records that have it. Terms are stems of a text's words without stop words. A search reads the postings of its
own terms alone, in the buckets where they lie, and intersects them block by block: a block's lists meet by an equal
key, and none is longer than a block, however common its term is.

Defined results: a query without terms finds nothing; ids are whole numbers, and rows of null id aren't indexed; a record added
again under its id keeps the terms that it had (``without`` takes it out first); null texts have no terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import terms_of, words
from .committed import Table, Version

BLOCK = 1 << 16
SCHEMA = "term string, block long, ids array<long>"


def terms(records: DataFrame, *columns: str) -> DataFrame:
    """id and term, each once a record: what can be found in its columns."""
    tokens = records.where("id is not null").select(F.col("id").cast("long").alias("id"), words(F.concat_ws(" ", *columns)).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(k, t) for k, found in enumerate(batch.column(1).to_pylist()) for t in dict.fromkeys(terms_of(found))]
            at, found = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["id", "term"])

    return tokens.mapInArrow(run, T.StructType([T.StructField("id", T.LongType()), T.StructField("term", T.StringType())]))


def postings(found: DataFrame) -> DataFrame:
    """Lists of ids by term and block, of id and term."""
    return found.groupBy("term", F.floor(F.col("id") / BLOCK).cast("long").alias("block")).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def _merged(old: DataFrame, new: DataFrame) -> DataFrame:
    lists = old.unionByName(new).groupBy("term", "block").agg(F.collect_list("ids").alias("lists"))
    return lists.select("term", "block", F.array_sort(F.array_distinct(F.flatten("lists"))).alias("ids"))


def _less(old: DataFrame, gone: DataFrame) -> DataFrame:
    """Lists without the ids of ``gone`` (term, block, ids)."""
    left = old.join(gone.withColumnRenamed("ids", "gone"), ["term", "block"], "left")
    rest = left.select("term", "block", F.when(F.col("gone").isNull(), F.col("ids")).otherwise(F.array_except("ids", "gone")).alias("ids"))
    return rest.where(F.size("ids") > 0)


def _written(index: Table, lists: DataFrame) -> DataFrame:
    """A batch of lists, made once: a commit looks at its terms before it merges it."""
    place = f"{index.folder}/batches/{len(index.versions())}"
    lists.write.mode("overwrite").parquet(place)
    return lists.sparkSession.read.schema(SCHEMA).parquet(place)


def add(index: Table, records: DataFrame, *columns: str) -> Version:
    """Index records (id and ``columns``), in a first version or on top of the newest."""
    lists = postings(terms(records, *columns))
    return index.update(_written(index, lists), _merged)[1] if index.versions() else index.create(lists)


def without(index: Table, records: DataFrame, *columns: str) -> Version:
    """Take records as they were indexed out again."""
    return index.update(_written(index, postings(terms(records, *columns))), _less)[1]


def find(index: Table, query: str) -> DataFrame:
    """The ids of the records that have all terms of a query."""
    version, asked = index.version(), sorted(set(terms_of(_tokens(index, query))))
    if not asked:
        return index.spark.createDataFrame([], "id long")
    wanted = index.spark.createDataFrame([(t,) for t in asked], "term string")
    read = index.at(version, index.touched(wanted)).where(F.col("term").isin(asked))
    met = read.groupBy("block").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == len(asked))
    all_: Column = reduce(F.array_intersect, [F.col("lists")[k] for k in range(len(asked))])
    return met.select(F.explode(all_).alias("id"))


def _tokens(index: Table, query: str) -> list[str]:
    return index.spark.range(1).select(words(F.lit(query)).alias("w")).first().w
