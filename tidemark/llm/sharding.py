"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A tree of regions, racks and shards is descended from the top. At each node every child
draws -ln(u) / weight, where u in (0, 1] is a hash of the document's key and the child's
name and the weight is the sum of the shards below; the smallest draw wins. A child wins
in proportion to its weight, and a draw depends on that child alone: if weights change in
one subtree, rows move only into it (weights that grow) or out of it (that shrink).

The first ``BASE`` shards form regions of ``RACKS`` racks of ``SHARDS``. Each further
shard is a region of its own, so that it takes rows only into itself.

Slots number the rows of a shard from 0 by doc_id within hashed buckets, each of which is
sorted by itself; a bucket's first slot is the number of rows in the buckets before it. No
task sees a whole shard.

Defined results: a null text has no bytes (size 1, CRC-32 0); a null doc_id is hashed as
the word null; rows of equal doc_id share a shard and get slots of their own; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed, small, uniform

BASE, RACKS, SHARDS = 16, 2, 4
Tree = dict[int, dict[int, dict[int, float]]]


def tree(shards: int, base: int = BASE) -> Tree:
    """Region -> rack -> shard -> weight 1."""
    out: Tree = {}
    for s in range(shards):
        region, rack = (s // (RACKS * SHARDS), s // SHARDS) if s < base else (base + s, base + s)
        out.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return out


def _choose(key: Column, level: str, children: dict[int, tuple[float, Column]]) -> Column:
    """The result of the child with the smallest weighted draw."""
    (only,) = children.values() if len(children) == 1 else (None,)
    if only:
        return only[1]
    draws = {c: -F.log(F.lit(1.0) - uniform(key, F.lit(f"{level}{c}"))) / F.lit(w) for c, (w, _) in children.items()}
    best = F.array_min(F.array(*[F.struct(d.alias("draw"), F.lit(c).alias("child")) for c, d in draws.items()]))["child"]
    names = list(children)
    out = children[names[-1]][1]
    for c in reversed(names[:-1]):
        out = F.when(best == c, children[c][1]).otherwise(out)
    return out


def place(key: Column, nodes: Tree) -> Column:
    """The shard of a key."""
    regions = {}
    for region, racks in nodes.items():
        below = {}
        for rack, shards in racks.items():
            below[rack] = (sum(shards.values()), _choose(key, "shard", {s: (w, F.lit(s)) for s, w in shards.items() if w > 0}))
        below = {k: v for k, v in below.items() if v[0] > 0}
        regions[region] = (sum(w for w, _ in below.values()), _choose(key, "rack", below)) if below else (0.0, F.lit(None))
    return _choose(key, "region", {k: v for k, v in regions.items() if v[0] > 0}).cast("int")


def slots(rows: DataFrame, order: list[str], buckets: int) -> DataFrame:
    """Add ``slot``: a gapless number from 0 within each shard. ``rows`` is read twice."""
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_rows"))
    # At most shards x buckets rows, both settings.
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "_bucket", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(*order)) - 1
    numbered = rows.withColumn("_within", within)
    return numbered.join(small(counts, buckets * BASE), ["shard", "_bucket"]).withColumn("slot", F.col("_before") + F.col("_within")).drop("_bucket", "_before", "_within", "_rows")


def shard(docs: DataFrame, shards: int = BASE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one shard more) of each document."""
    text, key = F.coalesce("text", F.lit("")), F.col("doc_id")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, tree(shards)).alias("shard"),
        place(key, tree(shards + 1)).alias("grown_shard"),
    )
    buckets = max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return slots(checkpointed(rows), ["doc_id", "size", "text_crc32"], buckets).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
