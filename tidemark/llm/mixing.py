"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source; targets follow from weights by filling up to a limit; the
repetition rate of a source is its target over its size. Each document is emitted
floor(rate) times, and once more if a hash of its id and a seed, read as a number in
[0, 1), is below the rate's fraction.

Of ``SEEDS`` seeds each source takes the one whose draws come nearest its target, so that a few long
documents don't throw a small source off. The draws of one seed are independent; picking a seed
by its outcome is not: given the pick, the draws of a small source lean towards sums near the target. For
sources of many documents the lean is too small to see, and with ``seeds=1`` there is none.

What is summed per source is combined before the shuffle, so a hot source costs no more
than another. The table of sources is broadcast only after its rows are counted; beyond
``shared.BROADCAST_ROWS`` documents are spread by salt over copies of each source's row.

Defined results: a null text has size 0; a null source is a source of its own, ordered
last; documents of size 0 follow their source's rate; rows that share a doc_id share a
draw; an empty table gives an empty mix; columns named as those that the operator adds are
replaced by ``mix``; ``emit`` adds none and leaves all as they are. The result depends on
ids, sources and sizes alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, checkpointed, fresh, named, uniform

WORD = r"[^\x20\x09-\x0D]+"
SEEDS = 16
SALTS = 32


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def _rank(sources: DataFrame) -> DataFrame:
    """Sources numbered from 0 by code point, null last, without gathering them in one task."""
    parts = checkpointed(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()))
    parts = parts.withColumn("part", F.shiftright("place", 33))
    # One row for each partition: their number is a setting, not the data's.
    before = parts.groupBy("part").agg(F.count("*").alias("rows")).withColumn("before", F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    joined = parts.join(F.broadcast(before.select("part", "before")), "part")
    return joined.select("source", "source_size", (F.coalesce("before", F.lit(0)) + F.col("place") - F.shiftleft("part", 33)).alias("rank"))


def targets(sized: DataFrame, weights: tuple[float, ...], limit: float) -> DataFrame:
    """One row for each source: source, source_size, target.

    A target is its weight's share of all sizes, at most ``limit`` times its source's size;
    what is cut off is shared again by weight among the others. Each round is one
    aggregate that returns one row.
    """
    sources = _rank(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = checkpointed(sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(limit)).alias("most")))
    level, below = 0.0, -1
    while True:
        free = F.col("most") > F.col("weight") * F.lit(level)
        row = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(free, F.col("weight"))).alias("weights"), F.sum(F.when(~free, F.col("most"))).alias("cut"), F.count_if(~free).alias("n")).first()
        if row["weights"] is None or row["n"] == below:
            break
        level, below = (row["all"] - (row["cut"] or 0.0)) / row["weights"], row["n"]
    target = F.least(F.col("most"), F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", target.alias("target"))


def _join(docs: DataFrame, sources: DataFrame) -> tuple[DataFrame, str]:
    """Documents with their source's row as a struct, and the struct's name; null sources match."""
    name = fresh(docs.columns, "_plan")
    row, source = F.struct(*sources.columns), F.col("source").eqNullSafe(F.col(f"{name}.source"))
    if sources.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(sources.select(row.alias(name))), source), name
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    copies = sources.select(row.alias("row"), salts).select(F.struct("row.*", "salt").alias(name))
    return docs.join(copies, source & (F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int") == F.col(f"{name}.salt"))), name


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def plan(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3.0, seeds: int = SEEDS) -> DataFrame:
    """One row for each source: source, source_size, target, whole, fraction, seed.

    ``sized`` has doc_id, source and size, and is read several times.
    """
    sources = checkpointed(targets(sized, weights, limit))
    rates = sources.select("*", F.floor(_rate()).alias("whole"), (_rate() - F.floor(_rate())).alias("fraction"))
    if seeds == 1:
        return checkpointed(rates.withColumn("seed", F.lit(0)))
    drawn, name = _join(sized.select("doc_id", "source", "size"), rates)
    extra = [F.sum(F.when(uniform(F.col("doc_id"), F.lit(seed)) < F.col(f"{name}.fraction"), F.col("size")).otherwise(0)).alias(f"s{seed}") for seed in range(seeds)]
    sums = drawn.groupBy("source").agg(*[F.first(f"{name}.{c}").alias(c) for c in ("source_size", "target", "whole", "fraction")], *extra)
    miss = F.array_min(F.array(*[F.struct(F.abs(F.col("whole") * F.col("source_size") + F.col(f"s{seed}") - F.col("target")).alias("miss"), F.lit(seed).alias("seed")) for seed in range(seeds)]))
    return checkpointed(sums.select("source", "source_size", "target", "whole", "fraction", miss["seed"].alias("seed")))


def _mixed(docs: DataFrame, sized: DataFrame, weights: tuple[float, ...], limit: float, seeds: int) -> tuple[DataFrame, str, Column]:
    """``docs`` with their source's plan as a struct, the struct's name, and how often a document is taken."""
    out, name = _join(docs, plan(sized, weights, limit, seeds))
    row = F.col(name)
    return out, name, row["whole"] + (uniform(F.col("doc_id"), row["seed"]) < row["fraction"]).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size: one pass over the texts, kept."""
    return checkpointed(docs.select("doc_id", "source", word_count().alias("size")))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3.0, seeds: int = SEEDS) -> DataFrame:
    """Documents with the source_size and target of their source and the ``copies`` that the mix takes."""
    keep = [named(c) for c in docs.columns if c.lower() not in ("source_size", "target", "copies")]
    mixed, name, copies = _mixed(docs.select(keep), _sized(docs), weights, limit, seeds)
    return mixed.select(*keep, F.col(f"{name}.source_size").alias("source_size"), F.col(f"{name}.target").alias("target"), copies.alias("copies"))


def mixed_sizes(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3.0, seeds: int = SEEDS) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted)."""
    sized = _sized(docs)
    mixed, name, copies = _mixed(sized, sized, weights, limit, seeds)
    return mixed.select("doc_id", "size", F.col(f"{name}.source_size").alias("source_size"), F.col(f"{name}.target").alias("target"), (F.col("size") * copies).alias("taken"))


def emit(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3.0, seeds: int = SEEDS) -> DataFrame:
    """The mix itself: each document's row as often as it is taken."""
    mixed, name, copies = _mixed(docs, _sized(docs), weights, limit, seeds)
    copy = fresh(mixed.columns, "_copy")
    return mixed.where(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), copies.cast("int")))).select([named(c) for c in docs.columns])
