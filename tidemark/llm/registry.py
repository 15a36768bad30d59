"""Queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, licenses, mixing, periodic, pii, quality, sharding, simhash, topk, toxicity, variants, warc
from .shared import checkpointed, documents

VOCABULARY = "word_bpe_49k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), keep=["doc_id"]))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checkpointed(pii.candidates(documents(spark, sf_dir), ["doc_id"]))
    return pii.digests(pii.decide(found, pii.train_from(found)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", "held_out", "score", "predicted")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.assess(docs, model, keep=["doc_id"]).select("doc_id", *quality.COUNTS, "base_failed", "kept", "quality")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(documents(spark, sf_dir))


def rearranged(doc_id: int | None, n: int) -> np.ndarray | None:
    """Positions by which every tenth document, by the CRC-32 of its id, repeats a part of itself to its end (null id: none)."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    places = np.arange(n)
    places[start:] = start + (places[start:] - start) % period
    return places


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(documents(spark, sf_dir), ["doc_id"], rearranged, "doc_id")
    nothing = F.lit(None).cast("struct<start: long, length: long, period: long>")
    # Runs are in order, so that only a greater exponent takes the place of an earlier one.
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", nothing, lambda best, r: F.when(better(best, r), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.counted(documents(spark, sf_dir), variants.one_left_out(199))).select("word", "form", "root", "n", "n_near", "form_n")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_mixing, op3_sharding, op4_pii, op5_toxicity, op6_licenses, op7_jaccard, op8_quality, op9_topk, op10_warc, op11_simhash, op12_periodic, op13_variants, pipeline)
}

#: SQL for the queries that SQL can express. The others need crc32 (3) or what no SQL has: merges of a
#: vocabulary, trained models, overlapping regexes by priority, links found by components.
ORACLES: dict[str, str] = {
    "op2_mixing": """WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
        ranked AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
        weighed AS (SELECT source, source_size, CAST(place % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS most FROM ranked),
        -- Sources by the level at which they are cut; with this one and all behind it left, the level is:
        filled AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
        targets AS (SELECT source, source_size, least(most, weight * coalesce((SELECT level FROM filled WHERE most > weight * level ORDER BY most / weight, source NULLS LAST LIMIT 1), 0)) AS target FROM weighed),
        rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
        draws AS (SELECT d.doc_id, d.source, d.size, r.source_size, r.target, floor(r.rate) AS whole, seed,
            CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || seed), 1, 13)) AS BIGINT) / 4503599627370496.0 < r.rate - floor(r.rate) AS once_more
            FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source, range(16) s(seed)),
        missed AS (SELECT source, seed, abs(any_value(whole) * any_value(source_size) + sum(CASE WHEN once_more THEN size ELSE 0 END) - any_value(target)) AS miss FROM draws GROUP BY source, seed),
        best AS (SELECT source, seed FROM missed QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, seed) = 1)
        SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN once_more THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM draws d JOIN best b ON d.source IS NOT DISTINCT FROM b.source AND d.seed = b.seed""",
    "op9_topk": """WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored QUALIFY rank <= 20""",
    "op10_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages)
        SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
        -- Five bits at a time: two hexadecimal digits hold them wherever they start.
        array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(concat('0x', substr(h, CAST(5 * i // 4 AS INTEGER) + 1, 2)) AS BIGINT) >> (3 - 5 * i % 4)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
        CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM p""",
}
