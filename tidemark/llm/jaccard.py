"""Similarity join on word shingles with Bayesian pruning of candidates.

Documents of equal shingle sets form a class, found by grouping 128-bit fingerprints; the rest
works on one node for each fingerprint, whatever ids its documents have. Of each text ``HASHES``
MinHash values of 8 bits are kept. They are grouped in ``BANDS`` bands of ``ROWS`` values (before
they are cut to 8 bits); nodes that share a band are candidates.

Candidates are compared twice. First within each bucket, by MinHash values alone: ``STEP`` values at
a time, a pair is dropped as soon as the posterior probability that its Jaccard similarity
reaches the threshold, given the matches so far and a uniform prior, falls below ``TOLERANCE``.
A bucket returns only which of its members hang together by pairs that outlast this, so boilerplate
that brings dissimilar texts into one bucket doesn't tie them together. Then the texts of each
group that hangs together are read again; its pairs are pruned in the same way, and what remains is
verified exactly on the shingle sets.

A pair at the threshold shares no band with probability (1 - 0.8**5)**25 < 5e-5, and is pruned
with a probability near TOLERANCE; above it, with less. Values of 8 bits match by chance once in
256, which prunes less, never more.

Large buckets and groups are cut into blocks of about ``BLOCK`` members by a hash, and each pair of
blocks is a task of its own, so that no task sees a large group and no row is made for a pair: a
task returns for each member the number of documents linked and a member it is connected to.

Words and shingles are those of ``shingles``. Defined results: texts without a shingle (null or
empty) have no links and a class of their own; shorter texts than five words are compared
whole; documents with a null id are returned with null class_id and n_links; rows of equal id
and text count as copies; rows of equal id and other texts are documents of their own; the
smallest doc_id names a class; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, every, fresh, looked_up, make_room, map_texts, small
from .shingles import MinHash, mix, shingle_set

THRESHOLD, BANDS, ROWS, STEP, TOLERANCE, BLOCK = 0.8, 25, 5, 25, 1e-6, 384
HASHES = BANDS * ROWS
#: Copies of a node's label for its neighbours to look up.
SALTS = 8


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, a 128-bit fingerprint of the shingle set (null without shingles), MinHash values and band keys."""
    hasher = MinHash(HASHES)

    def run(texts: list[str]) -> list:
        sets = [shingle_set(t) for t in texts]
        signatures = hasher.signatures(sets)
        prints = [_print(s) for s in sets]
        return [[p[0] for p in prints], [p[1] for p in prints], [row.tobytes() for row in _short(signatures)], list(_band_keys(signatures))]

    return map_texts(docs, ["doc_id"], {"f1": "long", "f2": "long", "values": "binary", "bands": "array<long>"}, run)


def _print(s: np.ndarray) -> tuple[int | None, int | None]:
    if not len(s):
        return None, None
    return int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(len(s)))).view(np.int64))


def _short(signatures: np.ndarray) -> np.ndarray:
    """8 bits of each value, from all of its bits."""
    return ((signatures * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    out = np.zeros((len(signatures), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(signatures), b, np.uint64)
        for r in range(ROWS):
            key = mix(key + signatures[:, b * ROWS + r] + np.uint64(1))
        out[:, b] = key
    return out.view(np.int64)


@cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, n: int = HASHES) -> tuple[int, ...]:
    """For each number of values compared, the fewest matches with which a pair stays.

    The posterior of the similarity s after m matches of k is proportional to s**m (1-s)**(k-m).
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    high = s >= threshold
    out = [0]
    for k in range(1, n + 1):
        m = np.arange(k + 1)[:, None]
        log = m * np.log(s) + (k - m) * np.log1p(-s)
        p = np.exp(log - log.max(1, keepdims=True))
        reach = p[:, high].sum(1) / p.sum(1)
        out.append(int(np.argmax(reach >= tolerance)))
    return tuple(out)


def survivors(values: np.ndarray, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``first`` the rows of ``second`` (both positions in ``values``) that outlast all
    comparisons. Each pair comes once."""
    least, within = least_matches(), first is second
    for n, i in enumerate(first):
        left = second[n + 1 :] if within else second
        matches = np.zeros(len(left), np.int32)
        for k in range(0, values.shape[1], STEP):
            if not len(left):
                break
            matches += np.count_nonzero(values[left, k : k + STEP] == values[i, k : k + STEP], axis=1)
            stay = matches >= least[min(k + STEP, values.shape[1])]
            if not stay.all():
                left, matches = left[stay], matches[stay]
        if len(left):
            yield i, left


class _Bits:
    """Shingle sets as bitmaps, or as sorted arrays where bitmaps would take too much memory."""

    def __init__(self, sets: list[np.ndarray], most: int = 1 << 24):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets])
        every, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        width = (len(every) + 63) // 64
        self.bitmaps = None
        if width * 8 * len(sets) <= most:
            bits = np.zeros((len(sets), width * 8), np.uint8)
            owner = np.repeat(np.arange(len(sets)), self.sizes)
            np.bitwise_or.at(bits, (owner, inverse >> 3), (1 << (inverse & 7)).astype(np.uint8))
            self.bitmaps = bits.view(np.uint64)

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        if self.bitmaps is None:
            return np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for j in others], int)
        return np.bitwise_count(self.bitmaps[others] & self.bitmaps[i]).sum(1).astype(int)


def linked(sets: list[np.ndarray], values: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[int, np.ndarray]]:
    """Exact links between members of ``first`` and of ``second`` (positions in ``sets``), each once."""
    bits = _Bits(sets)
    for me, others in survivors(values, first, second):
        common = bits.common(me, others)
        # common / union >= threshold, in whole numbers for thresholds of two decimals
        union = bits.sizes[me] + bits.sizes[others] - common
        others = others[100 * common >= round(100 * threshold) * union]
        if len(others):
            yield me, others


class Forest:
    """Which of n members hang together."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def top(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = sorted((self.top(x), self.top(y)))
        self.root[b] = a

    def tops(self) -> list[int]:
        return [self.top(x) for x in range(len(self.root))]


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) for edges a, b of distinct nodes.

    Each round a node takes the smallest label of itself and its neighbours and then that label's
    own label, so that rounds grow with the logarithm of a component's diameter.
    """
    # Every node keeps one edge, to its smallest neighbour below it; its other such neighbours are
    # joined to that one instead. Members of a large group mostly share these, so few edges remain.
    down = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nearest = down.groupBy("a").agg(F.min("b").alias("nearest"), F.count("*").alias("m"))
    kept = nearest.select("a", F.col("nearest").alias("b"))
    moved_edges = looked_up(down, nearest, "a", "m", down.count()).where("b <> nearest").select(F.col("b").alias("a"), F.col("nearest").alias("b"))
    sparse = kept.union(moved_edges)
    both = checkpointed(sparse.union(sparse.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
    # The nodes of a large component look one label up: it is copied, and they are spread over its copies.
    salt, copies = F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    both = both.select("a", "b", salt)
    while True:
        seen = both.join(labels.select(F.col("a").alias("b"), "label", copies), ["b", "salt"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(seen, "a").select("a", F.col("label").alias("was"), F.least("label", "near").alias("label"), salt)
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("further"), copies)
        moved = checkpointed(lower.join(jump, ["label", "salt"], "left").select("a", "was", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = moved.select("a", "label")
        if moved.where("was <> label").isEmpty():
            return labels.toDF("node", "root")


def in_units(members: DataFrame, sizes: DataFrame, total: int, most: int) -> DataFrame:
    """Give each member (group, node) the units it takes part in: a bundle of small groups, or pairs of blocks.

    ``sizes`` has the size m of each group, ``total`` is the number of members; a block has about ``most``.
    """
    bundles = max(1, total // most)
    blocks = F.ceil(F.col("m") / most).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(block, other).alias("i"), F.greatest(block, other).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    bundle = F.when(blocks <= 1, F.pmod(F.xxhash64("group"), F.lit(bundles)).cast("long")).otherwise(F.col("group"))
    return looked_up(members, sizes, "group", "m", total).select("node", "group", (blocks > 1).alias("large"), block.alias("block"), bundle.alias("bundle"), F.when(blocks > 1, pairs).otherwise(alone).alias("pairs"))


def _sides(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the two blocks whose pairs a unit compares; one array twice if it compares all."""
    every = np.arange(len(group))
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    if not group["large"].iloc[0] or i == j:
        return every, every
    block = group["block"].to_numpy()
    return every[block == i], every[block == j]


def _values(group: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(group["values"]), np.uint8).reshape(len(group), HASHES)


def _bucket_unit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges that tie together the members of each bucket whose MinHash values are alike."""
    make_room()
    a, b = [], []
    # In order of nodes, so that all of a tree hang on its smallest one.
    for _, group in pdf.sort_values("node").groupby("group", sort=False):
        nodes, forest = group["node"].to_numpy(), Forest(len(group))
        for me, others in survivors(_values(group), *_sides(group)):
            for x in others.tolist():
                forest.join(int(me), x)
        tops = np.array(forest.tops())
        tied = np.flatnonzero(tops != np.arange(len(nodes)))
        a.append(nodes[tied])
        b.append(nodes[tops[tied]])
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()


def _join_unit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links within one unit: for each member its linked documents and a member it is connected to."""
    make_room()
    out = []
    for _, group in pdf.drop_duplicates(["group", "node"]).sort_values("node").groupby("group", sort=False):  # rows may repeat
        nodes, copies, forest = group["node"].to_numpy(), group["copies"].to_numpy(), Forest(len(group))
        links = np.zeros(len(nodes), np.int64)
        for me, others in linked([np.frombuffer(s, np.uint64) for s in group["shingles"]], _values(group), *_sides(group)):
            links[me] += copies[others].sum()
            links[others] += copies[me]
            for x in others.tolist():
                forest.join(int(me), x)
        out.append(pd.DataFrame({"node": nodes, "links": links, "root": nodes[forest.tops()]}))
    return pd.concat(out)


def _candidates(reps: DataFrame) -> DataFrame:
    """Edges a, b between nodes that share a bucket and whose MinHash values are alike."""
    banded = reps.select("node", F.explode("bands").alias("band"))
    # Buckets of equal members, as copies make in most of their bands, are looked at once.
    sizes = banded.groupBy("band").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x")).where("m > 1")
    chosen = checkpointed(sizes.groupBy("m", "s", "x").agg(F.min("band").alias("group")).select("group", "m"))
    total = chosen.agg(F.sum("m")).first()[0] or 0
    units = in_units(banded.withColumnRenamed("band", "group"), chosen, total, BLOCK)
    placed = units.join(reps.select("node", "values"), "node").withColumn("pair", F.explode("pairs")).select("node", "group", "large", "block", "bundle", "pair.i", "pair.j", "values")
    return placed.groupBy("bundle", "i", "j", "large").applyInPandas(_bucket_unit, "a long, b long")


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, f1, f2, class_id and n_links of each document, and ``first``: whether its fingerprint is the
    one that stands for its class (the smallest among those with the class's smallest doc_id)."""
    prints = checkpointed(fingerprints(docs))
    sound = prints.where("doc_id is not null and f1 is not null")
    grouped = sound.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("values").alias("values"), F.first("bands").alias("bands"))
    # Numbers of nodes are kept with them by the checkpoint.
    reps = checkpointed(grouped.withColumn("node", F.monotonically_increasing_id()))
    groups = checkpointed(components(_candidates(reps)).withColumnRenamed("root", "group"))
    sizes = groups.groupBy("group").agg(F.count("*").alias("m"))
    units = in_units(groups, sizes, groups.count(), BLOCK)
    # The texts of the nodes alone.
    chosen = units.join(reps.select("node", "rep", "copies", "values", "f1", "f2"), "node")
    repeated = checkpointed(sound.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    n = repeated.count()
    own = docs.select("doc_id", "text")
    once = own.join(small(repeated, n), "doc_id", "left_anti") if n else own
    texts = once.join(chosen.hint("shuffle_hash"), F.col("doc_id") == F.col("rep"))
    if n:  # an id may have any number of texts: those rows meet their node by id and fingerprint, once
        several = map_texts(own.join(small(repeated, n), "doc_id", "left_semi").select("doc_id", "text"), ["doc_id", "text"], {"f1": "long", "f2": "long"}, _prints)
        several = several.dropDuplicates(["doc_id", "f1", "f2"]).withColumnRenamed("doc_id", "rep")
        texts = texts.select("text", *chosen.columns).unionByName(several.join(chosen, ["rep", "f1", "f2"]).select("text", *chosen.columns))
    sets = map_texts(texts, [*chosen.columns], {"shingles": "binary", "g1": "long", "g2": "long"}, _sets).where("f1 = g1 and f2 = g2")
    placed = sets.withColumn("pair", F.explode("pairs")).select("node", "group", "copies", "values", "large", "block", "bundle", "pair.i", "pair.j", "shingles")
    found = checkpointed(placed.groupBy("bundle", "i", "j", "large").applyInPandas(_join_unit, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = reps.select("f1", "f2", "rep", "copies", "node").join(links, "node", "left").join(roots, "node", "left")
    known = checkpointed(known.select("f1", "f2", "rep", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    heads = known.groupBy("root").agg(F.min(F.struct("rep", "f1", "f2")).alias("head"), F.count("*").alias("m"))
    named = looked_up(known, heads, "root", "m", known.count()).select("f1", "f2", F.col("head.rep").alias("class_id"), "n_links", (F.struct("rep", "f1", "f2") == F.col("head")).alias("first"))
    return prints.select("doc_id", "f1", "f2").join(named, ["f1", "f2"], "left")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its group of linked documents) and n_links of each document."""
    named = F.col("doc_id").isNotNull()
    return _classes(docs).select("doc_id", F.when(named, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(named, F.coalesce("n_links", F.lit(0))).alias("n_links"))


def _prints(texts: list[str]) -> list:
    prints = [_print(shingle_set(t)) for t in texts]
    return [[p[0] for p in prints], [p[1] for p in prints]]


def _sets(texts: list[str]) -> list:
    sets = [shingle_set(t) for t in texts]
    prints = [_print(s) for s in sets]
    return [[s.tobytes() for s in sets], [p[0] for p in prints], [p[1] for p in prints]]


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class, that with its smallest doc_id; documents without id or shingles stay.

    Rows are told apart by id and fingerprint, so that rows of equal id and other texts stay if
    their own class has no other document.
    """
    found = checkpointed(_classes(docs).where("doc_id is not null"))
    repeated = checkpointed(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    n = repeated.count()
    keeps = F.coalesce(F.col("first") & (F.col("doc_id") == F.col("class_id")), F.lit(True))
    once = found if not n else found.join(small(repeated, n), "doc_id", "left_anti")
    dropped = once.where(~keeps).select("doc_id")
    out = docs.join(small(dropped, dropped.count()), "doc_id", "left_anti").select(every(docs))
    if not n:
        return out
    # Ids of several rows: fingerprints are made again for these rows only.
    out = out.join(small(repeated, n), "doc_id", "left_anti").select(every(docs))
    p1, p2 = fresh(docs.columns, "_f1"), fresh(docs.columns, "_f2")
    again = docs.join(small(repeated, n), "doc_id", "left_semi").select(every(docs))
    again = map_texts(again, docs.columns, {p1: "long", p2: "long"}, _prints)
    kept = found.where(keeps).select("doc_id", F.col("f1").alias(p1), F.col("f2").alias(p2)).distinct()
    one = again.dropDuplicates(["doc_id", p1, p2]).join(kept, ["doc_id", p1, p2], "left_semi")
    return out.unionByName(again.where(F.col(p1).isNull()).select(every(docs))).unionByName(one.select(every(docs)))
