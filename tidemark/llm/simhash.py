"""SimHash fingerprints and the components of documents whose fingerprints are near, by pigeonring filtering.

Words are runs of other characters than ASCII blanks, of the text with A-Z in lower case; shingles are ``SHINGLE``
consecutive words joined by one space, repeats included (fewer words: all of them). A bit of the fingerprint
is 1 if it is set in over half of the shingles' 64-bit xxHash values.

Two fingerprints link if they differ in at most ``DISTANCE`` bits. The 64 bits are cut into ``SEGMENTS``
segments on a ring. If the differences of all segments add up to at most ``DISTANCE``, then from one of the
segments on, every chain of l consecutive ones has at most l * DISTANCE / SEGMENTS differences: were there none,
the violating chains would tile the ring and add up to more. The first chains have a budget below one, so
their segments are equal: these are the key of an equal join. Pairs of a key must then stay within the
budget of each longer chain, and only what outlasts all of them has its Hamming distance counted.

With 7 segments the key has 27 or 28 bits, under 7 starts. Keys with many fingerprints are cut into
blocks, each pair of which is a unit of its own; a unit returns for each fingerprint a smaller one that it
hangs together with, never a row for a pair.

Defined results: texts that are null, empty or blank have the fingerprint zero, which links like any other; a row
of null id takes part as any other, and its component is named after the smallest id that isn't null, or
null without one; rows of equal ids are documents of their own; an empty table gives no rows; columns other
than doc_id and text are not looked at. A text is hashed in pieces, so memory is a few times that of the longest text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import BLOCK, Forest, components, in_units
from .shared import checkpointed, looked_up, make_room, map_texts

SHINGLE, SEED, DISTANCE, SEGMENTS = 3, 42, 2, 7
#: Shingles whose bits are unpacked at a time.
PIECE = 1 << 15
#: Segment k is the bits from EDGES[k] up to EDGES[k + 1].
EDGES = [64 * k // SEGMENTS for k in range(SEGMENTS + 1)]
#: The differences that a chain of 1, 2, ... segments may have.
BUDGETS = [length * DISTANCE // SEGMENTS for length in range(1, SEGMENTS + 1)]
#: So many segments must be equal.
EQUAL = BUDGETS.count(0)


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text in UTF-8, as an unsigned number."""
    words = text.lower().split()  # of bytes: ASCII letters and blanks alone
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1])[: len(words) - size + 1].tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), PIECE):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + PIECE], ends[at : at + PIECE])], "<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and node: the fingerprint as a signed long."""

    def run(texts: pa.Array) -> list:
        return [np.array([fingerprint(t) for t in texts.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)]

    return map_texts(docs, ["doc_id"], {"node": "long"}, run, arrow=True)


def _mask(start: int, length: int) -> int:
    """The bits of ``length`` segments on the ring from ``start`` on."""
    out = 0
    for k in range(start, start + length):
        low, high = EDGES[k % SEGMENTS], EDGES[k % SEGMENTS + 1]
        out |= ((1 << high) - 1) ^ ((1 << low) - 1)
    return out


#: Masks of the chains by start and length - 1.
CHAINS = np.array([[_mask(start, length) for length in range(1, SEGMENTS + 1)] for start in range(SEGMENTS)], np.uint64)


def keys() -> list:
    """For each start, a key of the equal segments of column ``node``: the start above, their bits below."""
    out = []
    for start in range(SEGMENTS):
        key, shift = F.lit(start), 0
        for k in range(start, start + EQUAL):
            low, width = EDGES[k % SEGMENTS], EDGES[k % SEGMENTS + 1] - EDGES[k % SEGMENTS]
            key = key * F.lit(1 << width) + F.shiftrightunsigned("node", low).bitwiseAND(F.lit((1 << width) - 1))
            shift += width
        out.append((key * F.lit(SEGMENTS) + F.lit(start)).cast("long"))
    return out


def _near(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges between the fingerprints of a unit that are near: each hangs on a smaller one."""
    make_room()
    pdf = pdf.sort_values(["group", "node"])
    group, node, block = pdf["group"].to_numpy(), pdf["node"].to_numpy(), pdf["block"].to_numpy()
    crossing = bool(pdf["large"].iloc[0]) and pdf["i"].iloc[0] != pdf["j"].iloc[0]
    bits, start, forest = node.view(np.uint64), group % SEGMENTS, Forest(len(pdf))
    left, step = np.arange(len(pdf)), 1
    while True:
        # Rows and those ``step`` places on, as long as they are of one key.
        left = left[: np.searchsorted(left, len(pdf) - step)]
        left = left[group[left] == group[left + step]]
        if not len(left):
            break
        a = left[block[left] != block[left + step]] if crossing else left
        for length in range(EQUAL + 1, SEGMENTS + 1):
            differ = np.bitwise_count((bits[a] ^ bits[a + step]) & CHAINS[start[a], length - 1])
            a = a[differ <= BUDGETS[length - 1]]
        for x in a.tolist():
            forest.join(x, x + step)
        step += 1
    tops = np.array(forest.tops())
    tied = np.flatnonzero(tops != np.arange(len(tops)))
    return pd.DataFrame({"a": node[tied], "b": node[tops[tied]]}).drop_duplicates()


def links(nodes: DataFrame) -> DataFrame:
    """Edges a, b that tie together the fingerprints (distinct, in ``node``) that are near."""
    keyed = nodes.select("node", F.explode(F.array(*keys())).alias("group"))
    sizes = checkpointed(keyed.groupBy("group").agg(F.count("*").alias("m")).where("m > 1"))
    total = sizes.agg(F.sum("m")).first()[0] or 0
    units = in_units(keyed, sizes, total, BLOCK).withColumn("pair", F.explode("pairs")).select("node", "group", "large", "block", "bundle", "pair.i", "pair.j")
    return units.groupBy("bundle", "i", "j", "large").applyInPandas(_near, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id that can be reached by links)."""
    prints = checkpointed(fingerprints(docs))
    total = prints.count()
    nodes = checkpointed(prints.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    roots = checkpointed(components(links(nodes)))
    placed = checkpointed(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    heads = placed.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("m"))
    named = checkpointed(looked_up(placed.select("root", "node", "copies"), heads, "root", "m", placed.count()).select("node", "copies", "component_id"))
    out = looked_up(prints, named, "node", "copies", total)
    return out.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")
