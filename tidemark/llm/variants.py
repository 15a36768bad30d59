"""Spelling variants: words one edit apart, found by probing Bloom filters with generated edits.

A word's edits (each code point deleted, or replaced by a larger one of the vocabulary's alphabet) are probed against
filters of the vocabulary, one for each length of words, which every task holds. What a filter passes is shuffled
to an exact join with the vocabulary, in which its false positives find nothing. Of each near pair just
one side generates the other: the longer one by deletion, that with the smaller code point by replacement.

A filter is made of blocks of 64 bits; a word sets ``SET`` bits of one block. All filters together take at most
``FILTER_BYTES``, whatever the vocabulary's size: beyond about 16 million words they let more false
positives through, and the result stays the same. Edited words aren't built to be probed: their hashes follow from prefix
sums of the word's own.

Defined results: texts that are null or hold no run give no words; an empty table gives no rows; columns other than those
named are not looked at; repeated rows count each time. A word of any length takes part; its edits are probed in
pieces of ``PROBES``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, make_room, named, text_groups

LETTERS, SHORTEST, FEWEST, RATIO = "a-zA-ZÀ-ÿ", 6, 5, 5
#: Bits of a filter for each word, bits a word sets, most bytes of all filters, bytes of a filter built by one task.
BITS, SET, FILTER_BYTES, CHUNK = 32, 5, 1 << 26, 1 << 17
#: Words of this length and beyond share one filter.
LONGEST = 64
#: Edits probed at a time, and words counted in a task before they are handed on.
PROBES, COUNTED = 1 << 20, 200_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = _U(pow(_BASE, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _U(_BASE))
    out[0] = _U(1)
    return np.multiply.accumulate(out)


def _prefix_sums(points: np.ndarray) -> np.ndarray:
    """For rows of words of one length, given as code points: sums of code point times power before each place, and of all."""
    out = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
    np.cumsum((points.astype(np.uint64) + _U(1)) * _powers(points.shape[1]), axis=1, out=out[:, 1:])
    return out


class Filters:
    """Where words' bits lie: for each length a first block and a number of blocks."""

    def __init__(self, words: dict[int, int], most: int = FILTER_BYTES):
        """``words``: how many words there are of each length up to LONGEST."""
        share = min(1.0, most * 8 / max(1, BITS * sum(words.values())))
        self.first, self.count, total = {}, {}, 0
        for length, n in sorted(words.items()):
            self.first[length], self.count[length] = total, max(1, int(n * BITS * share) // 64)
            total += self.count[length]
        self.blocks = total

    def places(self, length: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block and the mask of each word of ``length`` with these sums."""
        shard = min(length, LONGEST)
        a = _mix(sums + _U(length))
        block = ((a >> _U(32)) * _U(self.count[shard])) >> _U(32)
        b, mask = _mix(a ^ _U(_BASE)), np.zeros(a.shape, np.uint64)
        for k in range(SET):
            mask |= _U(1) << ((b >> _U(6 * k)) & _U(63))
        return block.astype(np.int64) + self.first[shard], mask


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, positions and rows of code points of the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        per = max(1, PROBES // length)
        for k in range(0, len(at), per):
            part = at[k : k + per]
            yield length, part, np.frombuffer("".join([words[i] for i in part.tolist()]).encode("utf-32-le"), "<u4").reshape(len(part), length)


def counted(docs: DataFrame, respelt: Callable[[str, object], str] | None = None, key: str = "doc_id") -> DataFrame:
    """word and n, the occurrences in all texts of runs of letters with A-Z in lower case.

    ``respelt`` may give another spelling for a run of a document, whose column ``key`` it is given; with it, words
    come from runs of one code point more than the shortest too.
    """
    runs = re.compile(f"[{LETTERS.replace('A-Z', '')}]{{{SHORTEST},}}").findall

    def handed_on(words: dict[str, int]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])
        words.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        words: dict[str, int] = {}
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1).cast(pa.binary()), b"")
            for start, end in text_groups(pc.binary_length(texts).to_pylist(), 1 << 20):
                for k, text in zip(keys[start:end], texts.slice(start, end - start).to_pylist()):
                    for word, n in Counter(runs(text.lower().decode())).items():  # bytes: A-Z alone
                        if respelt:
                            word = respelt(word, k)
                            if len(word) < SHORTEST:
                                continue
                        words[word] = words.get(word, 0) + n
                if len(words) > COUNTED:
                    yield handed_on(words)
        if words:
            yield handed_on(words)
        make_room()

    return docs.select(named(key).alias("key"), named("text").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _filter(words: DataFrame, layout: Filters) -> np.ndarray:
    """The filters' blocks: each task builds a chunk of them, of CHUNK bytes."""
    per = CHUNK // 8

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, points in by_length(batch.column(0).to_pylist()):
                block, mask = layout.places(length, _prefix_sums(points)[:, -1])
                yield pa.RecordBatch.from_arrays([pa.array(block // per), pa.array((block % per).astype(np.int32)), pa.array(mask.view(np.int64))], names=["chunk", "block", "mask"])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = np.zeros(per, np.uint64)
        np.bitwise_or.at(blocks, pdf["block"].to_numpy(), pdf["mask"].to_numpy().view(np.uint64))
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "blocks": [blocks.tobytes()]})

    out = np.zeros((layout.blocks // per + 1, per), np.uint64)
    for row in words.select("word").mapInArrow(place, "chunk long, block int, mask long").groupBy("chunk").applyInPandas(build, "chunk long, blocks binary").toLocalIterator():
        out[row.chunk] = np.frombuffer(row.blocks, np.uint64)
    return out.ravel()


def positives(words: list[str], layout: Filters, blocks: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Positions of words and edits of them that their filter lets through."""
    for length, at, points in by_length(words):
        sums = _prefix_sums(points)
        if min(length - 1, LONGEST) in layout.first and length > SHORTEST:
            shorter = sums[:, :-1] + (sums[:, -1:] - sums[:, 1:]) * _INVERSE
            block, mask = layout.places(length - 1, shorter)
            hit = (blocks[block] & mask) == mask
            hit[:, 1:] &= points[:, 1:] != points[:, :-1]  # of equal neighbours the first alone
            row, place = np.nonzero(hit)
            yield at[row], [words[w][:p] + words[w][p + 1 :] for w, p in zip(at[row].tolist(), place.tolist())]
        powers, step = _powers(length), max(1, PROBES // (len(at) * len(alphabet)))
        for low in range(0, length, step):
            part = points[:, low : low + step, None]
            moved = sums[:, -1][:, None, None] + (alphabet[None, None, :].astype(np.uint64) - part.astype(np.uint64)) * powers[low : low + step][None, :, None]
            row, place, letter = np.nonzero(alphabet[None, None, :] > part)
            moved = moved[row, place, letter]
            block, mask = layout.places(length, moved)
            hit = np.flatnonzero((blocks[block] & mask) == mask)
            row, place, letter = row[hit], place[hit] + low, alphabet[letter[hit]]
            yield at[row], [words[w][:p] + chr(c) + words[w][p + 1 :] for w, p, c in zip(at[row].tolist(), place.tolist(), letter.tolist())]


def near(words: DataFrame) -> DataFrame:
    """word, other and other's n for each two words of the vocabulary (word, n; distinct) that are one edit apart, both ways."""
    spark = words.sparkSession
    length = F.least(F.char_length("word"), F.lit(LONGEST)).alias("length")
    layout = Filters({r.length: r.n for r in words.groupBy(length).agg(F.count("*").alias("n")).collect()})
    alphabet = np.array(sorted(ord(r.c) for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()), np.uint32)
    blocks = spark.sparkContext.broadcast(_filter(words, layout))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                for at, edited in positives(part.column(0).to_pylist(), layout, blocks.value, alphabet):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(edited, pa.string())], names=["word", "n", "other"])

    probed = words.select("word", "n").mapInArrow(probe, "word string, n long, other string")
    found = probed.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    both = F.array(F.struct("word", "other", F.col("other_n").alias("n")), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), "n"))
    return found.select(F.explode(both).alias("x")).select("x.word", "x.other", "x.n")


def _roots(forms: DataFrame) -> DataFrame:
    """word and root: where following forms (word, form) ends. Each round doubles how far a word sees; a form
    has RATIO times its word's occurrences, so rounds grow with the logarithm of the logarithm of the largest n."""
    seen = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = seen.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = checkpointed(seen.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        seen = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return seen


def variants(words: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """word, n, n_near, form, form_n and root for each of the counted words (word, n) with ``fewest`` occurrences or more.

    A word's form is its near word of most occurrences (of several, the smallest by code points) if it has RATIO times its own.
    """
    kept: Column = (F.col("n") >= fewest) & (F.char_length("word") >= SHORTEST)
    words = checkpointed(words.where(kept).select("word", "n"))
    most = near(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best"))
    strong = -F.col("best.less") >= RATIO * F.col("n")
    out = words.join(most, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"))
    out = checkpointed(out)
    roots = _roots(out.where("form is not null"))
    return out.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def one_left_out(divisor: int) -> Callable[[str, object], str]:
    """A respelling: where the CRC-32 h of ``key:run`` is divisible by ``divisor``, code point h % length is left out. A null key leaves runs as they are."""

    def respelt(run: str, key: object) -> str:
        if key is None:
            return run
        h = zlib.crc32(f"{key}:{run}".encode())
        if h % divisor:
            return run
        at = h % len(run)
        return run[:at] + run[at + 1 :]

    return respelt
