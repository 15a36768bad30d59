"""Runs of periodic words within texts, from maximal pairs of an LCP-interval tree.

Words are runs of other characters than ASCII blanks, numbered from 0. A run is a stretch of words with
smallest period q and a length of at least max(``LEAST``, ``TIMES`` * q) that no neighbouring word extends
with that period. It is a maximal pair: the stretch from its start and the one q words on share
length - q words, not one more on the right, and have different words on the left. So runs are read off the tree of
the suffixes' common prefixes, bottom up, without extending anything:

- suffixes are sorted by doubling (pairs of ranks of half the length), and the ranks of all lengths give the length of
  the longest common prefix of neighbours;
- each interval of the tree keeps its positions in order. Where it takes in a child, each position of the smaller
  side meets its neighbours on the other. A pair whose left words differ, with three times its distance at most the
  common length (``TIMES`` - 1 in general), is a run. Only neighbours need be looked at: occurrences of a prefix at so
  small distances lie at multiples of its period, so all but the first have the same left word, and the first one's
  nearest gives the smallest period. Pairs at multiples of it start and end alike, and fall away.

Only texts in which as many words repeat as the shortest common prefix of a run has are sorted at all.

Defined results: texts that are null or without a word have no runs and an empty collapsed text; words compare by
their bytes; rows of equal ids are documents of their own; an empty table gives no rows; clashing names give
way to the added columns. A text is cut in pieces, and its words are numbers from then on: memory is some 100 bytes a word.
"""

from __future__ import annotations

import re
from bisect import bisect, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import map_texts

LEAST, TIMES = 6, 4
#: Bytes of a text whose words are made at a time.
PIECE = 1 << 20
#: The shortest common prefix of a run's two sides.
SHORTEST = min(max(LEAST, TIMES * q) - q for q in range(1, LEAST + 1))

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
Run = tuple[int, int, int]


class Codes(dict):
    """A number for each word, in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of ``PIECE`` bytes and what is left of the last word."""
    at = 0
    while len(text) - at > PIECE:
        blank = _BLANK.search(text, at + PIECE)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def coded(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The text's words as numbers, and the word of each number."""
    codes = Codes()
    parts = [np.fromiter(map(codes.__getitem__, words), np.int64, len(words)) for words in map(bytes.split, pieces(text))]
    return np.concatenate(parts), list(codes)


def _repeats(words: np.ndarray, n: int) -> np.ndarray:
    """Positions where n words start that may also start elsewhere (or whose hash does)."""
    if len(words) <= n:
        return np.zeros(0, np.int64)
    key, most = np.zeros(len(words) - n + 1, np.uint64), len(words) - n + 1
    for i in range(n):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + words[i : i + most].astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    return order[np.append(same, False) | np.append(False, same)]


def sorted_suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of the words from there on, and the common length of each with the one before it.

    ``words`` ends with a word that is found nowhere else, as must each text within it.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    rank, levels, length = np.zeros(n + 1, np.int64), [], 1
    new = np.append(True, words[order][1:] != words[order][:-1])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in groups of several
    while len(open_):
        levels.append(rank.astype(np.int32))
        at = order[open_]
        key = (rank[at] << 32) | rank[at + length]
        by = np.argsort(key)
        key, order[open_] = key[by], at[by]
        new = np.append(True, key[1:] != key[:-1])
        rank[order[open_]] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[~(new & np.append(new[1:], True))]
        length *= 2
    common = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    for k, ranks in reversed(list(enumerate(levels))):
        alike = ranks[a + common[1:]] == ranks[b + common[1:]]
        common[1:] += alike * (1 << k)
    return order, common


def maximal_pairs(order: np.ndarray, common: np.ndarray, left: list[int]) -> Iterator[Run]:
    """start, length and period of stretches whose two sides make a maximal pair, by the tree of common prefixes."""
    deep = common >= SHORTEST
    found: list[Run] = []

    def merged(some: list[int], more: list[int], depth: int) -> list[int]:
        if len(some) < len(more):
            some, more = more, some
        far = min(depth // (TIMES - 1), depth)
        for p in more:
            k = bisect(some, p)
            if k and p - some[k - 1] <= far and left[p] != left[some[k - 1]]:
                found.append((some[k - 1], depth + p - some[k - 1], p - some[k - 1]))
            if k < len(some) and some[k] - p <= far and left[p] != left[some[k]]:
                found.append((p, depth + some[k] - p, some[k] - p))
        if len(more) > 8:
            some += more
            some.sort()
        else:
            for p in more:
                insort(some, p)
        return some

    # Subtrees of common length SHORTEST and more, one after the other.
    starts = np.flatnonzero(~deep & np.append(deep[1:], False)).tolist()
    ends = np.flatnonzero(deep & np.append(~deep[1:], True)).tolist()
    for start, end in zip(starts, ends):
        places, depths = order[start : end + 1].tolist(), common[start + 1 : end + 1].tolist()
        depths.append(0)
        stack: list[tuple[int, list[int]]] = []
        for place, depth in zip(places, depths):
            node = [place]
            while stack and stack[-1][0] > depth:
                of, positions = stack.pop()
                node = merged(positions, node, of)
            if stack and stack[-1][0] == depth:
                of, positions = stack.pop()
                node = merged(positions, node, of)
            stack.append((depth, node))
        yield from found
        found.clear()


def runs_of(texts: list[np.ndarray]) -> list[list[Run]]:
    """The runs (start, length, period) of each text, given as numbers of its words, by start and period."""
    out: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    offset, parts, spans = 0, [], []
    for words in texts:  # each text has numbers of its own
        top = int(words.max()) + 1 if len(words) else 0
        parts += [words + offset, np.array([offset + top])]
        offset += top + 1
    flat = np.concatenate([np.array([offset]), *parts]) if parts else np.zeros(1, np.int64)
    bounds = np.cumsum([1] + [len(words) + 1 for words in texts])
    concerned = np.unique(np.searchsorted(bounds, _repeats(flat, SHORTEST), "right") - 1)
    spans = [(i, int(bounds[i]), int(bounds[i + 1])) for i in concerned.tolist() if i >= 0]
    if not spans:
        return [[] for _ in texts]
    flat = np.concatenate([flat[:1], *[flat[s:e] for _, s, e in spans]])
    firsts = np.cumsum([1] + [e - s for _, s, e in spans])
    order, common = sorted_suffixes(flat)
    left = np.append(-1, flat[:-1]).tolist()
    for start, length, period in maximal_pairs(order, common, left):
        if length >= max(LEAST, TIMES * period):
            k = int(np.searchsorted(firsts, start, "right")) - 1
            own, at = out[spans[k][0]], (start - int(firsts[k]), length)
            own[at] = min(period, own.get(at, period))
    return [sorted(((s, n, q) for (s, n), q in own.items()), key=lambda r: (r[0], r[2])) for own in out]


def collapsed(words: np.ndarray, names: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that a run contains after its first period, joined by one space."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([names[w] for w in words[keep].tolist()])


def find(docs: DataFrame, keep: list[str], arranged: Callable[[object, int], np.ndarray | None] | None = None, key: str | None = None) -> DataFrame:
    """Columns ``keep`` of the documents, n_words, runs (array of start, length, period, in order) and collapsed (text).

    ``arranged`` may give, for a document's value of the kept column ``key`` and its number of words, the positions
    whose words it is to have instead, one a word.
    """

    def run(texts: pa.Array, keys: list | None = None) -> list:
        words, names = [], []
        for k, text in enumerate(texts.cast(pa.binary()).to_pylist()):
            own, own_names = coded(text)
            places = arranged(keys[k], len(own)) if arranged and keys else None
            words.append(own if places is None else own[places])
            names.append(own_names)
        runs = runs_of(words)
        listed = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs]
        return [[len(w) for w in words], listed, pa.array([collapsed(*x) for x in zip(words, names, runs)], pa.binary()).cast(pa.string())]

    kept = [c for c in keep if c.lower() not in ("n_words", "runs", "collapsed")]
    return map_texts(docs, kept, {"n_words": "long", "runs": "array<struct<start: long, length: long, period: long>>", "collapsed": "string"}, run, arrow=True, key=key)
