"""Quality rules: document statistics and gradient-boosted trees.

``statistics`` are counted over each whole text. Fixed rules reject documents outright;
for the rest, boosted trees give the chance that a document is of good quality. The trees
are grown here with numpy on histograms of the statistics; features in ``MONOTONE`` may only
move the score one way. Trained trees are flattened into arrays of nodes, and all rows of a
batch walk down a level at a time.

The trees are fitted on at most ``SAMPLE`` labelled documents, drawn by a hash of the id, on
the driver; the statistics of those few documents are a few MB. The rest is one pass over the
documents without a shuffle.

Defined results: a null or empty text has zero statistics and fails the rules (under 50
words); repeated rows are judged alike; ids with several labels count as good if at least half
say so; labels that are null are left out; without labels of both kinds the rules decide alone;
columns named as those that the operator adds are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_texts

#: The most labelled documents that the trees are fitted on.
SAMPLE = 8_000
BLANKS, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The columns that ``assess`` adds.
ADDED = [*COUNTS, "base_failed", "quality", "kept"]
FEATURES = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "bang_share", "bar_share", "distinct_share"]
#: -1: more of it never raises the score.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _repeated(hashes: np.ndarray) -> int:
    """Words in windows of three that occur at least twice."""
    n = len(hashes) - 2
    if n < 2:
        return 0
    windows = hashes[:n] * _A + (hashes[1 : n + 1] ^ (hashes[1 : n + 1] >> np.uint64(31))) * _B + (hashes[2:] ^ (hashes[2:] >> np.uint64(29)))
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(n + 2, bool)
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    for i in range(3):
        twice[i : i + n] |= hit
    return int(twice.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of ``COUNTS`` and the features of ``FEATURES`` of one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dups = len(lines) - len(set(lines))
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    repeats = _repeated(hashes)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    digits = int(((raw >= 48) & (raw <= 57)).sum())
    size, many = max(chars, 1), max(n, 1)
    features = [np.log1p(n), chars / many, symbols / size, dups / max(len(lines), 1), repeats / many, upper / size, digits / size, text.count("!") / many, text.count("|") / many, len(np.unique(hashes)) / many]
    return [n, chars, symbols, dups, repeats], features


def _columns(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    both = [statistics(t) for t in texts]
    return np.array([b[0] for b in both], np.int64).reshape(-1, len(COUNTS)), np.array([b[1] for b in both]).reshape(-1, len(FEATURES))


class Trees:
    """Boosted trees as flat arrays: for each node its feature, threshold, children and value."""

    def __init__(self, base: float = 0.0):
        self.base = base
        self.feature, self.threshold, self.left, self.right, self.value = (np.zeros(0, t) for t in (np.int32, float, np.int32, np.int32, float))
        self.roots: list[int] = []
        self.depth = 0

    def add(self, nodes: list[tuple[int, float, int, int, float]], depth: int) -> None:
        shift = len(self.feature)
        f, t, a, b, v = zip(*nodes)
        self.roots.append(shift)
        self.feature = np.append(self.feature, np.array(f, np.int32))
        self.threshold = np.append(self.threshold, t)
        self.left = np.append(self.left, np.array(a, np.int32) + shift)
        self.right = np.append(self.right, np.array(b, np.int32) + shift)
        self.value = np.append(self.value, v)
        self.depth = max(self.depth, depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves' values: all trees and rows at once, a level at a time."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):  # a leaf is its own child
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 5, ridge: float = 1.0) -> Trees:
    """Grow trees on logistic loss; ``monotone`` has -1, 0 or 1 for each feature."""
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(prior / (1 - prior))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        nodes: list[list] = [[0, 0.0, 0, 0, 0.0]]
        # rows, depth, and the bounds that the constraints leave to the node's value
        open_ = [(0, np.arange(len(y)), 0, -np.inf, np.inf)]
        while open_:
            at, rows, level, low, high = open_.pop()
            weight = lambda a, b: np.clip(a / (b + ridge), low, high)  # noqa: B023, E731
            nodes[at] = [0, 0.0, at, at, float(rate * weight(g[rows].sum(), h[rows].sum()))]
            if level == depth or len(rows) < 2 * least:
                margin[rows] += nodes[at][4]
                continue
            best = (1e-6, None)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, len(e) + 1)) for w in (g[rows], h[rows], None))
                gl, hl, nl = gs[:-1], hs[:-1], ns[:-1]
                gr, hr, nr = gs[-1] - gl, hs[-1] - hl, ns[-1] - nl
                wl, wr = weight(gl, hl), weight(gr, hr)
                loss = lambda w, a, b: a * w - 0.5 * (b + ridge) * w * w
                gain = loss(wl, gl, hl) + loss(wr, gr, hr) - loss(weight(gs[-1], hs[-1]), gs[-1], hs[-1])
                gain[(nl < least) | (nr < least)] = -np.inf
                if monotone[j]:
                    gain[monotone[j] * (wr - wl) < 0] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, wl[k], wr[k]))
            if best[1] is None:
                margin[rows] += nodes[at][4]
                continue
            j, k, wl, wr = best[1]
            goes = binned[rows, j] <= k
            middle = (wl + wr) / 2
            bounds = ((low, high), (low, high)) if not monotone[j] else ((low, middle), (middle, high)) if monotone[j] > 0 else ((middle, high), (low, middle))
            a, b = len(nodes), len(nodes) + 1
            nodes += [[0, 0.0, a, a, 0.0], [0, 0.0, b, b, 0.0]]
            nodes[at] = [j, float(edges[j][k]), a, b, 0.0]
            open_ += [(a, rows[goes], level + 1, *bounds[0]), (b, rows[~goes], level + 1, *bounds[1])]
        model.add([tuple(n) for n in nodes], depth)
    return model


def sampled_labels(labels: DataFrame, column: str, most: int) -> DataFrame:
    """doc_id and the 0/1 label of at most about ``most`` documents, drawn by a hash of the id."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("label"))
    there = labels.count()
    share = min(1.0, most / max(there, 1))
    return one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def sampled_texts(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """doc_id, label and text of at most about ``most`` labelled documents: one row an id, that of the smallest text."""
    rows = docs.select("doc_id", "text").join(F.broadcast(sampled_labels(labels, column, most)), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees for ``labels.quality``; None without labels of both kinds."""
    rows = sampled_texts(docs, labels, "quality", sample)
    rows = map_texts(rows, ["doc_id", "label"], {"features": "array<double>"}, lambda texts: [list(_columns(texts)[1])]).orderBy("doc_id", "features").toPandas()
    y = rows["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.stack(rows["features"].to_list()), y, [MONOTONE.get(f, 0) for f in FEATURES])


def assess(docs: DataFrame, model: Trees | None, keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Documents with the counts, base_failed, quality (the trees' score) and kept.

    ``keep``: the columns that stay, all if not given.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> list:
        counts, features = _columns(texts)
        failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
        score = shared.value.score(features) if shared.value is not None else np.ones(len(texts))
        return [*counts.T, failed, score, ~failed & (score >= threshold)]

    added = {c: "long" for c in COUNTS} | {"base_failed": "boolean", "quality": "double", "kept": "boolean"}
    return map_texts(docs, docs.columns if keep is None else keep, added, run)
