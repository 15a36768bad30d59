"""Toxicity: a word classifier that is penalised for reacting to identity terms.

Logistic regression over the presence of words. Words are chosen by how far their share
among toxic documents differs from that among others. A labelled text that names no group is learnt with an
identity term put in, its label kept (terms of all kinds and languages take turns, so that each meets many
texts). Of each sentence counterfactuals are made: its terms are swapped for the others of their kind, and left out.
Besides the usual loss, the fit minimises the squared difference between the scores of a sentence and
its counterfactuals (weight ``FAIRNESS``). Without that, a term takes on whatever the labels of its texts
happen to lean to; with it, naming a group by itself hardly moves a score.

The classifier is fitted on the driver from at most about ``SAMPLE`` labelled documents, drawn by a
hash of the id. Of each sampled text only the words that are chosen and the identity terms come
to the driver, at most ``WORDS`` and a few dozen, whatever its length; the words are chosen from
counts of words over the sampled texts, of which the ``VOCABULARY`` most telling come to the driver.
A document is learnt from only if crc32 of its id as text isn't divisible by 5. The text alone
is an input of the score. Scoring is one pass without a shuffle.

Defined results: a null or empty text is scored by the intercept; repeated rows are scored
alike; ids with several labels count as toxic if at least half say so; null labels are left out;
without labels of both kinds the score is the share of toxic labels (0 if there are none);
columns named as those that the operator adds are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import sampled_texts
from .shared import checkpointed, map_texts

SAMPLE = 3_000
#: The most words that the classifier weighs.
WORDS = 1_000
#: The most words whose counts come to the driver.
VOCABULARY = 20_000
#: Longer runs of letters are weighed as no word.
LONGEST = 64
FAIRNESS, RIDGE, STEPS = 20.0, 1.0, 300
#: Terms of one kind stand in for each other; English, German, French and Spanish.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("black", "white", "asian", "latino"),
    ("immigrants", "natives", "refugees"), ("disabled", "deaf", "blind"), ("elderly", "young"),
    ("frauen", "männer"), ("mädchen", "jungen"), ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("schwule", "lesben", "heterosexuelle"), ("einwanderer", "einheimische", "flüchtlinge"), ("behinderte", "gehörlose", "blinde"),
    ("femmes", "hommes"), ("filles", "garçons"), ("musulmans", "chrétiens", "juifs", "hindous", "athées"),
    ("gays", "lesbiennes", "hétérosexuels"), ("immigrés", "réfugiés", "autochtones"), ("handicapés", "sourds", "aveugles"),
    ("mujeres", "hombres"), ("niñas", "niños"), ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"),
    ("homosexuales", "lesbianas", "heterosexuales"), ("inmigrantes", "refugiados", "nativos"), ("discapacitados", "sordos", "ciegos"),
)
TERMS = tuple(dict.fromkeys(t for kind in IDENTITY for t in kind))
SWAPS = {t: tuple(dict.fromkeys(o for kind in IDENTITY if t in kind for o in kind if o != t)) for t in TERMS}
_WORD = regex.compile(r"\p{L}+")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def naming(present: set[str], turn: int) -> set[str]:
    """A text's words as they are learnt: with an identity term, the one of that turn if there is none."""
    if present & set(TERMS):
        return present
    kind = IDENTITY[turn % len(IDENTITY)]
    return present | {kind[turn // len(IDENTITY) % len(kind)]}


def counterfactuals(present: set[str]) -> list[tuple[str, str | None]]:
    """What is taken out of a text's words and what is put in, for each of its counterfactuals."""
    return [(t, o) for t in TERMS if t in present for o in (*SWAPS[t], None) if o not in present]


@dataclass
class Classifier:
    intercept: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)

    def margin(self, present: set[str]) -> float:
        return self.intercept + sum(self.weights[w] for w in present & self.weights.keys())

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(words(text)), -30, 30))))


def choose(seen: dict[str, tuple[int, int]], total: tuple[int, int], most: int = WORDS, least: int = 3) -> list[str]:
    """The words whose shares in the two kinds of text (counts of texts by label) differ most, by a likelihood ratio."""
    names = sorted(w for w, c in seen.items() if sum(c) >= least)
    if not names:
        return []
    g2 = _ratio(np.array([seen[w] for w in names], float), np.array(total, float))
    order = sorted(range(len(names)), key=lambda i: (-g2[i], names[i]))[:most]
    # 10.8: a difference that chance would show for one word in a thousand.
    return [names[i] for i in order if g2[i] >= 10.8] or [names[order[0]]]


def _ratio(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    both, g2 = count.sum(1), np.zeros(len(count))
    for part, of in ((count, both), (total - count, total.sum() - both)):
        expected = of[:, None] * total / total.sum()
        g2 += 2 * (part * np.log(np.maximum(part, 1e-12) / np.maximum(expected, 1e-12))).sum(1)
    return g2


class _Rows:
    """Sparse rows of ones: which columns each row has."""

    def __init__(self, rows: list[list[int]], width: int):
        self.n, self.width = len(rows), width
        self.owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.array([c for r in rows for c in r], int)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.column], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, g[self.owner], self.width)


def fit(sets: list[set[str]], y: np.ndarray, fairness: float = FAIRNESS, chosen: list[str] | None = None) -> Classifier:
    """Minimise log loss, a ridge, and ``fairness`` times the mean squared change of score over counterfactuals.

    ``chosen``: the words to weigh, besides identity terms; from ``sets`` if not given."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Classifier(float(np.clip(np.log(max(share, 1e-13) / max(1 - share, 1e-13)), -30, 30)))
    if chosen is None:
        seen: dict[str, list[int]] = {}
        for s, label in zip(sets, y):
            for w in s:
                seen.setdefault(w, [0, 0])[int(label)] += 1
        chosen = choose({w: tuple(c) for w, c in seen.items()}, (int((y == 0).sum()), int((y == 1).sum())))
    sets = [naming(s, i) for i, s in enumerate(sets)]
    # Identity terms always take part, so that the penalty can act on them.
    at = {w: k for k, w in enumerate(dict.fromkeys([*chosen, *TERMS]))}
    pairs = [(i, out, into) for i, s in enumerate(sets) for out, into in counterfactuals(s)]
    x = _Rows([sorted(at[w] for w in s & at.keys()) for s in sets], len(at))
    owner = np.array([i for i, _, _ in pairs], int)
    # A counterfactual's margin is its sentence's less the weight of what is taken out plus that of what is put in.
    none = len(at)
    out, into = (np.array([at[p[k]] if p[k] else none for p in pairs], int) for k in (1, 2))
    n, m = len(y), max(len(pairs), 1)
    w, b = np.zeros(len(at)), float(np.log(y.mean() / (1 - y.mean())))
    speed, seen_ = np.zeros(len(at) + 1), np.zeros(len(at) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, STEPS + 1):
        z = x.dot(w) + b
        p = sigmoid(z)
        padded = np.append(w, 0.0)
        q = sigmoid(z[owner] - padded[out] + padded[into])
        change = 2 * fairness * (p[owner] - q) / m
        down = change * q * (1 - q)
        per_row = (p - y) / n + np.bincount(owner, change * (p * (1 - p))[owner] - down, n)
        gw = x.back(per_row) + RIDGE * w / n + (np.bincount(out, down, none + 1) - np.bincount(into, down, none + 1))[:none]
        g = np.append(gw, per_row.sum())
        speed, seen_ = 0.9 * speed + 0.1 * g, 0.999 * seen_ + 0.001 * g * g
        move = 0.1 * (speed / (1 - 0.9**step)) / (np.sqrt(seen_ / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return Classifier(b, {t: float(w[k]) for t, k in at.items()})


def mention_gap(model: Classifier, frames: list[str]) -> float:
    """How far, on average, naming a group moves the score of neutral sentences: each frame has a ``{}``."""
    return float(np.mean([abs(model.score(f.format(t)) - model.score(f.format(""))) for f in frames for t in TERMS]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fairness: float = FAIRNESS) -> Classifier:
    rows = sampled_texts(docs, labels.where(~held_out()), "toxic", sample)
    rows = checkpointed(map_texts(rows, ["doc_id", "label"], {"words": "array<string>"}, lambda texts: [[sorted(words(t)) for t in texts]]))
    total = rows.agg(F.count_if(F.col("label") == 0).alias("none"), F.count_if(F.col("label") == 1).alias("toxic")).first()
    counts = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("label") == 0).alias("none"), F.count_if(F.col("label") == 1).alias("toxic"))
    # The words whose shares differ most; the likelihood ratio picks among them.
    differs = F.abs(F.col("toxic") / F.lit(max(total["toxic"], 1)) - F.col("none") / F.lit(max(total["none"], 1)))
    first = counts.where(F.length("word") <= LONGEST).where("none + toxic >= 3").orderBy(differs.desc(), "word").limit(VOCABULARY).collect()
    kept = choose({r["word"]: (r["none"], r["toxic"]) for r in first}, (total["none"], total["toxic"])) if total["none"] and total["toxic"] else []
    known = F.array(*map(F.lit, dict.fromkeys([*kept, *TERMS])))
    got = rows.select("doc_id", "label", F.array_sort(F.array_intersect("words", known)).alias("words")).orderBy("doc_id", "words").select("label", "words").toArrow()
    return fit([set(w) for w in got.column("words").to_pylist()], np.array(got.column("label").to_pylist(), float), fairness, kept)


def score(docs: DataFrame, model: Classifier, keep: list[str] | None = None) -> DataFrame:
    """Documents with held_out, score and predicted. ``keep``: the columns that stay, all if not given."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> list:
        return [[shared.value.score(t) for t in texts]]

    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("held_out", "predicted")]
    scored = map_texts(docs, keep, {"score": "double"}, run)
    return scored.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
