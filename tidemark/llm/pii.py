"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Candidates are spans of eight kinds: four with fixed patterns and checks (email, ip, card, phone) and
four that the method adds (obfuscated addresses, national phone numbers, secrets, and card numbers
within longer runs of digits). Six labelers look at a candidate and vote yes, no or nothing: its
strict form or check (Luhn, transitions between letters and digits, a bracketed at), lists of known
providers, dialling codes, issuers and token prefixes, words before it that speak for its kind, words
before it that speak against personal data, what stands right behind it (units, file endings), and
its spread of characters. They often disagree, and none decides alone.

Expectation-maximisation estimates how reliable each labeler is for each kind, from all candidates
of the corpus: first over all kinds together, then kind by kind, where the common estimate counts as
``PRIOR`` candidates, so that rare kinds lean on it. The result says how likely each pattern of votes is
personal data; a logistic span classifier is trained on that, with a kind's own weight for each
vote and features of context that no labeler sees (the characters around, length, share of digits).
Spans of the fixed kinds that pass their checks always stay; spans of the added kinds stay if the
classifier says so.

Candidates are counted by kind, votes and coarse shape: at most 8 * 3**6 * 96 counted rows reach the
driver, at any size of the corpus; a few hundred are usual. Whole texts are read; no text is shuffled.

Defined results: a null or empty text has no spans; repeated rows get the same spans; an
empty table trains nothing and then only fixed kinds are returned; columns named as those that
the operator adds are replaced. Spans count code points; ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import fresh, map_texts, named

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "localphone", "secret", "cardpart")
LABELERS = 6
#: How many candidates the habits that all kinds share count for in the estimate of one kind.
PRIOR = 10.0
#: Patterns of the contract; the possessive forms match the same spans.
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HIDDEN = re.compile(r"(?<![\w.])[A-Za-z0-9._-]{2,64}(?: ?[\[(] ?(?:at|AT) ?[\])] ?| at )[A-Za-z0-9-]{2,63}(?:(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?| dot |\.)[A-Za-z]{2,63}){1,4}")
_NATIONAL = re.compile(r"(?<![0-9+.,)-])(?<!\+[0-9] )(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ -])[0-9]{3,4}[ -][0-9]{3,5}(?![0-9.-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_-]{20,}+")
_DIGIT = re.compile(r"[0-9]")
_CARDPART = re.compile(r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])")
_TURNS = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])")
_MAIL = ("mail", "email", "contact", "write", "reach", "e-mail", "courriel", "correo", "kontakt", "contacto", "adresse")
_CALL = ("call", "tel", "phone", "mobile", "fax", "dial", "telefon", "téléphone", "teléfono", "handy", "anrufen", "appeler", "llamar", "whatsapp", "sms")
_PAY = ("card", "visa", "mastercard", "amex", "credit", "payment", "karte", "carte", "tarjeta", "debit", "cc", "pay")
_WORDS = {
    "email": {*_MAIL}, "address": {*_MAIL}, "phone": {*_CALL}, "localphone": {*_CALL}, "card": {*_PAY}, "cardpart": {*_PAY},
    "ip": {"ip", "host", "server", "address", "from", "client", "peer", "login", "gateway", "dns"},
    "secret": {"token", "password", "passwd", "secret", "key", "apikey", "api_key", "bearer", "auth", "authorization", "credential", "pwd", "access_token", "kennwort", "passwort", "clave"},
}
_AGAINST = {
    "version", "page", "chapter", "section", "isbn", "issn", "sha", "sha1", "sha256", "md5", "commit", "order", "price", "invoice", "figure", "table", "rfc",
    "release", "build", "checksum", "digest", "file", "path", "url", "id", "uuid", "serial", "model", "seite", "kapitel", "page", "página", "see", "item", "score",
}
_BEHIND = re.compile(r"\s?(?:%|°|kg\b|km\b|cm\b|mm\b|[KMGT]i?B\b|eur\b|usd\b|€|\$|\.(?:html?|php|png|jpe?g|pdf|txt|js|css|zip|gz|py|java)\b|/[a-z])", re.I)
_PROVIDERS = (
    "gmail.com", "googlemail.com", "yahoo.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "aol.com", "icloud.com", "me.com", "proton.me", "protonmail.com", "gmx.de", "gmx.net", "web.de",
    "t-online.de", "freenet.de", "orange.fr", "free.fr", "wanadoo.fr", "laposte.net", "sfr.fr", "mail.ru", "yandex.ru", "qq.com", "163.com", "zoho.com", "fastmail.com", "comcast.net", "terra.es", "telefonica.net",
    "example.com", "example.org", "example.net",
)
_ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "nl", "ch", "at", "be", "us", "ca", "au", "jp", "cn", "ru", "br", "mx", "ar", "eu")
_ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "223", "224", "225", "226", "227", "23", "24", "25", "26", "270", "271", "2720", "34", "37", "6011", "644", "645", "646", "647", "648", "649", "65", "35", "30", "36", "38", "62")
_DIALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "212", "213", "216", "234", "254", "351", "352", "353", "358", "359", "370", "371", "372", "380", "385", "386", "420", "421", "852", "886", "966", "971", "972")
_TOLL_FREE = ("800", "888", "877", "866", "855", "900", "0800", "0900")
_KNOWN_SECRETS = ("sk-", "sk_live_", "sk_test_", "pk-", "pk_live_", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "AKIA", "ASIA", "AIza", "eyJ", "npm_", "pypi-", "dop_v1_", "hf_", "SG-")
_PLAIN_WORD = re.compile(r"[-_]?[a-z]{3,}(?=[-_]|$)")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    twice = [int(d) for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in twice)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """From each @ to both sides: the longest run before it that no earlier match has taken."""
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            taken = m.end()
        at = text.find("@", max(at + 1, taken))


def base_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """Matches of the four fixed patterns, and whether they pass their checks."""
    out = [(*s, True) for s in emails(text)]
    for block in _DOTTED.finditer(text):
        if block.group().count(".") > 2:
            for m in _IP.finditer(block.group()):
                fine = all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m.group().split(".")))
                out.append(("ip", block.start() + m.start(), block.start() + m.end(), fine))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 9:
            digits = _digits(m.group())
            out.append(("card", m.start(), m.end(), 13 <= len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        for m in _PHONE.finditer(text):
            out.append(("phone", m.start(), m.end(), 9 <= len(_digits(m.group())) <= 15))
    return out


def added_spans(text: str, fixed: list[tuple[str, int, int, bool]]) -> list[tuple[str, int, int, bool]]:
    """Candidates of the added kinds that don't touch a fixed span which passed its checks."""
    out = [("secret", m.start(), m.end(), True) for m in _SECRET.finditer(text) if _DIGIT.search(text, m.start(), m.end())]
    if " at " in text or "(" in text or "[" in text:
        out += [("address", m.start(), m.end(), True) for m in _HIDDEN.finditer(text)]
    out += [("localphone", m.start(), m.end(), True) for m in _NATIONAL.finditer(text)]
    out += [("cardpart", s + m.start(), s + m.end(), True) for k, s, e, fine in fixed if k == "card" and not fine and e - s >= 13 for m in _CARDPART.finditer(text[s:e])]
    passed = [(s, e) for _, s, e, fine in fixed if fine]
    if not passed or not out:
        return out
    starts, ends = np.array(sorted(s for s, _ in passed)), np.array(sorted(e for _, e in passed))
    # Spans that begin before a candidate's end, less those that end by its start.
    return [o for o in out if np.searchsorted(starts, o[2]) == np.searchsorted(ends, o[1], "right")]


def _strict(kind: str, span: str, digits: str, fine: bool) -> int:
    """The strict form or check of a kind."""
    if kind == "cardpart":
        return 1 if luhn(digits) else -1
    if kind == "address":
        return 1 if "[" in span or "(" in span else -1 if span.lower().rsplit(".", 1)[-1].rsplit(" ", 1)[-1] not in _ENDINGS else 0
    if kind == "localphone":
        return 1 if 9 <= len(digits) <= 11 else -1 if len(digits) < 8 else 0
    if kind == "secret":
        turns = len(_TURNS.findall(span))
        return 1 if turns >= 5 else -1 if turns <= 2 else 0
    return 1 if fine else -1


def _listed(kind: str, span: str, digits: str) -> int:
    """What lists of known beginnings and endings say."""
    low = span.lower()
    if kind in ("email", "address"):
        return 1 if low.endswith(_PROVIDERS) else 0 if low.endswith(tuple(f"{sep}{e}" for e in _ENDINGS for sep in ". ")) else -1
    if kind == "phone":
        return 1 if digits.startswith(_DIALLING) else -1
    if kind == "localphone":
        return -1 if digits.startswith(_TOLL_FREE) else 0
    if kind in ("card", "cardpart"):
        return 1 if digits.startswith(_ISSUERS) else -1
    if kind == "secret":
        return 1 if span.startswith(_KNOWN_SECRETS) else -1 if sum(map(len, _PLAIN_WORD.findall(span))) * 2 > len(span) else 0
    return -1 if span.startswith(("0.", "127.", "255.")) else 1 if span.startswith(("10.", "192.168.")) else 0


def votes(text: str, kind: str, start: int, end: int, fine: bool) -> tuple[int, ...]:
    """The vote of each labeler: 1, -1 or 0."""
    span, before = text[start:end], text[max(0, start - 40) : start].lower()
    digits = _digits(span)
    near = {w.strip(".:;,=\"'()[]{}<>|") for w in re.split(r"[\s=:]+", before)[-6:]}
    spread = len(set(digits if kind in ("card", "cardpart", "phone", "localphone") else span))
    wide = 10 if kind == "secret" else 4 if digits and kind != "email" else 3
    return (
        _strict(kind, span, digits, fine),
        _listed(kind, span, digits),
        1 if near & _WORDS[kind] else 0,
        -1 if near & _AGAINST else 0,
        -1 if _BEHIND.match(text, end) else 0,
        1 if spread >= wide else -1,
    )


def _side(c: str) -> int:
    """The kind of character that stands beside a span: none or a blank, a quote, a sign that assigns, another."""
    return 0 if not c or c.isspace() else 1 if c in "\"'`<>()[]{}" else 2 if c in "=:/#@" else 3


def key(text: str, kind: str, start: int, end: int, fine: bool) -> str:
    """Kind, votes and coarse shape as a short text."""
    length = min(3, (end - start) // 12)
    mostly_digits = int(2 * len(_digits(text[start:end])) > end - start)
    return f"{KINDS.index(kind)}{''.join('-0+'[v + 1] for v in votes(text, kind, start, end, fine))}{length}{mostly_digits}{_side(text[start - 1 : start])}{min(2, _side(text[end : end + 1]))}"


def _parse(k: str) -> tuple[int, list[int], list[int]]:
    return int(k[0]), ["-0+".index(c) - 1 for c in k[1 : 1 + LABELERS]], [int(c) for c in k[1 + LABELERS :]]


def _features(keys: list[str]) -> np.ndarray:
    """For each kind an intercept and a weight for each vote; then the shape and the sides."""
    rows = np.zeros((len(keys), len(KINDS) * (1 + LABELERS) + 2 + 4 + 3))
    for row, k in zip(rows, keys):
        kind, vote, (length, digits, left, right) = _parse(k)
        at = kind * (1 + LABELERS)
        row[at] = 1.0
        row[at + 1 : at + 1 + LABELERS] = vote
        tail = row[len(KINDS) * (1 + LABELERS) :]
        tail[0], tail[1], tail[2 + left], tail[6 + right] = length / 3, digits, 1.0, 1.0
    return rows


def em(vote: np.ndarray, weight: np.ndarray, rounds: int = 50, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How likely each row is positive, and table[class, labeler, vote + 1] of the labelers' habits.

    Starts from the sum of votes, or from the habits ``before``, which then count as ``PRIOR``
    candidates of each class; counts are smoothed, so that no vote is proof.
    """
    habits = np.zeros((2, vote.shape[1], 3)) if before is None else before.copy()
    positive = 1 / (1 + np.exp(-vote.sum(1).astype(float))) if before is None else _posterior(vote, habits, 0.5)
    for _ in range(rounds):
        prior = np.clip((weight * positive).sum() / weight.sum(), 0.01, 0.99)
        for c, p in enumerate((1 - positive, positive)):
            for j in range(vote.shape[1]):
                n = np.bincount(vote[:, j] + 1, weight * p, 3) + (1.0 if before is None else PRIOR * before[c, j])
                habits[c, j] = n / n.sum()
        positive = _posterior(vote, habits, prior)
    return positive, habits


def _posterior(vote: np.ndarray, habits: np.ndarray, prior: float) -> np.ndarray:
    log = np.log(habits)
    odds = np.log(prior / (1 - prior)) + sum(log[1, j, vote[:, j] + 1] - log[0, j, vote[:, j] + 1] for j in range(vote.shape[1]))
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


@dataclass
class SpanModel:
    """Weights of the classifier; how reliable each labeler is, for each kind (table[class, labeler, vote + 1])."""

    weights: np.ndarray | None = None
    reliability: dict[str, np.ndarray] = field(default_factory=dict)

    def scores(self, keys: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(keys))
        return 1 / (1 + np.exp(-np.clip(_features(keys) @ self.weights, -30, 30)))


def fit(counts: dict[str, int]) -> SpanModel:
    """EM over vote patterns, together and then kind by kind; a weighted logistic regression on its result."""
    if not counts:
        return SpanModel()
    keys = sorted(counts)
    weight = np.array([counts[k] for k in keys], float)
    parsed = [_parse(k) for k in keys]
    kind, vote = np.array([p[0] for p in parsed]), np.array([p[1] for p in parsed])
    target, common = em(vote, weight)
    reliability = {}
    for k in np.unique(kind).tolist():
        rows = kind == k
        target[rows], reliability[KINDS[k]] = em(vote[rows], weight[rows], before=common)
    x = _features(keys)
    w = np.zeros(x.shape[1])
    share = weight / weight.sum()
    for _ in range(25):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (share * (target - p)) - 1e-3 * w)
    return SpanModel(w, reliability)


CANDIDATES = "array<struct<kind:string,start:int,end:int,fine:boolean,key:string>>"
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"


def _candidates(text: str) -> list[dict]:
    fixed = base_spans(text)
    return [{"kind": s[0], "start": s[1], "end": s[2], "fine": s[3], "key": key(text, *s)} for s in [*fixed, *added_spans(text, fixed)]]


def _decided(found: list[dict], model: SpanModel, threshold: float) -> list[dict]:
    """The candidates of one text that stay, ordered by kind as in ``KINDS``, then start."""
    found = [s for s in found if s["fine"]]
    scores = model.scores([s["key"] for s in found]) if found else []
    rows = [{"kind": s["kind"], "start": s["start"], "end": s["end"], "base": s["kind"] in BASE, "score": float(p)} for s, p in zip(found, scores) if s["kind"] in BASE or p >= threshold]
    return sorted(rows, key=lambda r: (KINDS.index(r["kind"]), r["start"]))


def candidates(docs: DataFrame, keep: list[str], column: str = "spans") -> DataFrame:
    """The columns of ``keep`` and, as ``column``, each text's candidates: one pass over the texts."""
    return map_texts(docs, keep, {column: CANDIDATES}, lambda texts: [[_candidates(t) for t in texts]])


def train(docs: DataFrame) -> SpanModel:
    return train_from(candidates(docs, []))


def train_from(found: DataFrame) -> SpanModel:
    """A model from all candidates of a corpus (``candidates``)."""
    counts = found.select(F.explode("spans.key").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return fit({r["key"]: r["n"] for r in counts.collect()})


def decide(found: DataFrame, model: SpanModel, threshold: float = 0.5) -> DataFrame:
    """``candidates`` with ``spans`` as kind, start, end, base and score: those that stay. No text is needed."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    names = [c for c in found.columns if c != "spans"]
    schema = T.StructType([found.schema[c] for c in names] + [T.StructField("spans", T.DataType.fromDDL(SPANS))])
    kind = to_arrow_type(schema["spans"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_decided(spans, shared.value, threshold) for spans in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, kind)], names=[*names, "spans"])

    return found.select(*[named(c).alias(f"c{i}") for i, c in enumerate(names)], "spans").mapInArrow(run, schema)


def find(docs: DataFrame, model: SpanModel, keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Documents with ``spans``, in one pass. ``keep``: the columns that stay, all if not given."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, docs.columns if keep is None else keep, {"spans": SPANS}, lambda texts: [[_decided(_candidates(t), shared.value, threshold) for t in texts]])


def digests(found: DataFrame) -> DataFrame:
    """The counts and digest of the fixed kinds, and all spans as text."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"))


def redact(found: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each stretch of text that spans cover by the kind of its first span in brackets."""
    starts = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.expr("array_remove(array(''), '')").alias("parts"))

    def step(acc, s):
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["parts"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(acc["parts"]).alias("parts"),
        )

    done = F.aggregate(starts, start, step)
    made = fresh(found.columns, "_done")
    out, redacted = found.withColumn(made, F.when(F.size("spans") > 0, done)), F.col(made)
    text = F.when(redacted.isNull(), F.col("text")).otherwise(F.concat(F.array_join(redacted["parts"], ""), F.substring(F.col("text"), redacted["at"] + 1, F.length("text"))))
    out = out.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(redacted.isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*map(named, columns))
