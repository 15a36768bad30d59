"""Column functions that read dates, sizes, states, countries and sectors from text.

None raises on odd input: what can't be read is null (or ``unknown``). Dates are UTC, so the
session's time zone must be UTC.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .places import ALIASES, CODES, SECTORS
from .text import none_if_empty, stripped

#: Date formats, tried in this order; days come before months.
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM, yyyy", "d MMMM, yyyy", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "d.M.yyyy H:m", "M/d/yyyy")
#: Powers of 1024 of the units that a size may have.
SIZE_UNITS = {"b": 0, "k": 1, "kb": 1, "kib": 1, "m": 2, "mb": 2, "mib": 2, "g": 3, "gb": 3, "gib": 3, "t": 4, "tb": 4, "tib": 4, "pb": 5, "pib": 5}
SIZE = r"(?i)(\d+(?:[.,]\d+)?)\s*([kmgtp]?i?b|[kmgt])\b"
#: What speaks for a state, and how much.
STATUS_SIGNALS = (
    (r"\bstatus\s*[:\-]\s*(published|leaked|disclosed)\b", "published", 5),
    (r"\bstatus\s*[:\-]\s*(sold|purchased)\b", "sold", 5),
    (r"\bstatus\s*[:\-]\s*(removed|deleted)\b", "removed", 5),
    (r"\b(sold|purchased|buyer\s+found)\b", "sold", 3),
    (r"\b(removed|deleted|taken\s+down|withdrawn)\b", "removed", 3),
    (r"\b(negotiat\w*|in\s+talks|payment\s+pending)\b", "negotiating", 3),
    (r"\b(paid|ransom\s+paid)\b", "negotiating", 2),
    (r"\b(full\s+dump|disclosed|released|published)\b", "published", 2),
    (r"\b(countdown|deadline|time\s+left|expires?\s+in|days?\s+left)\b", "countdown", 2),
    (r"\b(leaked|leak)\b", "published", 1),
)
#: States from the most decisive on; earlier ones win ties.
STATUS_PRECEDENCE = ("removed", "sold", "negotiating", "published", "countdown")


def _shape(fmt: str) -> str:
    """How a text looks that a date format may fit."""
    parts = {"yyyy": r"\d{4}", "MMMM": "[A-Za-z]{3,9}", "MMM": "[A-Za-z]{3}", "M": r"\d{1,2}", "d": r"\d{1,2}", "H": r"\d{1,2}", "m": r"\d{1,2}", "s": r"\d{1,2}", "'T'": "T"}
    return "^" + re.sub("yyyy|MMMM|MMM|'T'|[MdHms]|[.]", lambda m: parts.get(m[0], r"\."), fmt) + "$"


#: What may stand before and behind a date, and brackets around it.
DATE_LEAD, DATE_TAIL, DATE_BRACKETS = r"(?i)^\s*(published|updated|date|added)\s*[:\-]\s*", r"(?i)\s*\((utc|gmt)\)\s*$", "[](){} \t\n\r"
#: Fixed value: an ISO moment; its clock time counts as it stands, whatever offset follows.
ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?$"


def parse_date(raw: Column) -> Column:
    """The moment of a decorated date, or null. A format is tried only on texts of its shape, since failing costs."""
    text = F.btrim(F.regexp_replace(F.regexp_replace(stripped(raw), DATE_LEAD, ""), DATE_TAIL, ""), F.lit(DATE_BRACKETS))
    part = lambda n: F.regexp_extract(text, ISO, n)
    moment = F.concat(part(1), F.lit(" "), part(2), F.coalesce(none_if_empty(part(3)), F.lit(":00")))
    tried = [F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in DATE_FORMATS]
    return F.coalesce(F.when(text.rlike(ISO), F.try_to_timestamp(moment, F.lit("yyyy-MM-dd HH:mm:ss"))), *tried)


def parse_size(raw: Column) -> Column:
    value = F.replace(F.regexp_extract(raw, SIZE, 1), F.lit(","), F.lit("."))
    power = F.create_map(*[F.lit(x) for kv in SIZE_UNITS.items() for x in kv])[F.lower(F.regexp_extract(raw, SIZE, 2))]
    return F.when(raw.rlike(SIZE), (value.try_cast("double") * F.pow(F.lit(1024.0), power)).try_cast("long"))


#: A word, or part of one, that each signal can't do without (one of several), in the order of the signals.
STATUS_NEEDS = (
    ("status",), ("status",), ("status",), ("sold", "purchased", "buyer"), ("removed", "deleted", "taken", "withdrawn"), ("negotiat", "talks", "pending"),
    ("paid",), ("dump", "disclosed", "released", "published"), ("countdown", "deadline", "left", "expire"), ("leak",),
)


def resolve_status(texts: Column) -> Column:
    """The state that an array of phrases supports best; ``unknown`` without any.

    The text is folded to lower case once, and a signal's pattern is tried only where its word occurs.
    """
    # No pattern matches across a NUL. The four letters beyond ASCII that fold to ASCII ones count as those.
    joined = F.lower(F.translate(F.array_join(F.coalesce(texts, F.array().cast("array<string>")), "\x00"), "\u017f\u212a\u0130\u0131", "skii"))
    scores = {s: F.lit(0) for s in STATUS_PRECEDENCE}
    for (pattern, status, weight), needs in zip(STATUS_SIGNALS, STATUS_NEEDS):
        there = reduce(lambda a, b: a | b, [F.contains(joined, F.lit(w)) for w in needs])
        scores[status] = scores[status] + F.when(there, F.regexp_count(joined, F.lit(pattern)) * weight).otherwise(0)
    # With no score at all, the last one wins.
    ranked = [*(F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(s).alias("status")) for i, (s, score) in enumerate(scores.items())), F.struct(F.lit(0).alias("score"), F.lit(1).alias("order"), F.lit("unknown").alias("status"))]
    return F.array_max(F.array(*ranked))["status"]


def alternation(terms: list[str]) -> str:
    """One whole-word pattern over all terms; of those that fit, the longest wins.

    The terms are laid out as a tree of their characters: where none begins, that shows at the first one."""
    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}

    def branches(node: dict) -> str:
        parts = [re.sub(r"([^\w\s])", r"\\\1", c) + branches(rest) for c, rest in sorted(node.items()) if c]
        return (f"(?:{'|'.join(parts)})" + ("?" if "" in node else "")) if parts else ""

    return rf"\b({branches(root)})\b"


#: A table of at most so many codes may be broadcast.
MOST = 10_000


@dataclass
class Gazetteer:
    """Names of countries (alias -> name), country codes (code -> name), codes sold to anyone, and
    sector words (word -> sector). Keys are in lower case. Other tables are given by the caller."""

    names: dict[str, str] = field(default_factory=dict)
    codes: dict[str, str] = field(default_factory=dict)
    generic: frozenset[str] = frozenset()
    sectors: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def _map(table: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map().cast("map<string,string>")

    def country_pattern(self) -> str:
        return "(?iu)" + alternation(list(self.names))

    def sector_pattern(self) -> str:
        return "(?iu)" + alternation(list(self.sectors))

    def parse_country(self, raw: Column) -> Column:
        """A whole alias, else the first alias within the text."""
        text, table = F.lower(stripped(raw)), self._map(self.names)
        return F.coalesce(F.try_element_at(table, text), F.try_element_at(table, F.regexp_extract(text, self.country_pattern(), 1)))

    def is_country(self, text: Column) -> Column:
        return F.coalesce(F.map_contains_key(self._map(self.names), F.btrim(F.lower(stripped(text)), F.lit(".,"))), F.lit(False))

    def code_of(self, domain: Column) -> Column:
        """The last part of a domain of several, if it isn't sold to anyone."""
        labels = F.split(F.rtrim(F.lower(stripped(domain)), F.lit(".")), r"\.")
        code = F.element_at(labels, -1)
        return F.when((F.size(labels) >= 2) & ~code.isin(*(self.generic or [""])), code)

    def code_table(self, spark: SparkSession) -> DataFrame:
        """_code and _code_country of each country code; broadcast if there are at most ``MOST``."""
        table = spark.createDataFrame(list(self.codes.items()), "_code string, _code_country string")
        return F.broadcast(table) if len(self.codes) <= MOST else table

    def country_of_domain(self, domain: Column) -> Column:
        return F.try_element_at(self._map(self.codes), self.code_of(domain))

    def resolve_country(self, texts: Column, domain: Column) -> Column:
        """The first text that names a country, else the domain's."""
        named = F.filter(F.transform(texts, self.parse_country), lambda c: c.isNotNull())
        return F.coalesce(F.get(named, F.lit(0)), self.country_of_domain(domain))

    def resolve_sector(self, texts: Column) -> Column:
        """The sector with the most words in the texts; ties go to the first by name."""
        joined = F.array_join(texts, "\x00")
        table = self._map(self.sectors)
        hits = F.transform(F.regexp_extract_all(joined, F.lit(self.sector_pattern()), F.lit(1)), lambda w: F.try_element_at(table, F.lower(w)))
        counted = F.transform(F.array_sort(F.array_distinct(hits)), lambda s: F.struct((-F.size(F.filter(hits, lambda h: h == s))).alias("n"), s.alias("sector")))
        return F.array_min(counted)["sector"]


#: The whole tables of ``places``, and country codes that are sold to anyone.
DEFAULT = Gazetteer(
    names={alias: name for name, aliases in ALIASES.items() for alias in (name.lower(), *aliases)},
    codes=CODES,
    generic=frozenset({
        "io", "co", "ai", "me", "tv", "cc", "ly", "sh", "gg", "im", "to", "fm", "am", "st", "ws", "la", "gl", "tk", "ml", "ga", "cf", "nu", "vc", "ag", "as", "bz",
    }),
    sectors={word: sector for sector, words in SECTORS.items() for word in words},
)



#: Answers after which a fetch is tried again, and units of time with their seconds.
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)
UNITS = (("year", 31_536_000), ("month", 2_592_000), ("day", 86_400), ("hour", 3_600), ("minute", 60))


def relative(moment: Column, now: Column) -> Column:
    """How far a moment is from now, as amount and unit: the largest unit that it fills, halves rounded up."""
    seconds = F.floor((F.unix_micros(moment) - F.unix_micros(now)) / 1e6 + 0.5)
    out = F.struct(seconds.alias("amount"), F.lit("second").alias("unit"))
    for unit, size in reversed(UNITS):
        out = F.when(F.abs(seconds) >= size, F.struct(F.floor(seconds / size + 0.5).alias("amount"), F.lit(unit).alias("unit"))).otherwise(out)
    return F.when(moment.isNotNull(), out)


def freshness(last: Column, now: Column) -> Column:
    """Never or over 6 hours ago: critical; over 2 hours: warning; else good."""
    hours = (F.unix_micros(now) - F.unix_micros(last)) / 3.6e9
    return F.when(last.isNull() | (hours > 6), "critical").when(hours > 2, "warning").otherwise("good")
