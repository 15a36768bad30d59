"""Column functions for identities, domains, addresses, display and search. All but the stems of search stay in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stems import stem

#: Hosts that are never a victim's, nor are their subdomains.
DENIED_DOMAINS = (
    "onion", "tor", "torproject.org", "protonmail.com", "proton.me", "tutanota.com",
    "telegram.org", "t.me", "qtox.github.io", "session.org", "bitcoin.org", "example.com",
)
#: Fixed value: how a domain looks.
DOMAIN = r"\b((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,})\b"
#: Fixed value: how a version-3 onion host looks.
ONION = r"(?i)\b([a-z2-7]{56}\.onion)\b"
BLANK = " \t\n\r\f\x0b"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def group_slug(group: Column) -> Column:
    return F.replace(F.lower(stripped(group)), F.lit(" "), F.lit("-"))


def clean_domain(domain: Column) -> Column:
    """Host of a decorated address, in lower case; null if nothing is left."""
    out = F.lower(stripped(domain))
    for prefix in ("https://", "http://", r"www\."):
        out = F.regexp_replace(out, f"^{prefix}", "")
    return none_if_empty(F.rtrim(F.split(out, "/")[0], F.lit(".")))


def dedupe_hash(group: Column, domain: Column, name: Column) -> Column:
    """Identity of a record: its group and its victim, the domain before the name."""
    victim = F.coalesce(none_if_empty(domain), none_if_empty(name), F.lit(""))
    return F.sha2(F.concat_ws("|", group, F.lower(stripped(victim))), 256)


def is_denied(domain: Column) -> Column:
    out = domain.isin(*DENIED_DOMAINS)
    for d in DENIED_DOMAINS:
        out = out | F.endswith(domain, F.lit(f".{d}"))
    return out


def extract_domain(text: Column) -> Column:
    """The first domain in a text that isn't denied, without a leading www."""
    found = F.regexp_extract_all(text, F.lit(f"(?i){DOMAIN}"), F.lit(1))
    hosts = F.transform(found, lambda d: F.regexp_replace(F.rtrim(F.lower(d), F.lit(".")), r"^www\.", ""))
    return F.get(F.filter(hosts, lambda d: ~is_denied(d)), F.lit(0))


def onion_host(url: Column) -> Column:
    return none_if_empty(F.lower(F.regexp_extract(url, ONION, 1)))


def page_url(base: Column, page: Column, style: Column) -> Column:
    """Address of a listing's page; null where the style has no such page. 25 rows to an offset."""
    joint = F.when(F.contains(base, F.lit("?")), "&").otherwise("?")
    return (
        F.when(page == 1, base)
        .when(style == "query", F.concat(base, joint, F.lit("page="), page.cast("string")))
        .when(style == "path", F.concat(F.rtrim(base, F.lit("/")), F.lit("/page/"), page.cast("string")))
        .when(style == "offset", F.concat(base, joint, F.lit("offset="), ((page - 1) * 25).cast("string")))
    )


def crawl_url(active: Column, base: Column) -> Column:
    return F.coalesce(none_if_empty(active), base)


def format_bytes(size: Column) -> Column:
    """A size in binary units; one decimal under 10; a dash for none or zero."""
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    step = F.least(F.floor(F.log2(size.cast("double")) / 10).cast("int"), F.lit(len(units) - 1))
    value = size / F.pow(F.lit(1024.0), step)
    shown = F.when((value < 10) & (step > 0), F.format_string("%.1f", value)).otherwise(F.format_string("%.0f", value))
    return F.when(size.isNull() | (size <= 0), F.lit("—")).otherwise(F.concat_ws(" ", shown, F.element_at(F.array(*map(F.lit, units)), step + 1)))


#: Words that searches pass over, as English text search does. Fixed values.
STOP = (
    "i", "me", "my", "we", "our", "you", "your", "he", "him", "his", "she", "her", "it", "its", "they", "them", "their", "what", "which", "who", "this", "that", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while",
    "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such",
    "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "can", "will", "just", "should", "now",
)
def words(text: Column) -> Column:
    """The distinct runs of lower-case letters and digits, without stop words."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.array_except(tokens, F.array(*map(F.lit, STOP)))


def terms_of(words_: list[str] | None) -> list[str]:
    """The stems of words, in their order."""
    return [] if words_ is None else [stem(w) for w in words_]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(found: pd.Series) -> pd.Series:
    return found.map(terms_of)


def matches(name: Column, domain: Column, query: Column) -> Column:
    """Whether all terms of a query are in a record's name or domain; a query without terms matches nothing.

    A domain is found whole and, like a name, by its parts. For a record at a time; ``operators.search`` keeps an index.
    """
    asked, text = _stems(words(query)), _stems(words(F.concat_ws(" ", name, domain)))
    return (F.size(asked) > 0) & (F.size(F.array_except(asked, text)) == 0)
