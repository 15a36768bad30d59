"""Stems of English words by the published rules of the second Porter stemmer, so that a word's forms find each other.

R1 is what comes behind the first consonant that follows a vowel, R2 the same within R1. Each step looks for
the longest of its endings; a rule says where the ending must lie, what must stand before it, and what takes its place.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Words that the rules don't apply to, before the first step and after the plural is off.
ODD = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
DONE = frozenset({"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"})
#: Endings of the second, third and fourth step and what takes their place.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = dict.fromkeys(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"), "")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_REGION = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_SHORT = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_PREFIX = re.compile("gener|commun|arsen")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 start."""
    known = _PREFIX.match(word)
    first = known or _REGION.search(word)
    r1 = first.end() if first else len(word)
    second = _REGION.search(word, r1)
    return r1, second.end() if second else len(word)


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has, else nothing."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _plural(w: str) -> str:
    end = _ending(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return w[:-2]
    if end in ("ied", "ies"):
        return w[:-2] if len(w) > 4 else w[:-1]
    return w[:-1] if end == "s" and _VOWEL.search(w[:-2]) else w


def _past(w: str, r1: int) -> str:
    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    if not end or not _VOWEL.search(w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(DOUBLES):
        return w[:-1]
    return w + "e" if len(w) <= r1 and _SHORT.search(w) else w


def _allowed(w: str, end: str, at: int, r2: int) -> bool:
    """Whether what stands before an ending lets it go."""
    before = w[:at]
    if end == "ogi":
        return before.endswith("l")
    if end == "li":
        return before.endswith(tuple("cdeghkmnrt"))
    if end == "ative":
        return at >= r2
    return end != "ion" or before.endswith(("s", "t"))


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if word in ODD:
        return ODD[word]
    if len(word) <= 2:
        return word
    w = re.sub("(?<=[aeiouy])y|^y", "Y", word.removeprefix("'"))
    r1, r2 = _regions(w)
    w = _plural(re.sub("'(?:s'?)?$", "", w))
    if w in DONE:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and not _VOWEL.match(w[-2]):
        w = w[:-1] + "i"
    for table, region in ((SECOND, r1), (THIRD, r1), (FOURTH, r2)):
        end = _ending(w, table)
        at = len(w) - len(end)
        if end and at >= region and _allowed(w, end, at, r2):
            w = w[:at] + table[end]
    if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not _SHORT.search(w[:-1])) or w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")
