"""Readable text of HTML pages and of whole files, and onion addresses in text.

Tags need a parser with state, so each page is read by the standard library's within an Arrow
batch; everything after that is column expressions and windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import groups
from ..functions.text import none_if_empty, onion_host, stripped

#: Elements without listing text, and marks of elements that change by themselves.
DROPPED = ("script", "style", "noscript", "svg", "iframe", "head")
VOLATILE = (("class", "countdown"), ("class", "timer"), ("id", "countdown"), ("id", "timer"))
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Wording that announces an address as the site's own, and how an address looks.
ANNOUNCES = r"\b(mirror|mirrors|new\s+(?:address|domain|site|url)|backup|alternative|we\s+(?:have\s+)?moved|moved\s+to|our\s+(?:new\s+)?(?:site|address|domain)|official\s+(?:site|address|domain))\b"
ADDRESS = r"\b(?:(https?)://)?([a-z2-7]{56}\.onion)\b(/[^\s\"'<>)\]]*)?"
LOOKBACK = 3


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.open: list[tuple[str, bool]] = []

    def hidden(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            return
        if tag == "body":  # a head may lack its end
            self.open = [o for o in self.open if o[0] != "head"]
            self.open = [(t, False) for t, _ in self.open]
        gone = tag in DROPPED or bool(attrs) and any(k == a and mark in (v or "") for k, v in attrs for a, mark in VOLATILE)
        self.open.append((tag, gone or self.hidden()))

    def handle_endtag(self, tag: str) -> None:
        if self.open and self.open[-1][0] == tag:
            self.open.pop()
        elif any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.hidden() and (data := data.strip()):
            self.parts.append(data)


#: Tags that every parser reads alike: attributes without values or with quoted ones, no references in them.
_TAG = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z0-9_:-]*(?:=(?:\"[^\"<>&]*\"|'[^'<>&]*'))?)*)[ \t\n]*(/?)>|</([a-zA-Z][a-zA-Z0-9]*)>|<!(?i:doctype)[ \t\n][^<>]*>")
_ATTRIBUTE = re.compile(r"([a-zA-Z][a-zA-Z0-9_:-]*)(?:=(?:\"([^\"]*)\"|'([^']*)'))?")
#: Elements whose content some versions of the parser read otherwise.
_RAW = ("iframe", "math", "noembed", "noframes", "noscript", "plaintext", "svg", "textarea", "xmp")


def _read_plainly(html: str, to: _Text) -> bool:
    """Hand a page's tags and texts to ``to`` as its parser would, if they are all of the usual forms; whether they were."""
    at, inside = 0, ""
    while (k := html.find("<", at)) >= 0:
        if k > at:
            to.handle_data(unescape(html[at:k]))
        if html[k + 1 : k + 2] == "!" and html.startswith("<!--", k):
            at = html.find("--", k + 4) + 3
            if at < k + 8 or html[at - 1 : at] != ">" or html[k + 4] in ">-" or inside:
                return False
            continue
        m = _TAG.match(html, k)
        if m is None:
            return False
        name, attributes, closed, end = m.groups()
        at = m.end()
        if inside and end is None or end and inside not in ("", end.lower()):
            return False
        inside = ""
        if end:
            to.handle_endtag(end.lower())
        elif name:
            tag = name.lower()
            if tag in _RAW or closed and tag not in VOID:
                return False
            to.handle_starttag(tag, [(a.lower(), v or w or "") for a, v, w in _ATTRIBUTE.findall(attributes)] if attributes else [])
            if tag == "title":
                inside = tag
            elif tag in ("script", "style"):
                end = html.find("</", at)
                if end < 0 or "<!--" in html[at:end]:
                    return False
                at, inside = end, tag
    if inside:
        return False
    if at < len(html):
        to.handle_data(unescape(html[at:]))
    return True


def page_text(html: str | None) -> str:
    """The text nodes of a page outside dropped elements, a line each. Pages of the usual forms are read by two
    patterns, others by the parser; the result is the same."""
    html = html or ""
    reader = _Text()
    if not _read_plainly(html, reader):
        reader = _Text()
        reader.feed(html)
        reader.close()
    return "\n".join(reader.parts)


#: Fixed value: what ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def cleaned(text: Column) -> Column:
    """Printable characters alone, without box drawings and symbols; blank lines go."""
    lines = F.split(text, LINE_END)
    kept = F.transform(lines, lambda x: stripped(F.regexp_replace(x, r"[\p{C}\p{Z}─-⯿&&[^ ]]", "")))
    return F.array_join(F.filter(kept, lambda x: x != ""), "\n")


def texts(pages: DataFrame) -> DataFrame:
    """page_id and text of ``pages`` (page_id, html)."""
    schema = T.StructType([pages.schema["page_id"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sources in groups(batch, "html"):
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array([page_text(h) for h in sources], pa.string())], names=schema.names)

    return pages.select("page_id", "html").mapInArrow(run, schema).withColumn("text", cleaned(F.col("text")))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file, whole; bytes that aren't UTF-8 become the replacement character."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def addresses(pages: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """page_id, onion_host, url and announced: the first mention of each host on each page (page_id, text).

    An address is announced as the site's own by wording on its line, or on the nearest line above
    it that says anything of the kind: of the last ``LOOKBACK`` lines with text, not counting
    lines that are an address and nothing else, the nearest one with an address or such wording
    decides, and it must have the wording and no address. ``excluded`` has hosts (onion_host) that are left out.
    """
    address, says = f"(?i){ADDRESS}", F.col("line").rlike(f"(?i){ANNOUNCES}")
    lines = pages.where(F.contains(F.lower("text"), F.lit(".onion"))).select("page_id", F.posexplode(F.split("text", LINE_END)).alias("at", "line"))
    lines = lines.withColumn("line", stripped(F.col("line"))).where("line <> ''").withColumns({"says": says, "urls": F.regexp_extract_all("line", F.lit(address), F.lit(0))})
    alone = F.col("line").rlike(f"(?i)^(?:{ADDRESS})$")
    above = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # Lines that aren't an address alone are numbered; the last one above that decides, and its number.
    lines = lines.withColumn("counted", F.coalesce(F.sum((~alone).cast("int")).over(above), F.lit(0)))
    told = ~alone & (F.col("says") | (F.size("urls") > 0))
    lines = lines.withColumn("told", F.last(F.when(told, F.struct((F.col("counted") + 1).alias("number"), (F.size("urls") == 0).alias("own"))), True).over(above))
    heading = F.coalesce(F.col("told.own") & (F.col("counted") - F.col("told.number") < LOOKBACK), F.lit(False))
    found = lines.where(F.size("urls") > 0).select("page_id", "at", (F.col("says") | heading).alias("announced"), F.posexplode("urls").alias("nth", "raw"))
    part = lambda n: F.regexp_extract("raw", address, n)
    host = F.lower(part(2))
    found = found.withColumns({"onion_host": host, "url": F.concat(F.lower(F.coalesce(none_if_empty(part(1)), F.lit("http"))), F.lit("://"), host, part(3))})
    if excluded is not None:
        found = found.join(excluded.select(F.lower("onion_host").alias("onion_host")), "onion_host", "left_anti")
    first = F.min_by(F.struct("url", "announced"), F.struct("at", "nth"))
    return found.groupBy("page_id", "onion_host").agg(first.alias("f")).select("page_id", "onion_host", "f.url", "f.announced")


def known_hosts(sources: DataFrame, mirrors: DataFrame) -> DataFrame:
    """The hosts (onion_host) of all base and active addresses of sources and of all mirrors (url), once each."""
    urls = sources.select(F.col("base_url").alias("url")).unionByName(sources.select(F.col("active_url").alias("url"))).unionByName(mirrors.select("url"))
    return urls.select(onion_host(F.col("url")).alias("onion_host")).where("onion_host is not null").distinct()
