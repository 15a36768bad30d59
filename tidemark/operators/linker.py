"""From spans to records: attributes find their victim, and a victim's attributes make a record.

``read`` does so page by page in the pass that finds the spans: what goes on is a row a record, and nothing is exchanged.
``link`` is for spans whose rows lie anywhere: owners by windows, records by grouping. Both end in the same columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.batches import groups

from ..functions.text import BLANK, clean_domain, dedupe_hash, extract_domain, group_slug, none_if_empty, stripped
from ..functions.values import DEFAULT, Gazetteer, parse_date, parse_size, resolve_status
from .spans import finder, settled, teller, with_hits

#: Words that are parts of company names, never a name.
NAME_FRAGMENTS = (
    "inc", "llc", "ltd", "limited", "gmbh", "sa", "sas", "bv", "nv", "ab", "ag", "corp", "corporation", "group", "holdings", "industries", "technologies",
    "solutions", "systems", "services", "partners", "associates", "manufacturing", "logistics", "health", "medical", "financial", "bank",
    "confidential", "documentation", "documents", "personal", "internal", "customer", "employee", "database", "backup", "archive", "sample", "samples", "proof", "part",
)


def only_fragments(name: Column) -> Column:
    words = F.split(stripped(name), r"\s+")
    return (stripped(name) != "") & F.forall(words, lambda w: F.btrim(F.lower(w), F.lit(".,")).isin(*NAME_FRAGMENTS))


def owners(spans: DataFrame) -> DataFrame:
    """Add ``record``: the number of the page's victim, from 1, that a span belongs to.

    Attributes belong to the last victim before them, those before the first victim to the
    first. An address belongs to the nearest victim; at equal distance the one behind it wins.
    Pages without a victim have one record, 1.
    """
    page = Window.partitionBy("page_id")
    past = page.orderBy("start", "end", "seq").rowsBetween(Window.unboundedPreceding, 0)
    # What comes next is what came last when a page is read from its end: running frames only.
    ahead = page.orderBy(F.desc("start"), F.desc("end"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    victim = F.col("label") == "victim_org"
    place = F.when(victim, F.struct(F.col("_n").alias("n"), "start", "end"))
    numbered = spans.withColumn("_n", F.sum(victim.cast("int")).over(past))
    # Spans of equal start and end are read in order, so the one before may also touch.
    around = numbered.withColumns({"_before": F.last(place, True).over(past), "_after": F.last(place, True).over(ahead)})
    before, after = F.col("_before"), F.col("_after")
    gap = lambda v: F.greatest(F.col("start") - v["end"], v["start"] - F.col("end"), F.lit(0))
    takes_after = after.isNotNull() & (before.isNull() | (gap(after) < gap(before)) | ((gap(after) == gap(before)) & (after["start"] > F.col("end"))))
    nearest = F.when(takes_after, after["n"]).otherwise(before["n"])
    record = F.when(F.col("label") == "victim_url", F.coalesce(nearest, F.lit(1))).otherwise(F.greatest("_n", F.lit(1)))
    return around.withColumn("record", record.cast("int")).drop("_n", "_before", "_after")


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is worked out once a row, though filters and several columns use it: a generator
    is not copied into them as an expression would be."""
    return rows.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def most_frequent(hits: Column) -> Column:
    """The value that an array has most often; ties go to the first in order."""
    counted = F.transform(F.array_distinct(hits), lambda s: F.struct((-F.size(F.filter(hits, lambda h: h == s))).alias("n"), s.alias("value")))
    return F.array_min(counted)["value"]


def link(spans: DataFrame, pages: DataFrame, places: Gazetteer = DEFAULT) -> DataFrame:
    """One row for each usable record of ``spans``; ``pages`` has page_id, source_group, source_url.

    What the places' tables have for a span comes with it (``hits``; looked up here for spans without that column);
    the country of a domain's last part is an equal join."""
    spans = spans.where(stripped(F.col("text")) != "").withColumn("text", stripped(F.col("text")))
    spans = spans if "hits" in spans.columns else with_hits(spans, places)
    order = F.struct("start", "end", "seq")
    # The page's last word on its crew goes to all of its records.
    crew = F.max(F.when(F.col("label") == "ransomware_group", F.struct("start", "end", "seq", "text"))).over(Window.partitionBy("page_id"))
    owned = owners(spans).withColumn("crew", crew["text"])
    first = lambda label: F.min_by(F.when(F.col("label") == label, F.col("text")), F.when(F.col("label") == label, order)).alias(label)
    every = lambda label: F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == label, F.struct("start", "end", "seq", "text")))), lambda s: s["text"]).alias(label)
    attribute = ~F.col("label").isin("victim_org", "ransomware_group")
    org = F.when(F.col("label") == "victim_org", order)
    placed = F.when((F.col("label") == "location") & (F.size("hits") > 0), order)
    grouped = owned.groupBy("page_id", "record").agg(
        first("victim_org"), first("victim_url"), first("date"), first("leak_size"), every("status"),
        F.min_by(F.get("hits", F.lit(0)), placed).alias("_country"), F.min_by("hits", org).alias("_name_hits"), F.flatten(F.collect_list(F.when(F.col("label") == "sector", F.col("hits")))).alias("_sector_hits"),
        F.avg(F.when(attribute, F.col("confidence"))).alias("confidence"), F.count_if(F.col("label") == "victim_org").alias("victims"), F.first("crew", True).alias("crew"),
    )
    return _finished(grouped.join(pages.select("page_id", "source_group", "source_url"), "page_id"), places)


#: What ``gathered`` has for each record, in this order.
GATHERED = "record int, victim_org string, victim_url string, date string, leak_size string, status array<string>, _country string, _name_hits array<string>, _sector_hits array<string>, confidence double, victims int, crew string"


def gathered(spans: list[tuple]) -> Iterator[tuple]:
    """The records of one page's spans (label, text, start, end, confidence, seq, hits): ``owners`` and the grouping of ``link``."""
    spans = sorted(((s[0], text, *s[2:]) for s in spans if (text := s[1].strip(BLANK))), key=lambda s: (s[2], s[3], s[5]))
    victims = [(s[2], s[3]) for s in spans if s[0] == "victim_org"]
    crew = next((s[1] for s in reversed(spans) if s[0] == "ransomware_group"), None)
    records: dict[int, list[tuple]] = {}
    n = 0
    for s in spans:
        label, _, start, end, *_ = s
        n += label == "victim_org"
        owner = max(n, 1)
        if label == "victim_url" and n < len(victims):
            after = victims[n]
            gap = lambda v: max(start - v[1], v[0] - end, 0)  # noqa: B023, E731
            ahead, back = gap(after), gap(victims[n - 1]) if n else None
            if back is None or ahead < back or ahead == back and after[0] > end:
                owner = n + 1
        records.setdefault(owner, []).append(s)
    for record, own in records.items():
        by: dict[str, list[tuple]] = {}
        for s in own:
            by.setdefault(s[0], []).append(s)
        first = [by[label][0][1] if label in by else None for label in ("victim_org", "victim_url", "date", "leak_size")]
        country = next((s[6][0] for s in by.get("location", ()) if s[6]), None)
        orgs, sure = by.get("victim_org", []), [s[4] for s in own if s[0] not in ("victim_org", "ransomware_group")]
        yield (
            record, *first, [s[1] for s in by.get("status", ())], country, orgs[0][6] if orgs else None, [h for s in by.get("sector", ()) for h in s[6]],
            sum(sure) / len(sure) if sure else None, len(orgs), crew,
        )


def read(pages: DataFrame, places: Gazetteer = DEFAULT) -> DataFrame:
    """One row for each usable record of ``pages`` (page_id, text, source_group, source_url), in one pass: what ``link`` makes of
    the spans that ``extract`` finds, for pages that come once each."""
    kept = pages.select("page_id", "source_group", "source_url", "text")
    made = T.StructType.fromDDL(GATHERED).fields
    schema = T.StructType([*kept.schema.fields[:3], *made])
    kinds = [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, told = finder(places), teller(places)
        for batch in batches:
            for part, texts in groups(batch, "text"):
                rows = [(i, *r) for i, t in enumerate(texts) for r in gathered([(*s, told(s[0], s[1])) for s in settled(list(find(t)))])]
                if rows:
                    at, *columns = zip(*rows)
                    own = part.select(schema.names[:3]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    return _finished(kept.mapInArrow(run, schema), places)


def _finished(rows: DataFrame, places: Gazetteer) -> DataFrame:
    """The columns of records, of those that are usable."""
    rows = rows.where("victims > 0 or victim_url is not null or date is not null")
    domain = F.coalesce(extract_domain(F.col("victim_url")), extract_domain(F.col("victim_org")))
    name = F.when(F.col("victim_domain").isNotNull() & only_fragments(F.col("victim_org")), F.lit(None)).otherwise(F.col("victim_org"))
    rows = _once(_once(rows, "victim_domain", clean_domain(domain)), "victim_name", name)
    rows = rows.withColumn("actor_group", group_slug(F.coalesce("crew", "source_group")))
    usable = none_if_empty(F.col("victim_name")).isNotNull() | F.col("victim_domain").isNotNull()
    rows = rows.where(usable).withColumn("_code", places.code_of(F.col("victim_domain")))
    rows = rows.join(places.code_table(rows.sparkSession), "_code", "left")
    named = F.when(F.col("victim_name").isNotNull(), F.col("_name_hits")).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "page_id", "record", "victim_name", "victim_domain",
        F.coalesce("_country", "_code_country").alias("victim_country"),
        most_frequent(F.concat(F.coalesce(named, F.array().cast("array<string>")), "_sector_hits")).alias("victim_sector"),
        "actor_group", "source_url", parse_date(F.col("date")).alias("published_at"), F.col("date").alias("published_at_raw"),
        resolve_status(F.col("status")).alias("status"), parse_size(F.col("leak_size")).alias("leak_size_bytes"), "confidence",
        dedupe_hash(F.col("actor_group"), F.col("victim_domain"), F.col("victim_name")).alias("dedupe_hash"),
    )
