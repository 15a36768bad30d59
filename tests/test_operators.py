"""Scalar cases, extraction, linking and maintenance on small tables."""

import datetime as dt
import hashlib
import random
import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions import places, stems, values
from tidemark.functions import text as fx
from tidemark.operators import alerts, linker, maintain, search, spans
from tidemark.operators.committed import Table
from tidemark.plans import api
from tidemark.sources import html
from tidemark.streaming import job


def apply(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_dates(spark):
    day = ["2026-02-10", "10 Feb 2026", "10 Feb, 2026", "Feb 10, 2026", "February 10, 2026", "10.02.2026", "10/02/2026", "Published: 2026-02-10", "[2026-02-10]", "2026/02/10"]
    assert apply(spark, values.parse_date, day) == [dt.datetime(2026, 2, 10)] * len(day)
    assert apply(spark, values.parse_date, ["2026-02-10 14:30:00", "2026-02-10 14:30 (UTC)", "2026-02-10T14:30+05:00"]) == [dt.datetime(2026, 2, 10, 14, 30)] * 3
    assert apply(spark, values.parse_date, ["03/04/2026", "02/13/2026", "31/02/2026"]) == [dt.datetime(2026, 4, 3), dt.datetime(2026, 2, 13), None]
    assert apply(spark, values.parse_date, [None, "", " ", "sometime last week", "n/a", "TBA"]) == [None] * 6


def test_sizes(spark):
    k = 1024
    assert apply(spark, values.parse_size, ["1.2 TB", "500 GB", "500GB", "2 TiB", "750 MB", "1,5 GB", "Size: 340 GB of data", "10 k"]) == [1319413953331, 500 * k**3, 500 * k**3, 2 * k**4, 750 * k**2, int(1.5 * k**3), 340 * k**3, 10 * k]
    assert apply(spark, values.parse_size, [None, "", "unknown", "lots of files", "12 p"]) == [None] * 5
    assert apply(spark, fx.format_bytes, [None, 0, 5, 1536, 20 * k**3], "long") == ["—", "—", "5 B", "1.5 KB", "20 GB"]


def test_status(spark):
    cases = {"Data published": "published", "FULL DUMP RELEASED": "published", "countdown: 3 days left": "countdown", "Time left: 14:22:01": "countdown", "Sold to a private buyer": "sold", "Files removed after payment": "removed", "Negotiations ongoing": "negotiating", "ransom paid": "negotiating", "": "unknown", "a plain sentence": "unknown"}
    assert apply(spark, lambda c: values.resolve_status(F.array(c)), list(cases)) == list(cases.values())
    lists = [["Status: published", "the buyer found the data useful"], ["LEAKED", "sold", "sold to a private buyer"], ["published", "sold"], [None, "", "plain"], ["in", "talks"], None]
    assert apply(spark, values.resolve_status, lists, "array<string>") == ["published", "sold", "sold", "unknown", "unknown", "unknown"]


def test_domains_and_hashes(spark):
    assert apply(spark, fx.extract_domain, ["see acme.test now", "https://www.acme.test/x", "a@acme.co.uk", "x.onion and protonmail.com, then sub.example.com, b.test", "none here", None]) == ["acme.test", "acme.test", "acme.co.uk", "b.test", None, None]
    assert apply(spark, fx.clean_domain, [" HTTPS://www.Acme.test./path", "", None]) == ["acme.test", None, None]
    host = "a" * 56 + ".onion"
    assert apply(spark, fx.onion_host, [f"HTTP://{host.upper()}/x", "a" * 16 + ".onion", None]) == [host, None, None]
    h = hashlib.sha256(b"lockbit|acme.test").hexdigest()
    assert apply(spark, lambda c: fx.dedupe_hash(F.lit("lockbit"), c, F.lit("Acme")), [" ACME.test "]) == [h]
    assert apply(spark, lambda c: fx.dedupe_hash(F.lit("g"), c, F.lit(" Acme ")), [None, ""]) == [hashlib.sha256(b"g|acme").hexdigest()] * 2
    assert apply(spark, fx.group_slug, [" LockBit 3.0 "]) == ["lockbit-3.0"]


def test_places(spark):
    g = values.DEFAULT
    assert apply(spark, g.parse_country, ["Germany", " deutschland ", "based in Germany", "u.s.", "nowhere", None]) == ["Germany", "Germany", "Germany", "United States", None, None]
    assert apply(spark, g.country_of_domain, ["a.de", "a.co.uk", "a.com.au", "a.io", "a.co", "de", None]) == ["Germany", "United Kingdom", "Australia", None, None, None, None]
    assert apply(spark, lambda c: g.resolve_sector(F.array(c)), ["Unified School District", "Freight & Haulage", "a bank, a bank and a hotel", "hotel or bank", "nothing"]) == ["Education", "Transportation & Logistics", "Financial Services", "Financial Services", None]


def test_whole_gazetteer(spark):
    """Expected values are written out here; none is taken from the tables."""
    g = values.DEFAULT
    assert (len(set(g.names.values())), len(places.ALIASES), sum(map(len, places.ALIASES.values())), len(g.codes), len(set(g.sectors.values())), len(g.sectors)) == (113, 113, 250, 110, 25, 279)
    names = {"Australia": "Australia", "offices in the Netherlands": "Netherlands", "SWISS": "Switzerland", "Scotland": "United Kingdom", "u.a.e.": "United Arab Emirates", "Côte d'Ivoire": "Ivory Coast", "Turkey": "Turkey", "Chad": None, "Georgia": None, "NATION_2": None}
    assert apply(spark, g.parse_country, list(names)) == list(names.values())
    assert apply(spark, g.is_country, ["New Zealand.", "cote d'ivoire", "Acme"]) == [True, True, False]
    hosts = {"a.be": "Belgium", "a.dk": "Denmark", "a.co.nz": "New Zealand", "a.na": "Namibia", "a.cy": "Cyprus", "a.am": None, "a.me": None}
    assert apply(spark, g.country_of_domain, list(hosts)) == list(hosts.values())
    words = {"orthopaedic ward": "Healthcare", "Acme Biotech": "Pharmaceuticals", "law firm": "Legal", "avionics": "Aerospace & Defense", "steel foundry": "Manufacturing", "a brewery": "Food & Beverage", "NGO": "Non-profit", "port authority": "Transportation & Logistics", "automobile": None, "building": None, "machinery": None, "furniture": None, "household": None}
    assert apply(spark, lambda c: g.resolve_sector(F.array(c)), list(words)) == list(words.values())
    r, plain = random.Random(5), lambda terms: r"(?i)\b(" + "|".join(map(re.escape, sorted(terms, key=len, reverse=True))) + r")\b"
    for terms, pattern in ((list(g.names), g.country_pattern()), (list(g.sectors), g.sector_pattern())):
        texts = ["".join(r.choice([str.upper, str])(r.choice(terms)) + r.choice([" ", "", ", ", "x", ".", "é", "s "]) for _ in range(60)) for _ in range(20)]
        want = [[(m.group(), m.start()) for m in re.finditer(plain(terms), t)] for t in texts]
        assert [[w for w, _ in f] for f in want] == apply(spark, lambda c, p=pattern: F.regexp_extract_all(c, F.lit(p), F.lit(0)), texts)
        assert [[(m.group(), m.start()) for m in re.finditer(pattern, t)] for t in texts] == want
    page = "Northgate Logistics\nhttps://northgate.test/\nBased in Switzerland, a brewery"
    found = spans.extract(spark.createDataFrame([(1, page)], "page_id long, text string")).where("label in ('location', 'sector')").orderBy("start").collect()
    assert [(s.label, s.text) for s in found] == [("sector", "Logistics"), ("location", "Switzerland"), ("sector", "brewery")]


def test_page_urls(spark):
    base = "http://x.test/?a=1"
    url = lambda style, n: apply(spark, lambda c: fx.page_url(F.lit(base), F.lit(n), c), [style])[0]
    assert [url(s, 3) for s in ("none", "query", "path", "offset")] == [None, base + "&page=3", base + "/page/3", base + "&offset=50"]
    assert url("none", 1) == base


def plain_spans(text):
    """Spans of a text by trying everything against everything."""
    g, low = values.DEFAULT, lambda m: m.group().lower()
    hits = lambda p: list(re.finditer(p, text))
    out = [("date", m.group(), *m.span()) for p in spans.DATES for m in hits(p)] + [("leak_size", m.group(), *m.span()) for m in hits(spans.SIZE)] + [("status", m.group(), *m.span()) for m in hits(spans.STATUS)]
    out += [("victim_url", m.group(), *m.span()) for m in hits(f"(?i){fx.DOMAIN}") if not any(low(m) == d or low(m).endswith("." + d) for d in fx.DENIED_DOMAINS)]
    for m in hits(spans.ORG):
        name = m.group().strip(" \t\n\r\f\x0b")
        legal = re.search(spans.ORG_SUFFIX, name)
        shouted = name == name.upper() and name != name.lower() and not legal
        odd = any(w.strip(".,").lower() in spans.NOT_AN_ORG for w in name.split()) or name.lower().strip(".,") in g.names
        if len(name) > 2 and (legal or " " in name) and not shouted and not odd and (legal or re.search(f"(?i){fx.DOMAIN}", text[max(m.start() - 120, 0) : m.end() + 120])):
            out.append(("victim_org", name, *m.span()))
    anchors = [(s, e) for label, _, s, e in out if label.startswith("victim")]
    for label, p in (("location", g.country_pattern()), ("sector", g.sector_pattern())):
        out += [(label, m.group(), *m.span()) for m in hits(p) if any(m.start() - e <= 250 and s - m.end() <= 250 for s, e in anchors)]
    order = {o: i for i, o in enumerate(out)}
    key = lambda o: (o[2], o[3], order[o])
    return sorted(o for o in out if not any(p[0] == o[0] and key(p) < key(o) and p[3] >= o[3] for p in out))


def extracted(spark, texts):
    rows = spans.extract(spark.createDataFrame(list(enumerate(texts)), "page_id long, text string")).collect()
    return [sorted((r.label, r.text, r.start, r.end) for r in rows if r.page_id == i) for i in range(len(texts))]


def test_extraction_against_plain(spark, sf):
    """Random mixtures of what spans are made of, and whole documents and pages of the tables."""
    r = random.Random(4)
    parts = ["10 Feb 2026", "2026-02-10 14:30", "1.2 TB", "status: sold", "www.acme.test", "Acme Holdings Ltd", "Blue Harbor Foods", "é中", "\n", " and ", "days left", "03/04/2026,", "Germany", "a brewery", "LEAKED DATA", "protonmail.com", "filler " * 40, "Download Page"]
    texts = ["".join(r.choice(parts) + r.choice([" ", "\n", ""]) for _ in range(30)) for _ in range(60)]
    texts += [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [x.text for x in html.texts(spark.read.parquet(f"{sf}/pages.parquet")).collect()] + ["", "x" * 10000]
    found, want = extracted(spark, texts), [plain_spans(t or "") for t in texts]
    assert found == want and sum(map(len, want)) > 500 and {o[0] for w in want for o in w} == {"date", "leak_size", "status", "victim_url", "victim_org", "location", "sector"}


def test_extraction_plan(spark):
    """The texts are passed over once and the spans exchanged once."""
    pages = spark.range(10).selectExpr("id as page_id", "cast(id as string) as text", "'g' as source_group", "'u' as source_url")
    plan = linker.link(spans.extract(pages), pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Generate explode") == 0
    assert "portugal" not in plan.lower() and "brewery" not in plan.lower()  # no table of places is in the plan: values come with their spans
    assert plan.count("Exchange hashpartitioning(page_id") <= 2  # spans; and the pages' groups and addresses


def test_extractors(spark):
    assert spans.extractor("rules") is spans.extract
    with pytest.raises(ValueError, match="rules"):
        spans.extractor("model")


def test_states_at_length(spark):
    """Long texts, folded letters, and signals that only hold at word borders."""
    texts = ["unsold resold", "ſold", "x" * 5000 + " SOLD", "leak" * 500, "İn talks", "PAID İ", "days  left", "status : leaked sold"]
    assert apply(spark, lambda c: values.resolve_status(F.array(c)), texts) == ["unknown", "sold", "sold", "unknown", "negotiating", "negotiating", "countdown", "published"]


PAGE = """Recent entries of this board

www.harborlight.test   entry 1 of 3
Harborlight Foods Ltd, a brewery in Portugal
2026/03/05 is not a date that the patterns know, 2026-03-05 is
volume 750 GB; status: sold

Quarrystone Partners (quarry-stone.test)
offered since 7 Jun 2026, deadline near
12,5 GB so far
Norway

entry 3 of 3: Meridian Clinic Group of Chile (meridian-clinic.test)
April 9, 2026, 3 TB, withdrawn
write to staff@tutanota.com
"""


def test_extraction(spark):
    pages = spark.createDataFrame([(1, PAGE, "Night Crew", "u"), (2, "", "g", "u"), (3, None, "g", "u"), (4, "x" * 10000, "g", "u")], "page_id long, text string, source_group string, source_url string")
    rows = {r.record: r for r in linker.link(spans.extract(pages), pages).collect()}
    get = lambda c: [rows[i][c] for i in sorted(rows)]
    assert get("victim_name") == ["Harborlight Foods Ltd", "Quarrystone Partners", "Meridian Clinic Group"]
    assert get("victim_domain") == ["harborlight.test", "quarry-stone.test", "meridian-clinic.test"]
    assert get("status") == ["sold", "countdown", "removed"]
    assert get("leak_size_bytes") == [750 * 1024**3, int(12.5 * 1024**3), 3 * 1024**4]
    assert get("published_at") == [dt.datetime(2026, 3, 5), dt.datetime(2026, 6, 7), dt.datetime(2026, 4, 9)]
    assert get("victim_country") == ["Portugal", "Norway", "Chile"] and rows[1].victim_sector == "Food & Beverage"
    assert {r.actor_group for r in rows.values()} == {"night-crew"} and len({r.dedupe_hash for r in rows.values()}) == 3


def test_hits():
    told = spans.teller()
    assert told("location", " gerMany\t") == ["Germany"] and told("location", "in Norway now") == ["Norway"]
    assert told("location", "GERMANY") == ["Germany"] and told("location", "nowhere") == [] and told("date", "Germany") == []
    word, sector = next(iter(values.DEFAULT.sectors.items()))
    assert told("victim_org", f"The {word.title()} and {word} Group") == [sector, sector] and told("sector", word.upper()) == [sector]


def test_hits_of_given_spans(spark):
    """Spans with their hits and without give the same records, and those of the column functions."""
    g, r = values.DEFAULT, random.Random(6)
    names, sectors = sorted(g.names), sorted(g.sectors)
    rows = []
    for page in range(80):
        rows += [(page, "victim_org", f"{r.choice(sectors).title()} Works Ltd", 0, 10, 0.5, 0), (page, "victim_url", f"x.{r.choice(sorted(g.codes))}", 12, 20, 0.5, 1)]
        rows += [(page, "location", r.choice([*names[:40], "nowhere"]), 30 + k, 31 + k, 0.5, 10 + k) for k in range(r.randint(0, 2))]
        rows += [(page, "sector", r.choice(sectors), 50 + k, 51 + k, 0.5, 20 + k) for k in range(r.randint(0, 3))]
    df = spark.createDataFrame(rows, "page_id long, label string, text string, start int, end int, confidence double, seq int")
    pages = df.select("page_id", F.lit("src").alias("source_group"), F.lit("u").alias("source_url")).distinct()
    found = {x.page_id: (x.victim_country, x.victim_sector) for x in linker.link(df, pages).collect()}
    assert found == {x.page_id: (x.victim_country, x.victim_sector) for x in linker.link(spans.with_hits(df), pages).collect()}
    listed = lambda label: F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == label, F.struct("start", "text")))), lambda s: s["text"])
    told = df.groupBy("page_id").agg(listed("victim_org").alias("o"), listed("victim_url").alias("u"), listed("location").alias("l"), listed("sector").alias("s"))
    told = told.select("page_id", g.resolve_country(F.col("l"), F.get("u", F.lit(0))).alias("c"), g.resolve_sector(F.concat("o", "s")).alias("s"))
    assert found == {x.page_id: (x.c, x.s) for x in told.collect()} and len({c for c, _ in found.values()}) > 20


def linked(spark, *rows):
    df = spark.createDataFrame([(1, *r, 0.5, i) for i, r in enumerate(rows)], "page_id long, label string, text string, start int, end int, confidence double, seq int")
    pages = spark.createDataFrame([(1, "src", "u")], "page_id long, source_group string, source_url string")
    return sorted(linker.link(df, pages).collect(), key=lambda r: r.record)


def test_linker(spark):
    v, u, d = "victim_org", "victim_url", "date"
    two = linked(spark, (u, "a.test", 0, 6), (v, "A Co", 7, 11), (u, "b.test", 12, 18), (v, "B Co", 19, 23))
    assert [(r.victim_name, r.victim_domain) for r in two] == [("A Co", "a.test"), ("B Co", "b.test")]
    (one,) = linked(spark, (d, "2026-02-10", 0, 10), (v, "A Co", 20, 24), (d, "2026-02-11", 30, 40))
    assert one.published_at_raw == "2026-02-10"
    (bare,) = linked(spark, (u, "a.test", 0, 6), ("status", "sold", 8, 12))
    assert (bare.victim_name, bare.victim_domain, bare.status) == (None, "a.test", "sold")
    (blank,) = linked(spark, (v, "Ltd", 0, 3), (u, "acme.test", 4, 13))
    assert (blank.victim_name, blank.victim_domain) == (None, "acme.test")
    assert linked(spark, ("leak_size", "1 GB", 0, 4)) == []
    group = linked(spark, ("ransomware_group", "LockBit 3.0", 0, 10), (v, "A Co", 20, 24))
    assert group[0].actor_group == "lockbit-3.0" and group[0].confidence is None
    tie = linked(spark, (v, "A Co", 0, 4), (u, "x.test", 6, 12), (v, "B Co", 14, 18))
    assert [(r.victim_name, r.victim_domain) for r in tie] == [("A Co", None), ("B Co", "x.test")]


def plain_upsert(state, batch, now):
    for r in batch:
        old = state.get(r["key"])
        if old is None:
            state[r["key"]] = {"name": r["name"], "status": r["status"], "group": r["group"], "first": now, "last": now}
        else:
            old.update(name=r["name"] if r["name"] is not None else old["name"], status=old["status"] if r["status"] == "unknown" else r["status"], last=now)
    return state


def test_upsert(spark):
    """Fold and merge equal applying rows one by one, for random batches."""
    r = random.Random(1)
    state, snapshot = {}, None
    for now in (1, 2, 3):
        batch = [{"key": r.choice("abcdef"), "name": r.choice([None, "x", "y", "z"]), "status": r.choice(["unknown", "sold", "published"]), "group": str(r.random()), "seq": i} for i in range(12)]
        plain_upsert(state, batch, now)
        rows = spark.createDataFrame([(b["key"], b["name"], b["status"], b["group"], b["seq"]) for b in batch], "dedupe_hash string, victim_name string, status string, actor_group string, seq long")
        if snapshot is None:
            snapshot = rows.limit(0).select("dedupe_hash", "victim_name", "actor_group", "status", F.lit(0).alias("first_seen_at"), F.lit(0).alias("last_seen_at"))
        merged = maintain.upsert(snapshot, maintain.fold(rows), F.lit(now))
        kept = merged.collect()
        inserted = maintain.outcome(merged).first()
        assert inserted.inserted + inserted.updated == 12
        assert {k.dedupe_hash: (k.victim_name, k.status, k.actor_group, k.first_seen_at, k.last_seen_at) for k in kept} == {k: (s["name"], s["status"], s["group"], s["first"], s["last"]) for k, s in state.items()}
        snapshot = spark.createDataFrame(kept, merged.schema).drop("is_new", "sightings")


def test_repair(spark):
    t = dt.datetime
    rows = [(1, "old1", "g", "Acme", None, t(2026, 1, 1)), (2, "new1", "g", "Acme Inc", "acme.test", t(2026, 1, 5)), (3, "old3", "g", "Beta", None, t(2026, 1, 2)), (4, "x", "g", "Gamma", None, t(2026, 1, 3))]
    df = spark.createDataFrame(rows, "id long, dedupe_hash string, actor_group string, victim_name string, victim_domain string, first_seen_at timestamp")
    fixes = spark.createDataFrame([("g", "ACME", "acme.test", "new1"), ("g", "beta", "beta.test", "new3"), ("g", "none", "none.test", "n")], "actor_group string, victim_name string, victim_domain string, new_hash string")
    out = {r.id: r for r in maintain.repair(df, fixes).collect()}
    assert set(out) == {2, 3, 4} and out[2].first_seen_at == t(2026, 1, 1)
    assert (out[3].dedupe_hash, out[3].victim_domain, out[3].first_seen_at) == ("new3", "beta.test", t(2026, 1, 2)) and out[4].dedupe_hash == "x"


def test_alerts(spark):
    records = spark.createDataFrame([(1, "Acme Ltd", "mail.acme.test", "lockbit"), (2, None, "acme.test", "play"), (3, "Zed", None, "play")], "id long, victim_name string, victim_domain string, actor_group string")
    rules = spark.createDataFrame([(1, "exact", "acme ltd", True), (2, "domain", "acme.test", True), (3, "substring", "acme", True), (4, "actor_group", "play", True), (5, "domain", "ac_e.test", True), (6, "substring", "zed", False), (7, "domain", "test", True)], "alert_id long, match_kind string, match_value string, enabled boolean")
    found = {(r.alert_id, r.record_id, r.matched_on) for r in alerts.match(records, rules).collect()}
    assert found == {(1, 1, "victim_name"), (2, 1, "victim_domain"), (2, 2, "victim_domain"), (3, 1, "victim_name"), (3, 2, "victim_name"), (4, 2, "actor_group"), (4, 3, "actor_group"), (5, 1, "victim_domain"), (7, 1, "victim_domain"), (7, 2, "victim_domain")}


def test_alerts_against_plain(spark, monkeypatch):
    """Random rules of all kinds against a comparison of every pair; also where values take several blocks."""
    r = random.Random(9)
    word = lambda n: "".join(r.choice("ab.c_%") for _ in range(n)) if r.random() < 0.2 else "".join(r.choice("abc. ") for _ in range(n))
    records = [(i, r.choice([None, word(12).upper(), word(5)]), r.choice([None, ".".join("".join(r.choice("abc") for _ in range(2)) for _ in range(3))]), r.choice("ab")) for i in range(120)]
    rules = [(i, k := r.choice(["exact", "substring", "domain", "actor_group"]), r.choice("ab") if k == "actor_group" else word(r.choice([1, 2, 3, 5])), r.random() < 0.9) for i in range(160)]
    rules += [(200, "domain", "%", True), (201, "domain", "a_.%", True), (202, "exact", (records[0][1] or "x").lower(), True), (203, "substring", "abcabcabc", True)]

    def like(text, pattern):
        return re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), text, re.S) is not None

    want = set()
    for i, name, domain, crew in records:
        name, domain = (name or "").lower(), (domain or "").lower()
        for a, kind, value, on in rules:
            hit = {"exact": name == value, "substring": value in f"{name} {domain}", "domain": domain == value or like(domain, "%." + value), "actor_group": crew == value}[kind]
            if on and hit:
                want.add((a, i, {"domain": "victim_domain", "actor_group": "actor_group"}.get(kind, "victim_name")))
    left = spark.createDataFrame(records, "id long, victim_name string, victim_domain string, actor_group string")
    right = spark.createDataFrame(rules, "alert_id long, match_kind string, match_value string, enabled boolean")
    for most in (1 << 20, 150):
        monkeypatch.setattr(alerts, "BLOCK_BYTES", most)
        found = alerts.match(left, right).collect()
        assert len(found) == len(want) and {(f.alert_id, f.record_id, f.matched_on) for f in found} == want
    known = alerts.match(left.where("id < 10"), right)
    new = alerts.arrivals(left, left.where("id < 20").select("id"), right, known).collect()
    assert {(f.alert_id, f.record_id) for f in new} == {(a, i) for a, i, _ in want if 10 <= i < 20}


def test_alert_plan(spark, sf):
    """Records are read once, whatever kinds of rules there are, and no pairs are tried."""
    found = registry.QUERIES["alert_match"](spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_hot_alerts(spark):
    """A value that all records meet, shared by several rules; a part that is empty; nothing at all."""
    left = spark.range(5000).selectExpr("id", "concat('Customer ', id) as victim_name", "cast(null as string) as victim_domain", "'g' as actor_group")
    rules = [(1, "substring", "customer", True), (2, "substring", "customer", True), (3, "actor_group", "g", True), (4, "substring", "r 77", True), (5, "domain", "%", True), (6, "domain", "", True), (7, "odd", "customer", True), (8, "exact", None, True)]
    right = spark.createDataFrame(rules, "alert_id long, match_kind string, match_value string, enabled boolean")
    counts = {r.alert_id: r.n for r in alerts.match(left, right).groupBy("alert_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 5000, 2: 5000, 3: 5000, 4: sum("r 77" in f"customer {i}"[7:] for i in range(5000))}
    assert alerts.match(left, right.where("false")).count() == 0 == alerts.match(left.where("false"), right).count()


def test_html_against_plain(spark, sf):
    """Pages of the table, against taking tags out with patterns."""
    def plain(h):
        h = re.sub(r"(?is)<(script|style|noscript|svg|iframe|head)\b.*?</\1>|<!--.*?-->|<!doctype[^>]*>", "<x>", h or "")
        kept = [re.sub(r"[─-⯿]", "", "".join(c for c in unescape(t).strip() if c.isprintable() or c in "\n\t")) for t in re.split(r"(?s)<[^>]*>", h)]
        return "\n".join(x.strip() for t in kept for x in t.splitlines() if x.strip())

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r.page_id: r.text for r in html.texts(pages).collect()}
    words = lambda t: re.findall(r"\w+", t)
    assert {i: words(t) for i, t in found.items()} == {r.page_id: words(plain(r.html)) for r in pages.collect()} and any(found.values())


def test_whole_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Acme Holdings Ltd\nnaïve\n".encode() + b"\xff end")
    (row,) = html.whole_files(spark, str(tmp_path)).collect()
    assert row.text == "Acme Holdings Ltd\nnaïve\n\ufffd end" and row.path.endswith("a.txt")


def _events(spark, folder, name, rows):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def _known(events):
    """What a plain fold in order of the numbers makes of events."""
    want = {}
    for i, ts, user, kind, value, _ in sorted(events):
        status, size, first, last = want.get(user, ("unknown", None, ts, ts))
        status = {"error": "removed", "signup": status}.get(kind, "published")
        want[user] = (status, size if kind == "view" or value is None else int(value), min(first, ts), max(last, ts))
    return {str(k): v for k, v in want.items()}


def test_state_survives_a_restart(spark, tmp_path):
    """Several files in any order, late rows, a restart with the same folder: the state is that of all rows."""
    r = random.Random(4)
    rows = [(i, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=r.randint(0, 9999)), r.randint(1, 9), r.choice(["error", "signup", "view", "click"]), float(r.randint(1, 99)), None) for i in range(120)]
    r.shuffle(rows)
    for k in range(2):
        _events(spark, tmp_path, k, rows[k * 40 : k * 40 + 40])

    def state():
        return {x.dedupe_hash: (x.status, x.leak_size_bytes, x.first_seen_at, x.last_seen_at) for x in job.keyed_state(job.stream(spark, str(tmp_path)), f"{tmp_path}/state").collect()}

    assert state() == _known(rows[:80])
    _events(spark, tmp_path, 2, rows[80:])
    assert state() == _known(rows)
    assert state() == _known(rows)  # nothing new


def test_runs_time_out(spark, tmp_path):
    """A timer fails a run that goes on for too long; one that ended in time, or that is younger, stays."""
    t = dt.datetime(2026, 1, 1)
    schema = "id long, status string, started_at timestamp"
    first = [(1, "running", t), (2, "running", t), (3, "failed", t), (4, "running", t + dt.timedelta(hours=2)), (5, "running", t + dt.timedelta(hours=1)), (2, "succeeded", t)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(f"{tmp_path}/runs")
    as_of = int((t + dt.timedelta(hours=2)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)

    def found():
        runs = spark.readStream.schema(schema).parquet(f"{tmp_path}/runs")
        return {r.id: (r.status, r.error) for r in job.abandoned(runs, f"{tmp_path}/out", 3600, as_of).collect()}

    want = {1: ("failed", maintain.STOPPED), 2: ("succeeded", None), 3: ("failed", None), 4: ("running", None), 5: ("running", None)}
    assert found() in (want, want | {5: ("failed", maintain.STOPPED)})  # its hour is over just as the clock goes on
    spark.createDataFrame([(4, "failed", t + dt.timedelta(hours=2)), (6, "running", t)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/runs")
    again = found()
    assert again[4] == ("failed", None) and again[6] == again[1] == ("failed", maintain.STOPPED) and again[2] == ("succeeded", None)


def test_alerts_on_arrival(spark, tmp_path):
    """A record that comes again, in its batch or a later one, isn't alerted again; one without an id never is."""
    schema = "id long, victim_name string, victim_domain string, actor_group string"
    rules = spark.createDataFrame([(1, "actor_group", "g", True)], "alert_id long, match_kind string, match_value string, enabled boolean")
    for rows in ([(1, "A", None, "g"), (1, "B", None, "g"), (None, "C", None, "g")], [(1, "A", None, "g"), (2, "A", None, "g"), (None, "C", None, "g")], [(3, "A", None, "h")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = job.alerts_on_arrival(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), rules, f"{tmp_path}/out").collect()
    assert sorted(r.record_id for r in found) == [1, 2]


def test_old_keys_leave_the_state(spark, tmp_path):
    """A key comes once within the bound, again after it; what is too late is dropped. The state holds what may come again."""
    day = lambda d: dt.datetime(2026, 1, d)
    schema, counts = "k string, ts timestamp", []
    for rows in ([("a", day(1)), ("a", day(1)), ("b", day(2))], [("a", day(2)), ("c", day(20))], [("d", day(20)), ("a", day(3))], [("a", day(21))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = job.first_within(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["k"], "2 days", f"{tmp_path}/out")
        counts.append(sorted(r.k for r in out.collect()))
    assert counts == [["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"], ["a", "a", "b", "c", "d"]]


def test_snapshots(spark, tmp_path):
    rows = spark.range(10)
    for i, name in enumerate(("20240101", "20240103", "20240102")):
        assert maintain.save_snapshot(rows.where(f"id >= {i}"), str(tmp_path), name).count() == 10 - i
    rows.write.parquet(f"{tmp_path}/data/snapshot=20240109")  # cut off before its pointer was written
    assert maintain.open_snapshot(spark, str(tmp_path)).count() == 9
    assert [(r.name, r.rows) for r in maintain.snapshots(spark, str(tmp_path), 2).orderBy("place").collect()] == [("20240103", 9), ("20240102", 8)]


def test_snapshots_go_by_age(spark, tmp_path, monkeypatch):
    """Old ones go, the newest stays however old, one that was cut off goes with its age; a short write is no snapshot."""
    rows = spark.range(10)
    for name in ("20240101", "20240105", "20240109"):
        maintain.save_snapshot(rows, str(tmp_path), name)
    rows.write.parquet(f"{tmp_path}/data/snapshot=20240103")  # cut off
    rows.write.parquet(f"{tmp_path}/data/snapshot=20240110")  # under way
    assert maintain.remove_snapshots(spark, str(tmp_path), "20240106") == ["20240101", "20240103", "20240105"]
    assert maintain.remove_snapshots(spark, str(tmp_path), "20250101", keep=1) == ["20240110"]
    assert maintain.open_snapshot(spark, str(tmp_path)).count() == 10 and [r.name for r in maintain.snapshots(spark, str(tmp_path)).collect()] == ["20240109"]
    read = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p, **k: read(self, *p, **k).limit(3))
    with pytest.raises(OSError):
        maintain.save_snapshot(rows, str(tmp_path), "20240111")
    monkeypatch.undo()
    assert [r.name for r in maintain.snapshots(spark, str(tmp_path)).collect()] == ["20240109"]


def test_roll_up(spark):
    rows = [(1, "b", "failed", 0, 0, []), (1, "a", "failed", None, 1, None), (1, "c", "succeeded", 2, 1, [9, 3]), (2, "a", "succeeded", 0, 0, [])]
    found = {r.run_id: tuple(r)[1:] for r in maintain.roll_up(spark.createDataFrame(rows, "run_id long, slug string, status string, inserted long, updated long, new_ids array<long>")).collect()}
    assert found == {1: (3, 2, 2, 2, ["a", "b"], [3, 9]), 2: (1, 0, 0, 0, [], [])}


def test_lists_are_in_order(spark, sf):
    names = [r.name for r in registry.QUERIES["sources_health"](spark, sf).collect()]
    assert names == sorted(names) and len(names) > 5
    seen = [(r.slug, -r.times_seen, r.onion_host) for r in registry.QUERIES["mirrors_listed"](spark, sf).collect()]
    assert seen == sorted(seen) and seen
    mirrors = spark.createDataFrame([(1, "h", 3), (2, "h", 1), (1, "g", 9)], "source_id long, onion_host string, times_seen long")
    sources = spark.createDataFrame([(1, "one"), (2, "two")], "id long, slug string")
    assert [(r.slug, r.onion_host) for r in maintain.list_mirrors(mirrors, sources, slug="one").collect()] == [("one", "g"), ("one", "h")]


def test_extraction_by_sql(spark, sf):
    """The table function gives what the operator gives, on documents, pages, nulls and mixtures that tags and overlaps are in."""
    r = random.Random(12)
    parts = ["10 Feb 2026", "www.acme.test", "Acme Holdings Ltd", "Germany", "a brewery", "filler " * 50, "United Kingdom", "\n", "hospital", "status: sold", "1.2 TB"]
    texts = ["".join(r.choice(parts) + " " for _ in range(25)) for _ in range(80)] + [None, ""]
    texts += [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [x.text for x in html.texts(spark.read.parquet(f"{sf}/pages.parquet")).collect()]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, text string")
    spans.register(spark, "spans_of")
    shown = ["page_id", "label", "text", "start", "end", "confidence", "seq", "hits"]
    found = spark.sql("SELECT p.page_id, s.* FROM {p} p, LATERAL spans_of(p.text) AS s", p=pages).select(shown).collect()
    want = spans.extract(pages).select(shown).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, want)) and len({x.label for x in want}) == 7 and len(want) > 500


def test_search(spark):
    df = spark.createDataFrame([("Northwind Logistics", None), ("Wind farms of the North", "farming.test"), (None, "north.wind.test")], "n string, d string")
    find = lambda q: [bool(r[0]) for r in df.select(fx.matches(F.col("n"), F.col("d"), F.lit(q))).collect()]
    assert find("northwind") == [True, False, False] and find("the farm") == [False, True, False] and find("logistic") == [True, False, False]
    assert find("wind, NORTH") == [False, True, True] and find("the of") == [False, False, False] and find("north.wind.test") == [False, True, True]
    assert find("companies") == [False] * 3 and find("logistics farmed") == [False, False, False] and find("FARMS northern") == [False, False, False]


def test_stems():
    """Words and their stems from the published sample of the stemmer's vocabulary, and of each of its rules."""
    known = """consign consign consigned consign consignment consign consistency consist consistently consist consolation consol consolatory consolatori console consol
        consolidating consolid consolingly consol consonant conson conspicuously conspicu conspiracy conspiraci conspirators conspir constables constabl constancy constanc
        knackeries knackeri knavish knavish kneaded knead kneeling kneel knightly knight knitted knit knives knive knockers knocker generate generat generously generous
        communication communic arsenal arsenal relational relat hopping hop hoping hope happy happi flies fli ties tie dies die by by say say enjoy enjoy skies sky news news
        proceed proceed agreed agre feed feed probably probabl technology technolog rationalize ration helplessly helpless decision decis addition addit gas gas this this
        controll control cease ceas rate rate youth youth national nation luxuriated luxuri bias bias dying die"""
    pairs = list(zip(known.split()[::2], known.split()[1::2]))
    assert [(w, stems.stem(w)) for w, _ in pairs] == pairs
    assert [stems.stem(w) for w in ("", "a", "'s", "y", "ye", "aaa")] == ["", "a", "'s", "y", "ye", "aaa"]


def test_index(spark, tmp_path):
    """Searches of the index against a look at every record; rows that come later, go, have no id or no text."""
    r = random.Random(8)
    pool = ["Northwind", "Logistics", "logistic", "farms", "Farming", "the", "wind", "north", "company", "Companies", "42", "x"]
    rows = [(r.choice([i, i + 70_000, i + 200_000]), " ".join(r.choice(pool) for _ in range(r.randint(0, 4))) or None, r.choice([None, "north.wind.test", "farm.test"])) for i in range(300)]
    schema = "id long, victim_name string, victim_domain string"
    index, later = Table(spark, str(tmp_path), "term", 4), spark.createDataFrame(rows[200:] + [(None, "Northwind", None)], schema)
    search.add(index, spark.createDataFrame(rows[:200], schema), "victim_name", "victim_domain")
    search.add(index, later, "victim_name", "victim_domain")
    search.add(index, later, "victim_name", "victim_domain")  # again: nothing changes
    words = lambda n, d: {stems.stem(w) for w in re.findall("[a-z0-9]+", f"{n or ''} {d or ''}".lower()) if w not in fx.STOP}

    def check(have):
        for query in ("northwind", "the farmed company", "logistics farm", "wind of the north", "42", "nothing", "the", "", "WIND test farms"):
            want = words(query, None)
            found = [x.id for x in search.find(index, query).collect()]
            assert sorted(found) == sorted(i for i, n, d in have if want and want <= words(n, d))

    check(rows)
    search.without(index, spark.createDataFrame(rows[50:120], schema), "victim_name", "victim_domain")
    check(rows[:50] + rows[120:])
    plan = search.find(index, "northwind farm")._jdf.queryExecution().executedPlan().toString()
    assert "term IN" in plan or "term#" in plan and len(index.touched(spark.createDataFrame([("farm",), ("northwind",)], "term string"))) <= 2




def test_html(spark):
    page = "<html><head><title>no</title></head><body><p>One\t<b>two</b><script>x</script></p><div class='my-countdown'>9</div><br>Nestl&eacute; ★<p> </p></body></html>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "plain")], "page_id long, html string")
    assert {r.page_id: r.text for r in html.texts(df).collect()} == {1: "One\ntwo\nNestlé", 2: "", 3: "plain"}


def test_addresses(spark):
    a, b, c = ("http://" + x * 56 + ".onion" for x in "abc")
    text = f"Our mirrors:\n{a}\n{b}/x\n\none\ntwo\nthree\nsupport chat {c}\n{a}"
    df = spark.createDataFrame([(1, text)], "page_id long, text string")
    assert {r.url: r.announced for r in html.addresses(df).collect()} == {a: True, b + "/x": True, c: False}
    hosts = spark.createDataFrame([(x * 56 + ".ONION",) for x in "Ac"], "onion_host string")
    assert [r.url for r in html.addresses(df, hosts).collect()] == [b + "/x"]
    r = random.Random(2)
    urls = ["".join(r.choice("abcdefg234567") for _ in range(56)) + ".onion" for _ in range(9)]
    parts = [*urls, *(f"https://{u}/p" for u in urls[:4]), "our new site", "Mirrors", "plain words", "", "  ", "support", "chat at", "we moved"]
    pages = ["".join(" ".join(r.choice(parts) for _ in range(r.choice([1, 1, 2]))) + r.choice(["\n", "\r\n"]) for _ in range(25)) for _ in range(60)]
    found = html.addresses(spark.createDataFrame(list(enumerate(pages)), "page_id long, text string")).collect()
    assert {(x.page_id, x.onion_host): (x.url, x.announced) for x in found} == {(i, h): v for i, p in enumerate(pages) for h, v in plain_addresses(p).items()}


def plain_addresses(text):
    """For each host its first address, and whether wording claims it: judged by the list of lines above it."""
    says, link = re.compile(html.ANNOUNCES, re.I), re.compile(html.ADDRESS, re.I)
    lines, out = [x.strip() for x in text.splitlines()], {}
    for i, line in enumerate(lines):
        above = [x for x in lines[:i] if x and not link.fullmatch(x)][-3:]
        verdicts = [False if link.search(x) else True for x in above if link.search(x) or says.search(x)]
        for m in link.finditer(line):
            out.setdefault(m[2].lower(), (f"{(m[1] or 'http').lower()}://{m[2].lower()}{m[3] or ''}", bool(says.search(line) or (verdicts and verdicts[-1]))))
    return out


def test_parameters():
    with pytest.raises(ValueError):
        api.page(None, None, None, limit=101)
    with pytest.raises(ValueError):
        api.page(None, None, None, sort="id")


def test_chunks(spark):
    text = "aa\n\nbbb\n\ncccc\n\n" + "d" * 30
    (out,) = apply(spark, lambda c: spans.chunks(c, 12), [text])
    assert all(text[c.start : c.start + len(c.text)] == c.text for c in out) and "".join(c.text for c in out).replace("\n", "") == text.replace("\n", "")


def test_requests_and_switches(spark):
    now = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    rows = spark.createDataFrame([(1, "succeeded", None)], "id long, status string, source_slug string").withColumn("requested_at", now)
    one = maintain.add_request(rows, 2, "a", now)
    assert [tuple(r) for r in one.select("id", "status", "source_slug").orderBy("id").collect()] == [(1, "succeeded", None), (2, "queued", "a")]
    assert maintain.add_request(one, 3, None, now).count() == 2  # an open one serves
    with_error = one.withColumn("error", F.lit("old"))
    got = maintain.finish_requests(with_error, spark.createDataFrame([(2, "failed", "x" * 2000), (1, "succeeded", "")], "id long, status string, error string"), now).orderBy("id").collect()
    assert [(r.status, r.error) for r in got] == [("succeeded", None), ("failed", "x" * 1000)]
    kept = maintain.finish_requests(with_error.withColumn("finished_at", F.to_timestamp(F.lit("2023-01-01 00:00:00"))), spark.createDataFrame([(2, "failed", "x")], "id long, status string, error string"), now).orderBy("id").collect()
    assert [r.finished_at.year for r in kept] == [2023, 2024]
    sources = spark.createDataFrame([(1, "a", "u", True), (2, "b", "v", True)], "id long, slug string, active_url string, enabled boolean")
    named = spark.createDataFrame([("b",), ("b",), ("c",)], "slug string")
    assert [r.active_url for r in maintain.clear_active_url(sources, named).orderBy("id").collect()] == ["u", None]
    assert [r.enabled for r in maintain.set_enabled(sources, False).orderBy("id").collect()] == [False, False]
    assert [r.enabled for r in maintain.set_enabled(sources, False, named).orderBy("id").collect()] == [True, False]


def test_promotion(spark):
    now = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    sources = spark.createDataFrame([(1, "a", None), (2, "b", "v")], "id long, slug string, active_url string")
    mirrors = spark.createDataFrame([(1, "h", "m", 1), (1, "k", "n", 2), (2, "h", "o", 3)], "source_id long, onion_host string, url string, times_seen long").withColumn("last_ok_at", F.lit(None).cast("timestamp"))
    moved, worked = maintain.promote(sources, mirrors, mirrors.where("url = 'n'"), now)
    assert [r.active_url for r in moved.orderBy("id").collect()] == ["n", "v"]
    assert [r.last_ok_at is not None for r in worked.orderBy("url").collect()] == [False, True, False]
    listed = maintain.list_mirrors(mirrors, sources, "a").collect()
    assert [(r.slug, r.url) for r in listed] == [("a", "n"), ("a", "m")]


def test_rules_of_owners(spark):
    rules = spark.createDataFrame([(1, "o", "exact", "a", True)], "alert_id long, owner_id string, match_kind string, match_value string, enabled boolean")
    more = api.add_rule(rules, 2, "p", "domain", " Acme.TEST ")
    assert [tuple(r) for r in more.where("alert_id = 2").collect()] == [(2, "p", "domain", "acme.test", True)]
    assert api.patch_rule(more, 2, "o", False).where("enabled").count() == 2 and api.patch_rule(more, 2, "p", False).where("enabled").count() == 1
    assert api.delete_rule(more, 2, "o").count() == 2 and api.delete_rule(more, 2, "p").count() == 1
    for kind, value in (("odd", "value"), ("exact", " x "), ("exact", "x" * 201)):
        with pytest.raises(ValueError):
            api.add_rule(rules, 3, "o", kind, value)


def test_daily_counts_of_many_files(spark, sf, tmp_path):
    """Files that each span the whole month, one in a batch: no row is late."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    part = lambda k: events.where(F.col("event_id") % 5 == k)
    for k in range(5):
        part(k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    events.limit(3).withColumn("ts", F.lit(None).cast(events.schema["ts"].dataType)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    count = lambda folder, late=None: {(r.date, r.event_type): r.total for r in job.daily_counts(job.stream(spark, str(tmp_path)), str(tmp_path / folder), late).collect()}
    day = F.to_date(F.col("ts").cast("timestamp")).alias("date")
    want = {(r.date, r.event_type): r["count"] for r in spark.read.parquet(f"{tmp_path}/events.parquet").groupBy(day, "event_type").count().collect()}
    assert sum(want.values()) == events.count() + 3
    assert count("whole") == want
    assert 0 < sum(count("live", "2 days").values()) < sum(want.values())


def test_records_in_the_pass(spark):
    """records and spans come of the pass that finds them, without an exchange, and are those that windows give."""
    r = random.Random(9)
    parts = ["10 Feb 2026", "www.acme.test", "beta.test", "Acme Holdings Ltd", "Harbor Services Ltd", "Customer Services Ltd", "Germany", "a brewery", "filler " * 45, "\n", "hospital", "status: sold", "leaked", "1.2 TB", "3 GB", " , "]
    texts = ["".join(r.choice(parts) + r.choice([" ", "\n", ""]) for _ in range(25)) for _ in range(150)] + [PAGE, "", None]
    pages = spark.createDataFrame([(i, t, f"G {i % 3}", f"u{i}") for i, t in enumerate(texts)], "page_id long, text string, source_group string, source_url string").localCheckpoint()
    found = linker.read(pages)
    want = linker.link(spans.extract(pages), pages)
    shown = [F.round(c, 9).alias(c) if c == "confidence" else c for c in found.columns]
    assert found.columns == want.columns and sorted(map(repr, found.select(shown).collect())) == sorted(map(repr, want.select(shown).collect())) and want.count() > 300
    for frame in (found, spans.extract(pages)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Window" not in plan and "Exchange hashpartitioning(page_id" not in plan
    # A page's last word on its crew, and spans of nothing but blanks.
    odd = [("victim_org", "A Ltd", 0, 5, 0.5, 0, []), ("ransomware_group", "X", 6, 7, 0.5, 1, []), ("ransomware_group", "Y", 8, 9, 0.5, 2, []), ("victim_org", " ", 10, 11, 0.5, 3, [])]
    assert [(g[0], g[1], g[-2], g[-1]) for g in linker.gathered(odd)] == [(1, "A Ltd", 1, "Y")]


def test_plain_pages(spark, sf, monkeypatch):
    """pages of the usual forms need no parser, and every page gives what the parser gives."""
    r = random.Random(14)
    parts = [
        "<p>", "</p>", "<div class='timer x'>", '<div id="a" hidden>', "</div>", "<br>", "<br/>", "<p/>", "<script>var a = '<p>';</script>", "<style>p {}</style>", "<script>", "</script>", "<title>a</title>", "<title>a<b>c</title>", "<!-- c -->", "<!---->", "<!-->",
        "<!-- a -- b -->", "<!-- <p> -->", "<!doctype html>", "<!DOCTYPE html>", "<?pi ?>", "<![CDATA[x]]>", "&amp;", "&lt;p&gt;", "&#65", "&", "<", ">", "a < b", "text ", "\n", "Ä", "<A HREF=x>", "<a href=\"?a=1&b\">", "</a >", "<img src='a>b'>", "<svg>", "</svg>",
        "<head>", "</head>", "<body>", "</body>", "<noscript>n</noscript>", "<textarea><p></textarea>", "<x-y>", "<p\n>", "<SCRIPT>a</SCRIPT>", "<script><!-- </script>", "\x00", "</p", "<p", "--", "</>", "<iframe>", "</iframe>",
    ]
    pages = ["".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(30000)] + [x.html or "" for x in spark.read.parquet(f"{sf}/pages.parquet").collect()]

    def parsed(page):
        p = html._Text()
        p.feed(page)
        p.close()
        return "\n".join(p.parts)

    wrong = [p for p in pages if html.page_text(p) != parsed(p)]
    assert not wrong, wrong[:5]
    monkeypatch.setattr(html._Text, "feed", lambda *_: (_ for _ in ()).throw(AssertionError("parsed")))
    assert html.page_text("<!doctype html><head><title>n</title><style>p {}</style></head><body><!-- n --><p>A &amp; B</p><div class='timer'>x</div><script>'<p>'</script> c</body>") == "A & B\nc"


def test_sql_calls_make_no_tables(spark):
    """a call has one page's few spans, so its rows go back in batches with those of other calls."""
    spans.register(spark, "spans_in_rows")
    plan = spark.sql("SELECT s.* FROM VALUES ('a'), ('b') AS p(text), LATERAL spans_in_rows(p.text) AS s")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan
