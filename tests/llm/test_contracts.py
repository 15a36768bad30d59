"""Each query's result against a plain version, and the operators on awkward rows."""

import base64
import hashlib
import math
import re
import struct
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, jaccard, licenses, mixing, pii, quality, registry, sharding, topk, toxicity, warc

LONG = "word and more " * 9000
AWKWARD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "b"), (4, "one two", "en", "b"), (5, LONG, "en", "a"), (6, "x" * 30000 + " " + "7" * 5000, "en", "c"),
    (7, "The same text in two rows, Released under the MIT License.", "en", "c"), (7, "The same text in two rows, Released under the MIT License.", "en", "c"),
    (8, "ÉCOLE Σας naïve <|endoftext|> 中文 a.b@c-d.example.com 10.0.0.256 1.2.3.4 card 4111 1111 1111 1111 +1 (555) 123-4567", "fr", "é"), (None, "no id here at all, none whatsoever", "en", "a"),
    (9, "token = sk-9f8e7d6c5b4a39281706fedc mail me: jane [at] host [dot] org or call 555 123 4567 now", "en", "a"), (10, "́ é \x1c \xa0 'S 'LL", "en", "a"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string")
    clash = ["size", "n_words", "spans", "ids", "score", "kept", "n_tokens", "labels", "copies", "n_chars"]
    return docs.withColumns({c: F.lit(-1).cast("long") for c in clash})


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# 1


def check_bpe(found, texts):
    library = Tokenizer.from_file(public_tokenizers.path(registry.VOCABULARY))
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = found[i]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe(spark, sf, texts, awkward, empty):
    check_bpe(rows(registry.op1_bpe(spark, sf)), texts.items())
    path = public_tokenizers.path(registry.VOCABULARY)
    out = bpe.encode(awkward, path)
    assert out.count() == len(AWKWARD) and "lang" in out.columns
    check_bpe(rows(bpe.digests(out)), [(i, t) for i, t, *_ in AWKWARD])
    assert bpe.encode(empty, path).count() == 0


def test_bpe_pairs():
    """Incompatible pairs are found: verified words equal merged ones."""
    v = bpe.Vocabulary(open(public_tokenizers.path(registry.VOCABULARY), "rb").read())
    words = ["".join(np.random.default_rng(i).choice(list("etaoinshr"), 2 + i % 12)) + bpe._END for i in range(3000)]
    assert sum(v.propose(w) != v.merge(w) for w in words) > 300
    packed = v.encode_words(list(set(words)))
    assert all(packed[w] == v.id[v.merge(w)].tobytes() for w in words)
    long = "the" * 5000 + bpe._END
    assert v.encode_words([long])[long] == v.id[v.merge(long)].tobytes()


def test_bpe_code_points():
    """Every assigned code point is cut, folded and encoded as the library does."""
    path = public_tokenizers.path(registry.VOCABULARY)
    v, library = bpe.Vocabulary(open(path, "rb").read()), Tokenizer.from_file(path)
    texts = [f"a{c}b1{c}{c} {c}" for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co")]
    for k in range(0, len(texts), 20000):
        part = texts[k : k + 20000]
        want = library.encode_batch(part, add_special_tokens=False)
        assert [t for t, g, w in zip(part, v.encode(pa.array(part)).to_pylist(), want) if list(np.frombuffer(g, "<u4")) != w.ids] == []


def test_bpe_memory(monkeypatch):
    """Generations of a few entries give the same ids, and stay within their bound."""
    v = bpe.Vocabulary(open(public_tokenizers.path(registry.VOCABULARY), "rb").read())
    texts = [" ".join(f"word{i * k % 97} the, an{i}" for k in range(20)) for i in range(60)]
    want = v.encode(pa.array(texts)).to_pylist()
    v.chunk_memory, v.word_memory = bpe.Memory(5000), bpe.Memory(3000)
    assert [v.encode(pa.array([t]))[0].as_py() for t in texts] == want
    assert len(v.chunk_memory.young) + len(v.chunk_memory.old) < 100


# 2


def plain_targets(sizes, limit=3):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, cut = sum(sizes.values()), set()
    while True:
        rest = total - sum(limit * sizes[s] for s in cut)
        w = sum(weight[s] for s in order if s not in cut)
        target = {s: limit * sizes[s] if s in cut else rest * weight[s] / w for s in order}
        over = {s for s in order if s not in cut and target[s] > limit * sizes[s]}
        if not over:
            return target
        cut |= over


def check_mix(found, docs):
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(plain_words(t))
    target = plain_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for (i, t, s), r in zip(docs, found):
        n = len(plain_words(t))
        assert (r.size, r.source_size) == (n, sizes[s])
        assert math.isclose(r.target, target[s], rel_tol=1e-9)
        assert r.taken in (0, n, 2 * n, 3 * n)
        taken[s] += r.taken
        largest[s] = max(largest[s], n)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] + 0.1 * target[s]


def test_mixing(spark, sf, awkward, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id")
    found = sorted(registry.op2_mixing(spark, sf).collect())
    check_mix(found, [(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert found == sorted(registry.op2_mixing(spark, sf).collect())
    some = mixing.mixed_sizes(awkward)
    key = lambda r: (r.doc_id is None, r.doc_id, r.size)
    assert [r.size for r in sorted(some.collect(), key=key)] == [len(plain_words(t)) for _, t, *_ in sorted(AWKWARD, key=lambda a: (a[0] is None, a[0], len(plain_words(a[1]))))]
    emitted = mixing.emit(awkward)
    assert emitted.columns == awkward.columns
    copies = Counter(r.doc_id for r in emitted.select("doc_id").collect())
    mixed = mixing.mix(awkward).select("doc_id", "copies").collect()
    assert copies == +Counter({i: sum(r.copies for r in mixed if r.doc_id == i) for i in {r.doc_id for r in mixed}})
    assert mixing.mixed_sizes(empty).count() == 0 and mixing.emit(empty).count() == 0


def test_many_sources(spark, monkeypatch):
    """Sources beyond the broadcast bound are joined by salt, with the same result."""
    docs = spark.range(600).selectExpr("id as doc_id", "concat('s', id % 40) as source", "repeat('w ', cast(id % 50 as int)) as text")
    plain = sorted(mixing.mixed_sizes(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 3)
    assert sorted(mixing.mixed_sizes(docs).collect()) == plain


# 3


def plain_shard(doc_id, n):
    draw = lambda name: int(hashlib.md5(f"{'null' if doc_id is None else doc_id}:{name}".encode()).hexdigest()[:13], 16) / (1 << 52)

    def best(level, children):
        if len(children) == 1:
            return next(iter(children))
        return min(children, key=lambda c: (-math.log(1 - draw(f"{level}{c}")) / children[c], c))

    t = sharding.tree(n)
    region = best("region", {r: sum(sum(s.values()) for s in racks.values()) for r, racks in t.items()})
    rack = best("rack", {k: sum(s.values()) for k, s in t[region].items()})
    return best("shard", t[region][rack])


def check_shards(found, docs):
    assert len(found) == len(docs)
    slot = defaultdict(list)
    for r in found:
        assert (r.shard, r.grown_shard, r.law) == (plain_shard(r.doc_id, 16), plain_shard(r.doc_id, 17), "key")
        assert r.grown_shard in (r.shard, 16)
        slot[r.shard].append(r.slot)
    for s in slot.values():
        assert sorted(s) == list(range(len(s)))
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in docs)


def test_sharding(spark, sf, texts, awkward, empty):
    check_shards(registry.op3_sharding(spark, sf).collect(), list(texts.items()))
    check_shards(sharding.shard(awkward).collect(), [(i, t) for i, t, *_ in AWKWARD])
    assert sharding.shard(empty).count() == 0


def test_sharding_moves(spark):
    """Rows move only into the subtree whose weight grows, and in proportion."""
    before, after = sharding.tree(16), sharding.tree(16)
    after[1][3][13] = 3.0
    keys = spark.range(20000).select(sharding.place(F.col("id"), before).alias("a"), sharding.place(F.col("id"), after).alias("b")).toPandas()
    moved = keys[keys.a != keys.b]
    assert set(moved.b) <= {8, 9, 10, 11, 12, 13, 14, 15} and set(moved[moved.a >= 8].b) <= {12, 13, 14, 15} and set(moved[moved.a >= 12].b) == {13}
    share = keys.b.value_counts(normalize=True)
    assert abs(share[13] - 3 / 18) < 0.02 and all(abs(share[s] - 1 / 18) < 0.02 for s in range(8))


# 4


def plain_spans(t):
    t = t or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]
    return out


def check_pii(found, docs):
    for i, t in docs:
        r, want = found[i], plain_spans(t)
        lines = [":".join(map(str, s)) for s in want]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(lines).encode()).hexdigest()
        assert set(lines) <= set(r.spans.split(",")) | {""}


def test_pii_long_secrets(spark, awkward):
    """Secrets of any length, wherever their digits are."""
    secret = "ghp_" + "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(8))
    texts = {1: (f"secret token: {secret}.", [(14, 14 + len(secret))]), 2: ("x" * 100 + "1 y", [(0, 101)]), 3: ("x" * 400, []), 4: ("key (" + "-".join(["Ab1"] * 200) + ")", [(5, 804)]), 5: ("a1" * 9, [])}
    assert {i: [s[1:3] for s in pii.added_spans(t, []) if s[0] == "secret"] for i, (t, _) in texts.items()} == {i: want for i, (_, want) in texts.items()}
    docs = spark.createDataFrame([(1, texts[1][0])], "doc_id long, text string")
    assert pii.redact(pii.find(docs, pii.train(awkward)), docs.columns).first().text == "secret token: [SECRET]."


def test_pii(spark, sf, texts, awkward, empty):
    check_pii(rows(registry.op4_pii(spark, sf)), texts.items())
    model = pii.train(awkward)
    found = rows(pii.digests(pii.find(awkward, model)))
    check_pii(found, [(i, t) for i, t, *_ in AWKWARD if i != 6])  # 6: the plain pattern takes quadratic time
    assert {"secret", "address"} <= {s.split(":")[0] for s in found[9].spans.split(",")}
    assert pii.digests(pii.find(empty, pii.train(empty))).count() == 0
    clean = rows(pii.redact(pii.find(awkward, model), awkward.columns))
    assert "a.b@c-d" not in clean[8].text and "[EMAIL]" in clean[8].text and "[CARD]" in clean[8].text
    assert clean[7].text == AWKWARD[6][1] and clean[1].text is None and clean[9].n_chars == len(clean[9].text)


@pytest.mark.parametrize("t", ["a@b.c@d.e x@@y.z @a.b %@a.b.", "1.2.3.4.5.6.7.8 1..2.3.4 001.2.3.255 1.2.3.4000", "4111-1111 1111  1111 4111111111111111 0000000000000", "+1 (555) 123-45-67. ++12345678901 +1 +1-", "1-2-3+4 5.6.7.8.9@1.2", "a" * 300 + "@b.co-m.x-"])
def test_pii_patterns(t):
    order = {k: i for i, k in enumerate(pii.BASE)}
    assert sorted((s[:3] for s in pii.base_spans(t) if s[3]), key=lambda s: (order[s[0]], s[1])) == plain_spans(t)


def test_pii_model_decides(spark):
    """The trained model rejects spans that the patterns alone would keep, and keeps their like that are real."""
    g = np.random.default_rng(6)
    hexes = ["".join(g.choice(list("0123456789abcdef"), 36)) for _ in range(60)]
    cards = ["4845168114407329", "4417744280351547", "4929348385146306", "4952935900253052"]
    wrong = ["7536784127813050", "9807915762804490", "7086638319846192", "1234567812345678"]
    texts = [f'token = "{h}" and more' for h in hexes] + [f"see /archive/annual-report-for-the-year-20{i:02}-final-version/ there" for i in range(60)]
    texts += [f"pay with card {cards[i % 4]} {cards[(i + 1) % 4]} now" for i in range(30)] + [f"numbers {wrong[i % 4]} {wrong[(i + 1) % 4]} only" for i in range(30)]
    texts += [f"mail me at jane{i} [at] host{i} [dot] org please" for i in range(20)] + [f"we met at noon.today and at nine.o{'x' * (i % 5)}clock" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.train(docs)
    found = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in pii.find(docs, model).collect()}
    assert all(found[i] == [("secret", h)] for i, h in enumerate(hexes))
    assert all(found[i] == [] and pii.added_spans(texts[i], []) for i in range(60, 120))
    assert all([k for k, _ in found[i]] == ["cardpart"] * 2 for i in range(120, 150)) and not any(found[i] for i in range(150, 180))
    assert all([k for k, _ in found[i]] == ["address"] for i in range(180, 200)) and not any(found[i] for i in range(200, 220))
    assert set(model.reliability) >= {"secret", "cardpart"} and not np.allclose(model.reliability["secret"], model.reliability["cardpart"], atol=0.05)


def test_em():
    """Labelers of known reliability are told apart, and the truth is recovered."""
    g = np.random.default_rng(3)
    truth = g.random(6000) < 0.3
    vote = np.stack([np.where(g.random(6000) < a, np.where(truth, 1, -1), np.where(truth, -1, 1)) for a in (0.95, 0.8, 0.7, 0.55, 0.9)], 1)
    p, habits = pii.em(vote, np.ones(6000))
    assert ((p > 0.5) == truth).mean() > 0.95
    assert habits[1, 0, 2] > habits[1, 1, 2] > habits[1, 3, 2]


# 5


def test_toxicity(spark, awkward, empty):
    sf = "/root/testdata/sf0.01"
    found = rows(registry.op5_toxicity(spark, sf))
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(found[r.doc_id], r.toxic) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(f.held_out for f, _ in held) and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in found.values())
    assert np.mean([f.predicted == t for f, t in held]) > 0.95
    model = toxicity.Classifier(-1.0, {"more": 3.0})
    out = toxicity.score(awkward, model)
    assert out.count() == len(AWKWARD) and rows(out)[1].score == pytest.approx(1 / (1 + math.e))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rows(toxicity.score(awkward, toxicity.train(awkward, none)))[5].predicted == 0
    assert toxicity.score(empty, model).count() == 0


def biased(n=600):
    """Texts whose toxic ones are those with an insult, and which mention one group more often there."""
    g = np.random.default_rng(0)
    out = []
    for i in range(n):
        toxic = i % 3 == 0
        group = "muslim" if g.random() < (0.8 if toxic else 0.1) else "christian" if i % 2 else "frauen" if g.random() < (0.9 if toxic else 0.2) else ""
        out.append((i, " ".join([*g.choice([f"{c}w" for c in "abcdefghijklmnopqrstuvwxyz"], 8), "idiot" if toxic and g.random() < 0.9 else "", group]), int(toxic)))
    return out


NEUTRAL = ["many {} live here", "die {} wohnen hier", "les {} sont ici", "los {} viven aquí"]


def test_counterfactuals(spark):
    """The trained model, with the penalty and without: naming a group moves neutral sentences less, insults still count."""
    docs = spark.createDataFrame(biased(), "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    plain, fair = (toxicity.train(docs.select("doc_id", "text"), labels, fairness=f) for f in (0.0, 50.0))
    gap = lambda m, f: abs(m.score(f.format("muslim")) - m.score(f.format("christian")))
    before, after = toxicity.mention_gap(plain, NEUTRAL), toxicity.mention_gap(fair, NEUTRAL)
    print(f"gap on neutral mentions: {before:.3f} without the penalty, {after:.3f} with it")
    assert gap(plain, NEUTRAL[0]) > 0.2 and gap(fair, NEUTRAL[0]) < 0.1 and after < 0.9 * before
    assert fair.score("you idiot") > 0.5 > fair.score("you are kind")


def test_counterfactuals_of_the_table(spark, sf):
    """On the registered query's own tables the penalty acts: without it the terms move neutral sentences more."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fair, plain = (toxicity.train(docs, labels, fairness=f) for f in (toxicity.FAIRNESS, 0.0))
    assert set(toxicity.TERMS) <= fair.weights.keys() and max(abs(fair.weights[w] - plain.weights[w]) for w in fair.weights) > 0.01
    with_, without = toxicity.mention_gap(fair, NEUTRAL), toxicity.mention_gap(plain, NEUTRAL)
    print(f"gap on neutral mentions: {without:.4f} without the penalty, {with_:.4f} with it")
    assert with_ < 0.8 * without and with_ < 0.02
    turns = [toxicity.naming({"one", "text"}, i) - {"one", "text"} for i in range(10 * len(toxicity.IDENTITY))]
    assert {t for added in turns for t in added} == set(toxicity.TERMS) and all(len(t) == 1 for t in turns)
    assert toxicity.naming({"women", "x"}, 3) == {"women", "x"}
    assert set(toxicity.counterfactuals({"women", "x"})) == {("women", "men"), ("women", None)}


def test_fits_take_one_row_an_id(spark):
    """However often a sampled id repeats, and with whatever texts, one row of it is learnt from."""
    docs = spark.range(3000).selectExpr("id % 3 as doc_id", "concat('text ', id) as text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, quality int")
    rows_ = {r.doc_id: r.text for r in quality.sampled_texts(docs, labels, "quality", 100).collect()}
    assert rows_ == {k: min(f"text {i}" for i in range(k, 3000, 3)) for k in range(3)}


def test_toxicity_fit():
    """The gradient of the fit is that of its loss, by finite differences at the result: no single weight can be improved."""
    rows_ = [(set(t.split()), float(y)) for _, t, y in biased(120)]
    sets, y = [toxicity.naming(s, i) for i, (s, _) in enumerate(rows_)], np.array([v for _, v in rows_])
    model = toxicity.fit([s for s, _ in rows_], y, 5.0)

    def loss(weights, b):
        score = lambda s: 1 / (1 + math.exp(-(b + sum(weights.get(w, 0.0) for w in s))))
        p = np.array([score(s) for s in sets])
        pairs = [(score(s) - score((s - {o}) | ({i} if i else set()))) ** 2 for s in sets for o, i in toxicity.counterfactuals(s)]
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + toxicity.RIDGE * sum(v * v for v in weights.values()) / 2 / len(y) + 5.0 * np.mean(pairs))

    best = loss(model.weights, model.intercept)
    for w in ("idiot", "muslim", "christian", "frauen"):
        for d in (-0.3, 0.3):
            assert loss(model.weights | {w: model.weights[w] + d}, model.intercept) > best - 1e-4


# 6


def check_licenses(found, docs):
    for i, t in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at, names = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            hits = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            at += hits
            names |= {label} if hits else set()
        r = found[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at), max(at)) if at else (None, None))
        assert r.base_labels == ",".join(sorted(names)) and names <= set(r.labels.split(",")) | {""}
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and 0 <= r.score <= 1


def test_licenses(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_licenses(rows(registry.op6_licenses(spark, "/root/testdata/sf0.01")), [(r.doc_id, r.text) for r in docs.collect()])
    assert licenses.scan(awkward).count() == len(AWKWARD) and licenses.scan(empty).count() == 0
    check_licenses(rows(licenses.scan(awkward)), [(i, t) for i, t, *_ in AWKWARD])
    cases = {
        1: ("cc by nc cc-by-nc, CC BY NC", "cc-by-nc"), 2: ("GNU General Public License, version 3 or any later version; under the MIT license", "gpl-3,mit"),
        3: ("Apache License Version 2.0 and the Apache License, Version 2", "apache-2"), 4: ("under the mit  licenses", ""),
        5: ("SPDX-License-Identifier: MPL-2.0", "mpl-2"), 6: ("under the MIT license " * 50, "mit"), 7: ("the GNU Lesser General Public License", "lgpl"),
        8: ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 and CC BY-NC-ND 2.5", "cc-by-nc,cc-by-nc-nd-2.5,cc-by-nc-sa-4"), 9: ("GPLv3, LGPLv2.1 or later, MPL2", "gpl-3,lgpl-2.1,mpl-2"), 10: ("License: CC0", "cc0"), 11: ("License: ISC", "isc"),
        12: ("isc mit bsd, mit zlib", ""), 13: ("released under the BSD 3-Clause License", "bsd-3,licensed"), 14: ("Licensed under the Apache License, Version 2.0", "apache-2,licensed"), 15: ("licensed under the MIT, and released under GPL v3", "gpl-3,licensed,mit"), 16: ("CC0 1.0; MIT licensed", "cc0-1,mit"),
    }
    some = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id long, text string")
    found = rows(licenses.scan(some))
    check_licenses(found, [(i, t) for i, (t, _) in cases.items()])
    assert {i: found[i].labels for i in cases} == {i: labels for i, (_, labels) in cases.items()}
    assert len(licenses.rules()) > 200


def plain_scan(t, all_rules):
    """Labels and score by trying every rule on every text, and comparing every match with every other."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    norm = "^ " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    hits = [(m.start(), -m.end(), -p, label) for key, rule, label, p in all_rules if f" {key}" in norm for m in re.finditer(rule, norm)]
    left = [h for h in hits if not any(o < h and o[0] <= h[0] and o[1] <= h[1] and o[2] <= h[2] for o in hits)]
    base = {label for phrase, label in licenses.BASE.items() if f" {phrase} " in norm}
    best = max((-p for _, _, p, _ in left), default=0)
    return ",".join(sorted({label for *_, label in left} | base)), 1.0 if base else (0.0, 0.5, 0.8, 0.95, 0.99)[best]


def test_licenses_plain(spark):
    """Gate, keywords, suppression and score against the plain version, on texts that mix signatures."""
    g, all_rules = np.random.default_rng(11), licenses.rules()
    # One text for each rule: the shortest that its regex spells out.
    spelled = [re.sub(r"\(\?[:=!]\s*|\)\??|\.\{[0-9,]+\}\?", " ", r.replace(licenses.ALONE, "(?= )").replace("[sc]", "s").replace(" ?", " ")).split("|")[0].replace("?", "").replace(".", "u") for _, r, _, _ in all_rules]
    texts = [t.upper() if i % 7 == 0 else t for i, t in enumerate(spelled)] + ["unlicensed, released under the moon", "SPDX-License-Identifier: GPL-2.0-or-later", "Creative Commons Attribution 4.0 International"]
    texts += [", ".join(g.choice(spelled, 4)).replace(" ", "-" if i % 3 else "  ") for i in range(150)]
    found = rows(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_low", "_norm", "_kept", "_p0")})))
    assert [(t, found[i].labels, found[i].score) for i, t in enumerate(texts) if (found[i].labels, found[i].score) != plain_scan(t, all_rules)] == []
    assert sum(bool(found[i].labels) for i in range(len(spelled))) > 0.9 * len(spelled)
    # No rule is another's shadow: regex and label tell them apart.
    assert len({(r, label) for _, r, label, _ in all_rules}) == len(all_rules) > 300


def test_licenses_alone(spark):
    """Each rule fires on a text that holds nothing but its phrase."""
    cases = [
        ("MPL-2.0", "mpl-2"), ("EPL 2.0", "epl-2"), ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa-4"), ("(cc0 1.0)", "cc0-1"),
        ("Permission is hereby granted, free of charge, to any person", "mit"), ("Redistribution and use in source and binary forms", "bsd"), ("provided 'as is', without warranty", "as-is"),
        ("placed in the public  domain", "public-domain"), ("Copyright: all rights reserved", "all-rights-reserved"), ("licensed under the terms of", "licensed"), ("licenced under a", "licensed"),
    ]
    for name, short, label, versions in licenses.FAMILIES:
        cases += [(name.upper(), label), (f"{name} or", label), (f"SPDX-License-Identifier: {short.replace(' ', '-')}", label)]
        for v in versions:
            mark = f"{label}-{v.replace(' ', '.').removesuffix('.0')}"
            cases += [(f"{lead} {v.replace(' ', '.')}", mark) for lead in (f"{name}, version", f"{name} v", name, short, f"{short.upper()}-v")]
    found = rows(licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")))
    assert [(t, label) for i, (t, label) in enumerate(cases) if label not in found[i].labels.split(",") or not found[i].score] == []


# 7


def plain_shingles(t):
    """Sets of tuples of five words; nothing of the operator's is called."""
    w = re.findall("[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    if not w:
        return {t} if t else set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def plain_classes(texts):
    sets = {i: plain_shingles(t) for i, t in texts}
    links, root = Counter(), {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {i: (top(i), links[i]) for i in ids}


def near_copies(n=60):
    g = np.random.default_rng(5)
    base = list(g.choice([f"w{i}" for i in range(500)], 200))
    out = []
    for i in range(n):
        t = list(base)
        for k in g.choice(200, 1 + i % 7, replace=False):
            t[k] = f"x{i}{k}"
        out.append((i, " ".join(t)))
    return out + [(1000 + i, " ".join(g.choice([f"w{i}" for i in range(500)], 100))) for i in range(20)] + [(2000 + i, out[3][1]) for i in range(5)]


def test_jaccard(spark, sf, texts, awkward, empty):
    found = rows(registry.op7_jaccard(spark, sf))
    assert {i: (r.class_id, r.n_links) for i, r in found.items()} == plain_classes(list(texts.items()))
    some = jaccard.classes(awkward).collect()
    assert len(some) == len(AWKWARD)
    assert sorted((r.class_id, r.n_links) for r in some if r.doc_id == 7) == [(7, 1), (7, 1)]
    assert [(r.class_id, r.n_links) for r in some if r.doc_id in (None, 1, 2)] .count((None, None)) == 1
    assert jaccard.classes(empty).count() == 0
    kept = jaccard.deduplicated(awkward)
    assert kept.columns == awkward.columns and Counter(r.doc_id for r in kept.collect())[7] == 1


@pytest.mark.parametrize("block", [384, 16])
def test_jaccard_blocks(spark, monkeypatch, block):
    """A group cut into blocks gives the same links."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    copies = near_copies()
    found = rows(jaccard.classes(spark.createDataFrame(copies, "doc_id long, text string")))
    assert {i: (r.class_id, r.n_links) for i, r in found.items()} == plain_classes(copies)


def test_jaccard_repeated_ids(spark):
    """Rows of one id and different texts are documents of their own: no text is lost, no class merged."""
    g = np.random.default_rng(8)
    a, b, c = (" ".join(g.choice([f"w{i}" for i in range(400)], 80)) for _ in range(3))
    near = b.replace(b.split()[40], "changed", 1)
    docs = [(5, a), (5, b), (6, a), (7, b), (7, b), (8, near), (9, c), (9, c), (9, None), (9, None), (None, a)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_f1", "_F2", "first", "class_id")})
    kept = jaccard.deduplicated(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(5, a), (5, b), (9, c), (9, None), (9, None), (None, a)])
    links = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(df).collect())
    assert links == Counter({(5, 5, 1): 1, (6, 5, 1): 1, (5, 5, 3): 1, (7, 5, 3): 2, (8, 5, 3): 1, (9, 9, 1): 2, (9, 9, 0): 2, (None, None, None): 1})


def test_jaccard_many_texts_of_one_id(spark):
    """Texts under one id meet their own node only: work grows with their number, not its square."""
    g = np.random.default_rng(9)
    docs = []
    for _ in range(1000):
        w = g.choice(20_000, 60).astype(str).tolist()
        docs += [(1, " ".join(w)), (1, " ".join([*w, "more"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    assert {(r.doc_id, r.class_id, r.n_links, r.n) for r in jaccard.classes(df).groupBy("doc_id", "class_id", "n_links").agg(F.count("*").alias("n")).collect()} == {(1, 1, 1, 2000)}
    assert Counter(r.doc_id for r in jaccard.deduplicated(df).collect()) == {1: 1000}


def test_jaccard_recall(spark):
    """Pairs of similarity from 0.8 on among whole documents of sf0.01: all are linked."""
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want, found = plain_classes(docs), rows(registry.op7_jaccard(spark, sf))
    pairs, got = sum(n for _, n in want.values()), sum(r.n_links for r in found.values())
    print(f"recall of links {got / pairs:.4f} of {pairs // 2}")
    assert pairs > 100 and got >= 0.9 * pairs and {i: (r.class_id, r.n_links) for i, r in found.items()} == want


def test_jaccard_boilerplate(spark):
    """Texts that share half their words with all others hang together in no group."""
    g = np.random.default_rng(4)
    frame = list(g.choice([f"b{i}" for i in range(900)], 100))
    docs = [(i, " ".join([*frame, *g.choice([f"w{k}" for k in range(5000)], 60)])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    reps = jaccard.fingerprints(df).withColumn("node", F.col("doc_id"))
    assert reps.select(F.explode("bands").alias("b")).groupBy("b").count().where("count > 1").count() > 20
    assert jaccard._candidates(reps).isEmpty()
    assert {(r.class_id == r.doc_id, r.n_links) for r in jaccard.classes(df).collect()} == {(True, 0)}


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)] + [(101, 100), (102, 101), (103, 100)]
    found = jaccard.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}


# 8


def test_components_of_random_edges(spark):
    """Against repeated relabelling; some nodes meet hundreds of others, both above and below."""
    rng = np.random.default_rng(3)
    pairs = {tuple(p) for p in rng.integers(0, 900, (500, 2)).tolist()} | {(900 + n, 900 + int(rng.integers(n))) for n in range(1, 300)} | {(1500, n) for n in range(1200, 1500, 3)}
    pairs = [p for p in sorted(pairs) if p[0] != p[1]]
    label = {n: n for p in pairs for n in p}
    while any(label[a] != label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    found = jaccard.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(found) == len(label) and {r["node"]: r["root"] for r in found} == label


def plain_counts(t):
    t = t or ""
    w = plain_words(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    twice = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if plain_words(x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice)]


def check_quality(found, docs):
    for i, t in docs:
        r, c = found[i], plain_counts(t)
        assert [r[n] for n in quality.COUNTS] == c
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert not (r.base_failed and r.kept)


def test_quality(spark, sf, texts, awkward, empty):
    check_quality(rows(registry.op8_quality(spark, sf)), texts.items())
    out = quality.assess(awkward, None)
    check_quality(rows(out), [(i, t) for i, t, *_ in AWKWARD])
    assert out.count() == len(AWKWARD) and quality.assess(empty, None).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(awkward, none) is None
    big = "/root/testdata/sf0.01"
    found = rows(registry.op8_quality(spark, big))
    labels = [(found[r.doc_id], r.quality) for r in spark.read.parquet(f"{big}/labels.parquet").collect()]
    assert np.mean([f.kept == bool(q) for f, q in labels if not f.base_failed]) > 0.95


def test_trees():
    """Flat trees follow the labels; a constrained feature only moves the score one way."""
    g = np.random.default_rng(2)
    x = g.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (g.random(3000) < 0.1)).astype(float)
    y = np.where(g.random(3000) < 0.2, (x[:, 1] > 0.3).astype(float), y)
    m = quality.fit(x, y, [0, -1, 0])
    assert ((m.score(x) > 0.5) == y).mean() > 0.75
    grid = np.column_stack([np.full(200, 0.7), np.linspace(0, 1, 200), np.full(200, 0.5)])
    assert (np.diff(m.margin(grid)) <= 1e-9).all()


# 9


def check_topk(found, vectors, k=20):
    fine = [(i, np.array([math.floor(64 * float(np.float32(x))) for x in v], object)) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in fine), default=0)
    fine = [(i, np.pad(v, (0, width - len(v)))) for i, v in fine]
    want = []
    for q, v in {i: v for i, v in fine if i % 20 == 0}.items():
        scores = sorted((-int(v @ w), i) for i, w in fine if i != q)[:k]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == sorted(want)


def test_topk(spark, sf, monkeypatch):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_topk(registry.op9_topk(spark, sf).collect(), vectors)
    ties = [(i, [float(i % 3), -0.5, 2.0]) for i in range(70)] + [(80, None), (100, [None, 1.0, 1.0]), (101, [float("nan"), 1.0, 1.0]), (102, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (103, [1.0]), (104, []), (120, [0.0, 0.0, 0.0]), (140, [-40000.0, 3.0, 1000.0])]
    df = spark.createDataFrame(ties, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    for size in (1 << 17, 16):
        monkeypatch.setattr(topk, "SEGMENT", size)
        check_topk(topk.top_k(df, df.where("vec_id % 20 = 0")).collect(), ties)
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0
    assert topk.top_k(df.where("vec_id = 20"), df.where("vec_id = 20")).count() == 0


def test_topk_segments_by_width(spark, monkeypatch):
    """Wide vectors make segments and blocks of fewer rows, so that a task's memory has a bound; the answer is the same."""
    g = np.random.default_rng(2)
    vectors = [(i, g.normal(size=300).tolist()) for i in range(150)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "SEGMENT_CELLS", 300 * 40)
    monkeypatch.setattr(topk, "BLOCK_CELLS", 300 * 3)
    built, build = [], topk.Segment.build
    check_topk(topk.top_k(df, df.where("vec_id % 20 = 0")).collect(), vectors)
    monkeypatch.setattr(topk.Segment, "build", classmethod(lambda cls, ids, values: built.append(values.size) or build(ids, values)))
    table = pa.table({"vec_id": [i for i, _ in vectors], "q": [[int(64 * x) for x in v] for _, v in vectors]})
    monkeypatch.setattr(topk.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()))
    assert sum(1 for _ in topk._index(1, 40)(iter(table.to_batches()))) == 4 and max(built) == 300 * 40


def test_topk_wide(spark):
    """Components far beyond 32 bits keep their exact scores; what a long can't hold is named."""
    large = [(0, [3e6, 2.0, -1.0]), (1, [3e6, -5.0, 0.5]), (2, [2e6, 0.0, 0.0]), (3, [3e6, 1e6, 7.0]), (20, [-3e6, 2e8, 1e5]), (21, [1e6, 2e6, -3e6])]
    kind = "vec_id long, embedding array<float>"
    df = spark.createDataFrame(large, kind)
    check_topk(topk.top_k(df, df.where("vec_id % 20 = 0")).collect(), large)
    assert {r.score for r in topk.top_k(df, df.where("vec_id = 0")).where("vec_id in (1, 3)").collect()} == {192000000**2 - 320 * 128 - 64 * 32, 192000000**2 + 128 * 64000000 - 64 * 448}
    for vectors, says in (([(0, [1e12]), (1, [1e12])], "fit a long"), ([(0, [1e30]), (1, [1.0])], "fit")):
        beyond = spark.createDataFrame(vectors, kind)
        with pytest.raises(Exception, match=says):
            topk.top_k(beyond, beyond).collect()


# 10


def check_warc(found, pages):
    first = defaultdict(lambda: None)
    for i, h in pages:
        if i is not None:
            first[h or ""] = i if first[h or ""] is None else min(first[h or ""], i)
    want = Counter()
    for i, h in pages:
        b, f = (h or "").encode(), first[h or ""]
        kind = "response" if i == f else "revisit"
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind, f if kind == "revisit" else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == want


def test_warc(spark, sf, empty):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    check_warc(registry.op10_warc(spark, sf).collect(), pages)
    some = [(1, "u", None), (2, "http://x/ y\n", ""), (3, None, "a\r\n\r\nWARC/1.1\r\n\r\n"), (4, "u", "a\r\n\r\nWARC/1.1\r\n\r\n"), (5, "u", "é" * 200000), (6, "u", "same"), (6, "u", "same"), (7, "u", "same"), (None, "u", "same"), (8, "u", "\x00﻿")]
    df = spark.createDataFrame(some, "page_id long, url string, html string").withColumn("sha", F.lit("x"))
    check_warc(warc.round_trip(df).collect(), [(i, h) for i, _, h in some])
    assert warc.round_trip(df.where("false")).count() == 0


def test_arc():
    records = [warc.ArcRecord("http://a/", "1.2.3.4", "19970102030405", "text/html", b"one\ntwo"), warc.ArcRecord("http://b/", "1.2.3.4", "1999", "text/plain", b"", status="404", checksum="c", location="http://c/", filename="f")]
    for version in (1, 2):
        back = list(warc.read_arc(warc.write_arc(records, version)))
        assert [(r.url, r.content) for r in back] == [(r.url, r.content) for r in records]
    assert (back[1].status, back[1].checksum, back[1].location, back[1].filename) == ("404", "c", "http://c/", "f")
    assert (warc.iso("19970102030405"), warc.iso("1999")) == ("1997-01-02T03:04:05Z", "1999-01-01T00:00:00Z")
    headers, block = next(warc.read_warc(iter([warc.to_warc(back[0], 5, False, None) + b"\n"])))
    assert block == b"one\ntwo" and headers["warc-date"] == "1997-01-02T03:04:05Z" and headers["content-type"] == "text/html"
    with pytest.raises(ValueError):
        list(warc.read_arc(b"filedesc://x 0.0.0.0 1996 text/plain 8\n1 0 -\n..\nhttp://a/ 1.2.3.4 1997 text/html 100\nshort"))


# SQL, names and columns


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    order = [c for c in ("query_id", "rank", "doc_id", "page_id") if c in want.columns]
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True), check_dtype=False)


def test_registered():
    """A broken import inside the subpackage isn't taken for its absence."""
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {q.split("_")[0] for q in registry.QUERIES}
    assert registry.QUERIES.items() <= entry.queries().items() and registry.ORACLES.items() <= entry.oracle_sql().items()


def test_clashing_names(spark, awkward):
    """Columns with the names that operators use inside come through every stage as they are."""
    import corpus_pipeline as p

    inside = ["_text", "_seed", "_source", "_whole", "_fraction", "_copies", "_copy", "_salt", "_drawn", "_target", "_plan", "_done", "_low", "_norm", "_kept", "_p0", "_phrase0", "_f1", "_id", "quality", "base_failed", "a.b", "TEXT2", "Spans2"]
    docs = awkward.withColumns({c: F.lit(i) for i, c in enumerate(inside) if c != "a.b"}).withColumn("a.b", F.lit(inside.index("a.b")))
    clash = {"size", "n_words", "spans", "ids", "score", "kept", "n_tokens", "labels", "copies"}
    plain = lambda r: all(r[c] == i for i, c in enumerate(inside)) and all(r[c] == -1 for c in clash)
    kept = {"quality rules": p.quality_rules(spark, docs, "/root/testdata/sf0.001"), "near duplicates": jaccard.deduplicated(docs), "PII": p.personal_data(spark, docs, ""), "mixing": mixing.emit(docs)}
    for name, out in kept.items():
        assert out.columns == docs.columns, name
        assert all(plain(r) for r in out.collect()), name
    assert [kept[k].count() for k in ("near duplicates", "PII")] == [11, 12] and kept["mixing"].count() > 0
    added = {"score": toxicity.score(docs, toxicity.Classifier(-1.0, {})), "labels": licenses.scan(docs), "ids": bpe.encode(docs, public_tokenizers.path(registry.VOCABULARY)), "copies": mixing.mix(docs), "kept": quality.assess(docs, None)}
    for name, out in added.items():
        inner = [c for c in inside if c in out.columns and c not in ("quality", "base_failed")]
        assert out.count() == len(AWKWARD) and name in out.columns and len(inner) >= len(inside) - 3, name
        assert all(r[c] == inside.index(c) for r in out.collect() for c in inner), name
    assert warc.round_trip(docs.selectExpr("doc_id as page_id", "lang as url", "text as html", "_text", "_seed")).count() == len(AWKWARD)


# The pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in p.STAGES:
        out = stage(spark, kept[-1], sf)
        kept.append(spark.createDataFrame(out.collect(), out.schema))
    assert all(k.columns == columns for k in kept[:-1])
    start, good, unique, clean, mixed, last = (k.collect() for k in kept)
    verdict = rows(quality.assess(docs, quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))))
    assert {r.doc_id for r in good} == {i for i, r in verdict.items() if r.kept}
    want = plain_classes([(r.doc_id, r.text) for r in good])
    assert {r.doc_id for r in unique} == {c for c, _ in want.values()}
    assert [r.doc_id for r in sorted(clean)] == [r.doc_id for r in sorted(unique)]
    assert not [r for r in clean if plain_spans(r.text)]
    copies = Counter(r.doc_id for r in mixed)
    assert copies == +Counter({r.doc_id: r.copies for r in mixing.mix(kept[3]).collect()})
    library = Tokenizer.from_file(public_tokenizers.path(registry.VOCABULARY))
    text = {r.doc_id: r.text for r in mixed}
    assert Counter(r.doc_id for r in last) == copies
    for r in last:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert pd.DataFrame(last).shape[0] == p.run(spark, sf).count()
