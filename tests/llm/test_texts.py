"""SimHash components, periodic runs and spelling variants against plain versions, and on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import periodic, registry, simhash, variants

LONG = "round and round it goes " * 6000
AWKWARD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "one two", "en"), (5, LONG, "en"), (6, "x" * 30000 + " " + "7" * 5000, "en"), (7, "The same text in two rows.", "en"), (7, "The same text in two rows.", "en"),
    (7, "Another text of that id, other than the first.", "en"), (8, "ÉCOLE Σας naïve école 中文 a\x0bb \x1c \xa0 c d ÀÉÎÕÜß", "fr"), (None, "no id here at all", "en"), (None, "THE SAME TEXT IN TWO ROWS.", "en"), (9, "la " * 50 + "end", "fr"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string")
    clash = ["fingerprint", "component_id", "node", "runs", "collapsed", "n_words", "word", "n", "form", "root", "key"]
    return docs.withColumns({c: F.lit("other") for c in clash}).withColumn("a.b", F.lit(1))


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# SimHash


def plain_fingerprint(t):
    words = words_of(lowered(t))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id by fingerprint: all pairs are compared."""
    distinct = sorted({f for _, f in prints})
    top = {f: f for f in distinct}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= 2:
            top[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {f: least.get(find(f)) for f in distinct}


def check_simhash(found, docs):
    prints = [(i, plain_fingerprint(t)) for i, t in docs]
    component = plain_components(prints)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == Counter((i, f"{f:016x}", component[f]) for i, f in prints)


def test_simhash(spark, sf, documents, awkward):
    check_simhash(registry.op11_simhash(spark, sf).collect(), documents)
    check_simhash(simhash.classes(awkward).collect(), [(i, t) for i, t, _ in AWKWARD])
    assert simhash.classes(awkward.where("false")).count() == 0
    assert simhash.classes(awkward.where("doc_id is null")).where("component_id is not null").count() == 0


def test_fingerprint_pieces(monkeypatch):
    text = " ".join(str(i * i % 977) for i in range(2000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


def test_chains():
    """Whatever two bits differ, some start passes every chain; three bits never link."""
    assert simhash.BUDGETS == [0, 0, 0, 1, 1, 1, 2] and sum(int(c).bit_count() for c in simhash.CHAINS[:, 0]) == 64
    for a, b in itertools.combinations(range(64), 2):
        diff = (1 << a) | (1 << b)
        assert any(all((diff & int(mask)).bit_count() <= budget for mask, budget in zip(row, simhash.BUDGETS)) for row in simhash.CHAINS)


@pytest.mark.parametrize("block", [384, 8])
def test_links_are_whole(spark, monkeypatch, block):
    """Fingerprints in crowded balls: every link counts, whatever the size of a block."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    draw = random.Random(3)
    centres = [draw.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    prints = set(centres)
    for c in centres:
        for _ in range(60):
            x = c
            for b in draw.sample(range(64), draw.randint(1, 5)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    component = plain_components([(i, f) for i, f in enumerate(prints)])
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in prints], "node long")
    edges = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(nodes).collect()]
    assert all((a ^ b).bit_count() >= 1 and component[a] == component[b] for a, b in edges)
    top = {f: f for f in prints}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        top[find(a)] = find(b)
    assert len({find(f) for f in prints}) == len(set(component.values()))


# Periodic runs


def plain_runs(w):
    """Every stretch, by its definition."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_periodic(i, t):
    w = words_of(t)
    h = zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    listed, kept = "".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for k, x in enumerate(w) if k not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha(listed), sha(kept))


def test_periodic(spark, sf, documents):
    found = {r.doc_id: tuple(r) for r in registry.op12_periodic(spark, sf).collect()}
    expected = {i: plain_periodic(i, t) for i, t in documents if len(words_of(t)) < 3000}
    assert {i: found[i] for i in expected} == expected and len(found) == len(documents)
    assert sum(r[1] > 0 for r in found.values()) > 10


def test_periodic_awkward(awkward):
    found = periodic.find(awkward, awkward.columns)
    assert {"lang", "a.b", "n_words", "runs", "collapsed"} <= set(found.columns)
    expected = Counter()
    for i, t, _ in AWKWARD:
        w = words_of(t)
        runs = [(0, len(w), 5)] if t == LONG else plain_runs(w)  # the plain version takes long over it
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        expected[i, len(w), tuple(runs), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in found.collect()) == expected
    assert periodic.find(awkward.where("false"), ["doc_id"]).count() == 0


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefgh"])
def test_runs_of_random_words(letters):
    draw = random.Random(len(letters))
    texts = []
    for _ in range(300):
        w = [draw.choice(letters) for _ in range(draw.randint(0, 30))]
        for _ in range(draw.randint(0, 2)):
            part = w[draw.randint(0, len(w)) :][: draw.randint(1, 7)]
            w += part * draw.randint(1, 9) + [draw.choice(letters) for _ in range(draw.randint(0, 3))]
        texts.append(w)
    coded = [periodic.coded(" ".join(w).encode())[0] for w in texts]
    assert periodic.runs_of(coded) == [plain_runs(w) for w in texts]


def test_runs_of_great_texts():
    """Many repeats of one word, of nested periods, and of a line between other words: near-linear work."""
    n = 200_000
    assert periodic.runs_of([np.zeros(n, np.int64)]) == [[(0, n, 1)]]
    nested = np.tile(np.append(np.tile([0, 1], 50), 2), 1000)
    runs = periodic.runs_of([nested])[0]
    assert runs[0] == (0, 101_000, 101) or (0, 101_000, 101) in runs
    assert len(runs) == 1001 and (101, 100, 2) in runs
    line = np.concatenate([np.append(np.arange(8), 100 + i) for i in range(20_000)])
    assert periodic.runs_of([line]) == [[]]


def test_pieces(monkeypatch):
    text = b"  some words \n and\tmore of " + b"y" * 50 + b" them  "
    monkeypatch.setattr(periodic, "PIECE", 5)
    codes, names = periodic.coded(text)
    assert [names[c] for c in codes] == text.split()


# Spelling variants


def plain_variants(docs):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    return counts, plain_near(counts)


def plain_near(counts):
    by_gap = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            by_gap[w[:k] + "\0" + w[k + 1 :]].add(w)
        for k in range(len(w) + 1):
            by_gap[w[:k] + "\0" + w[k:]].add(w)
    found = {}
    for w, n in counts.items():
        near = {o for k in range(len(w)) for o in by_gap[w[:k] + "\0" + w[k + 1 :]]} | {o for k in range(len(w) + 1) for o in by_gap[w[:k] + "\0" + w[k:]]}
        near = {o for o in near - {w} if abs(len(o) - len(w)) <= 1}
        best = min(near, key=lambda o: (-counts[o], o), default=None)
        found[w] = (len(near), best if best and counts[best] >= 5 * n else None)
    return found


def check_variants(rows, counts, near):
    expected = {}
    for w, n in counts.items():
        root = w
        while near[root][1]:
            root = near[root][1]
        form = near[w][1]
        expected[w] = (form, root, n, near[w][0], counts.get(form))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == expected and len(rows) == len(expected)


def test_variants(spark, sf, documents):
    counts, near = plain_variants(documents)
    rows = registry.op13_variants(spark, sf).collect()
    check_variants(rows, counts, near)
    assert sum(r.form is not None for r in rows) > 5


def test_variants_awkward(spark, awkward):
    many = awkward.union(awkward).union(awkward)
    counts, near = plain_variants([(i, t) for i, t, _ in AWKWARD * 3])
    check_variants(variants.variants(variants.counted(many, variants.one_left_out(199))).collect(), counts, near)
    assert "x" * 30000 not in counts and variants.counted(awkward.where("false")).count() == 0
    none = variants.variants(variants.counted(awkward.where("false")))
    assert none.columns == ["word", "n", "n_near", "form", "form_n", "root"] and none.count() == 0


@pytest.mark.parametrize("size", [1 << 26, 64])
def test_near_words(spark, monkeypatch, size):
    """Edits at every place, chains of forms, ties, long words; also with filters so full that they let all through."""
    monkeypatch.setattr(variants, "FILTER_BYTES", size)
    monkeypatch.setattr(variants, "PROBES", 500)
    draw = random.Random(5)
    counts = {}
    for w in ["abcdefgh", "aaaaaaaa", "éàüößç", "z" * 70, "letters" * 12, "balloon", "ÀÈÌÒÙÂ"]:
        counts[w] = 10 ** draw.randint(2, 6)
        for _ in range(25):
            x = list(draw.choice([w, *list(counts)[-5:]]))
            for _ in range(draw.randint(1, 2)):
                k = draw.randrange(len(x))
                x[k : k + 1] = draw.choice([[], [x[k], draw.choice("aezéÿ")], [draw.choice("abzé÷")]])
            if len(x) >= 6:
                counts.setdefault("".join(x), 5 * 5 ** draw.randint(0, 6))
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    near = plain_near(counts)
    check_variants(variants.variants(words).collect(), counts, near)
    assert sum(n for n, _ in near.values()) > 100
