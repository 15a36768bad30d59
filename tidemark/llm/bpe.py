"""BPE encoding and decoding: speculate, verify, and merge only what fails.

For each new word a greedy longest match proposes tokens. A sequence of tokens is what BPE
would produce exactly when every adjacent pair is compatible, that is, when merging the
text of the two alone would never cross their border. All pairs of a batch are tested at
once with numpy, by undoing the merges that formed them, latest first, and asking whether
an earlier merge across the border exists. Words with an incompatible pair go through exact
merging.

Results equal those of the ``tokenizers`` library for vocabularies with NFC, lower-casing,
a byte alphabet and an end-of-word suffix, whose pattern splits at blanks; characters that were
assigned after Unicode 15.1 may be cut otherwise. The vocabulary file is read on the driver and
broadcast: its size does not depend on the data.

Defined results: a null text is encoded as the empty text; an empty text has no ids and
decodes to the empty text; repeated rows are encoded alike; columns named as those that
the operator adds are replaced.
"""

from __future__ import annotations

import heapq
import json
import string
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_texts, worker_cache

#: Bytes that a generation of a worker's memory of chunks, and of words, may take.
CHUNK_BYTES, WORD_BYTES = 20 << 20, 16 << 20
#: About how many bytes of text are looked up together.
GROUP_BYTES = 1 << 20
#: Words of at most so many symbols are merged by scanning; longer ones with a heap.
SHORT = 100
_NONE = np.iinfo(np.int64).max
_END = ""


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Memory:
    """What was computed for a key, within a bound of bytes.

    New entries go to the young generation, and so do old ones when they are asked for. When the
    young one is full it becomes the old one, whose entries are forgotten: frequent keys stay.
    """

    #: About what two short byte strings and their place in a dictionary take besides their content.
    ENTRY = 170

    def __init__(self, most: int):
        self.most, self.size = most, 0
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> set:
        """The keys that neither generation knows; those of the old one become young."""
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        new = keys - self.young.keys()
        known = new & self.old.keys()
        self.add({k: self.old[k] for k in known})
        return new - known

    def add(self, made: dict) -> None:
        self.young |= made
        self.size += sum(map(len, made)) + sum(map(len, made.values())) + self.ENTRY * len(made)


class Vocabulary:
    """Tables of one vocabulary. Inside, tokens are numbered in the order they are formed."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model = spec["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        self.byte = byte_alphabet()
        names = [*self.byte, *(c + suffix for c in self.byte)]
        number = {name: i for i, name in enumerate(names)}
        shown = [*self.byte, *(c + _END for c in self.byte)]
        left, right, keys = list(range(512)), list(range(512)), []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = number[a], number[b]
            if a + b in number:
                raise ValueError(f"two merges form {a + b!r}")
            keys.append((x, y))
            number[a + b] = len(names)
            names.append(a + b)
            shown.append(shown[x] + shown[y])
            left.append(x)
            right.append(y)
        self.left, self.right = np.array(left), np.array(right)
        self.id = np.array([vocab[n] for n in names], np.uint32)
        self.pair = {k: 512 + i for i, k in enumerate(keys)}
        packed = np.array([x << 32 | y for x, y in keys], np.int64)
        order = np.argsort(packed)
        self.keys, self.made = packed[order], order + 512
        sound = np.ones(len(names), bool)
        sound[512:] = self.compatible(self.left[512:], self.right[512:], np.arange(512, len(names)))
        self.proposals = {shown[i]: i for i in np.flatnonzero(sound)}
        #: The length of the longest proposal for each pair of first characters.
        self.longest: dict[str, int] = {}
        for name in self.proposals:
            self.longest[name[:2]] = max(len(name), self.longest.get(name[:2], 1))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        token = {i: name for name, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.shown = pa.array([token.get(i) for i in range(max(token) + 1)], pa.string())
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern, regex.V0)
        letters = string.ascii_lowercase
        self.letters_stay = all(self.words.findall(x) == [x] for x in (letters, letters[::-1], *letters, *(letters[i:] + letters[:i] for i in range(26))))
        self.chunk_memory, self.word_memory = Memory(CHUNK_BYTES), Memory(WORD_BYTES)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border of each pair; ``before``: none earlier than that."""
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        bound = np.full(len(a), _NONE) if before is None else before.astype(np.int64)
        while len(live):
            crossed = self.merged(a, b) < bound
            out[live[crossed]] = False
            a, b, live = a[~crossed], b[~crossed], live[~crossed]
            # Undo the later of the two last merges; at equal rank the left one came first.
            undo_left = ((a > b) | (b < 512)) & (a >= 512)
            undo_right = ~undo_left & (b >= 512)
            bound = np.where(undo_left, a, b + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_right, self.left[b], b)
            go_on = undo_left | undo_right
            a, b, bound, live = a[go_on], b[go_on], bound[go_on], live[go_on]
        return out

    def propose(self, word: str) -> list[int]:
        out, i, n, known, longest = [], 0, len(word), self.proposals, self.longest
        while i < n:
            j = min(n, i + longest.get(word[i : i + 2], 1))
            while True:
                # The last character and the end of the word are one symbol.
                if j != n - 1 and (t := known.get(word[i:j])) is not None:
                    break
                j -= 1
            out.append(t)
            i = j
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging: the earliest merge first, from left to right."""
        symbols = [self.proposals[c] for c in word[:-2]] + [self.proposals[word[-2:]]]
        if len(symbols) <= SHORT:
            find = self.pair.get
            made = [find(p, _NONE) for p in zip(symbols, symbols[1:])]
            while made and (m := min(made)) != _NONE:
                i = made.index(m)
                symbols[i : i + 2] = [m]
                del made[i]
                if i < len(made):
                    made[i] = find((m, symbols[i + 1]), _NONE)
                if i:
                    made[i - 1] = find((symbols[i - 1], m), _NONE)
            return symbols
        after, ahead = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap = [(m, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (m := self.pair.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            made, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= len(symbols) or symbols[j] != b:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[i] < len(symbols):
                ahead[after[i]] = i
            for x, y in ((ahead[i], i), (i, after[i])):
                if x >= 0 and y < len(symbols) and (m := self.pair.get((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (m, x, symbols[x], symbols[y]))
        return [s for s in symbols if s >= 0]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The packed ids of distinct words."""
        if not words:
            return {}
        proposed = [self.propose(w) for w in words]
        sizes = np.array([len(p) for p in proposed])
        flat = np.array([t for p in proposed for t in p], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        for i in np.unique(owner[inner[~fine]]).tolist():
            proposed[i] = self.merge(words[i])
        ends = np.cumsum([4 * len(p) for p in proposed]).tolist()
        packed = self.id[np.array([t for p in proposed for t in p], np.int64)].tobytes()
        return {w: packed[a:b] for w, a, b in zip(words, [0, *ends], ends)}

    def pieces(self, chunk: str) -> list[str | int]:
        """The words of a chunk in the byte alphabet, and the ids of special tokens."""
        if self.letters_stay and chunk.isascii() and chunk.isalpha():
            return [chunk.lower() + _END]
        out: list[str | int] = []
        for part in self.split_special.split(chunk) if self.split_special and "<" in chunk else [chunk]:
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
                # One character at a time: no rule that looks at neighbours.
                part = "".join(map(str.lower, part)) if "Σ" in part else part.lower()
            else:
                part = part.lower()
            for word in self.words.findall(part):
                if word.isascii():
                    out.append(word + _END if word.isprintable() else "".join(self.byte[b] for b in word.encode()) + _END)
                else:
                    out.append("".join(self.byte[b] for b in word.encode("utf-8", "surrogatepass")) + _END)
        return out

    def lookup(self, chunks: list[str]) -> list[bytes]:
        """The packed ids of distinct chunks, which hold no ASCII blanks."""
        new = self.chunk_memory.missing(set(chunks))
        if new:
            cut = {c: self.pieces(c) for c in new}
            words = {p for ps in cut.values() for p in ps if isinstance(p, str)}
            self.word_memory.add(self.encode_words(list(self.word_memory.missing(words))))
            packed = self.word_memory.young
            self.chunk_memory.add({c: b"".join([packed[p] if isinstance(p, str) else np.uint32(p).tobytes() for p in ps]) for c, ps in cut.items()})
        return [self.chunk_memory.young[c] for c in chunks]

    def encode(self, texts: pa.Array) -> pa.Array:
        """The packed ids of each text. Only distinct chunks become Python objects."""
        split = pc.ascii_split_whitespace(texts)
        flat = split.values.dictionary_encode()
        packed = pa.array(self.lookup(flat.dictionary.to_pylist()), pa.binary())
        return pc.binary_join(pa.ListArray.from_arrays(split.offsets, packed.take(flat.indices)), b"")

    def decode(self, ids: pa.Array) -> pa.Array:
        """The tokens of each text with a space between them, as the library does where no decoder is set."""
        flat = np.frombuffer(b"".join(ids.to_pylist()), "<u4")
        ends = np.cumsum([0, *(np.asarray(pc.binary_length(ids)) // 4)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), self.shown.take(pa.array(flat))), " ")


def _vocabulary(shared) -> Vocabulary:
    loaded, source = worker_cache("bpe"), shared.value
    key = hash(source)
    if key not in loaded:
        loaded.clear()
        loaded[key] = Vocabulary(source)
    return loaded[key]


def encode(docs: DataFrame, vocabulary: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers) and ``decoded``.

    One pass without a shuffle. All rows, and the columns of ``keep`` (all but the text if
    not given), are kept.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(texts: pa.Array) -> list:
        v = _vocabulary(shared)
        ids = v.encode(texts)
        return [pc.divide(pc.binary_length(ids), 4).cast(pa.int64()), ids, v.decode(ids)]

    keep = [c for c in docs.columns if c != text] if keep is None else keep
    return map_texts(docs, keep, {"n_tokens": "long", "ids": "binary", "decoded": "string"}, run, text, GROUP_BYTES, arrow=True, operator="bpe")


def digests(encoded: DataFrame) -> DataFrame:
    """Digest columns of what ``encode`` returns."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
