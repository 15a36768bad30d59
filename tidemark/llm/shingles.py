"""Word shingles and MinHash signatures, computed with numpy inside tasks.

Words are runs of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased
text; everything else separates them. A shingle is ``SHINGLE`` consecutive words. A text of
fewer words is one shingle of all its words; a text without words is one shingle of its raw
characters, and an empty or null text has none.

Word hashes come from prefix sums of a keyed polynomial, so no Python object is made per
word; every array covers at most ``CHUNK`` bytes of text, whatever a document's length.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
CHUNK = 1 << 18

_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)
_MULT = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _word_bytes() -> np.ndarray:
    keep = np.zeros(256, bool)
    keep[ord("0") : ord("9") + 1] = True
    keep[ord("a") : ord("z") + 1] = True
    keep[128:] = True
    return keep


_KEEP = _word_bytes()
_CODE = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = _U(pow(int(_PRIME), -1, 1 << 64))
    up, down = np.full(n, _PRIME), np.full(n, inverse)
    up[0] = down[0] = _U(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(2 * CHUNK)


def _hash_words(raw: np.ndarray) -> np.ndarray:
    kept = _KEEP[raw]
    first = kept.copy()
    first[1:] &= ~kept[:-1]
    body = raw[kept]
    if not len(body):
        return np.zeros(0, np.uint64)
    at = (np.cumsum(kept) - 1)[first]
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_CODE[body] * _UP[: len(body)], out=sums[1:])
    ends = np.append(at[1:], len(body))
    return mix((sums[ends] - sums[at]) * _DOWN[at] + (ends - at).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash for each word of the text, in order."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= CHUNK:
        return _hash_words(raw)
    parts, start = [], 0
    while start < len(raw):
        end = min(start + CHUNK, len(raw))
        if end < len(raw):
            breaks = np.flatnonzero(~_KEEP[raw[start:end]])
            if len(breaks):
                end = start + int(breaks[-1]) + 1
            else:  # one word longer than a chunk: hashed in pieces, alike wherever it occurs
                more = np.flatnonzero(~_KEEP[raw[end:]])
                stop = end + int(more[0]) if len(more) else len(raw)
                pieces = [_hash_words(raw[i : min(i + CHUNK, stop)]) for i in range(start, stop, CHUNK)]
                parts.append(mix(np.array([np.bitwise_xor.reduce(mix(np.concatenate(pieces) + np.arange(len(pieces), dtype=np.uint64)))])))
                start = stop
                continue
        parts.append(_hash_words(raw[start:end]))
        start = end
    return np.concatenate(parts)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    if not text:
        return np.zeros(0, np.uint64)
    words = word_hashes(text)
    if not len(words):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        out = _U(len(raw))
        for i in range(0, len(raw), CHUNK):
            part = raw[i : i + CHUNK]
            out = mix(np.array([out * _MULT + (_CODE[part] * _UP[: len(part)]).sum(dtype=np.uint64)]))[0]
        return np.array([out], np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(words))):
        out = out * _MULT + words[i : i + n]
    return np.unique(mix(out + _U(min(SHINGLE, len(words)))))


class MinHash:
    """``n`` 32-bit MinHash values of a shingle set; equal seeds give equal functions."""

    def __init__(self, n: int = 128, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.n = n
        self.factor = (rng.integers(0, 1 << 31, n, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.mask = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of ``n`` values for each set; empty sets get the largest value throughout."""
        out = np.full((len(sets), self.n), np.iinfo(np.uint32).max, np.uint32)
        rows = [i for i, s in enumerate(sets) if len(s)]
        start = 0
        while start < len(rows):  # about 2**15 shingles at a time stay in cache
            stop, size = start, 0
            while stop < len(rows) and (stop == start or size + len(sets[rows[stop]]) <= 1 << 15):
                size += len(sets[rows[stop]])
                stop += 1
            part = [sets[i] for i in rows[start:stop]]
            flat = np.concatenate(part)
            flat = (flat ^ (flat >> _U(32))).astype(np.uint32)
            at = np.cumsum([0] + [len(s) for s in part[:-1]])
            for k in range(self.n):
                h = (flat ^ self.mask[k]) * self.factor[k]
                h ^= h >> np.uint32(15)
                out[rows[start:stop], k] = np.minimum.reduceat(h, at)
            start = stop
        return out
