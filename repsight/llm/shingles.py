"""Sets of hashed word shingles of whole texts, in numpy.

Words are runs without space or U+0009..U+000D, A-Z lower-cased. A word's hash
is a polynomial over its bytes, a shingle's a mix of its words' hashes; both
have 64 bits. Texts are read in segments cut at white space, so the working
memory doesn't grow with the text (its word hashes do, with 8 bytes a word).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

SEGMENT_BYTES = 1 << 20
_rng = np.random.default_rng(50_153)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1
_PLACE = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, _BASE, np.uint64))), dtype=np.uint64)


def word_hashes(text: str) -> np.ndarray:
    """The hashes of the words of a text, in order."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + SEGMENT_BYTES)
        while end < len(data) and not _SPACE[data[end]]:
            gap = np.flatnonzero(_SPACE[data[end : end + SEGMENT_BYTES]])
            end = end + int(gap[0]) if len(gap) else min(len(data), end + SEGMENT_BYTES)
        part = data[at:end]
        inside = ~_SPACE[part]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, stops = edge[::2], edge[1::2]
        if len(starts):
            lengths = stops - starts
            chars = part[inside]
            first = np.cumsum(lengths) - lengths
            place = np.arange(len(chars)) - np.repeat(first, lengths)
            powers = _powers(max(1024, 1 << int(lengths.max()).bit_length()))
            out.append(mix(np.add.reduceat(_BYTE[chars] * powers[place], first)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """The distinct hashed ``n``-word shingles, ascending; the whole sequence as one when there are fewer words."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    k = min(n, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        total = total + words[j : len(words) - k + 1 + j] * _PLACE[j]
    return np.unique(mix(total))


def digests(tokens: np.ndarray, salt: int) -> tuple[int, int]:
    """Two signed 64-bit digests of a set."""
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
