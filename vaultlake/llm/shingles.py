"""Word-shingle sets of texts as sorted arrays of 64-bit hashes, computed with numpy on whole texts."""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
_rng = np.random.default_rng(20240517)
_odd = np.uint64(1)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + _odd
_PLACE = _rng.integers(1, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + _odd
_FAR = np.uint64(0x9E3779B97F4A7C15)
_ORDER = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + _odd
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """One hash per whitespace-separated word.  A word's hash is a sum over its bytes, weighted by
    place, so the text is taken in blocks and a word may go over from one block to the next."""
    out: list[np.ndarray] = []
    began = -1  # where the word that goes over from the block before has begun
    for at in range(0, len(data), BLOCK):
        raw = np.frombuffer(data, dtype=np.uint8, count=min(BLOCK, len(data) - at), offset=at)
        word = ~_SPACE[raw]
        starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
        inside = np.flatnonzero(word)
        if not len(inside):
            began = -1
            continue
        over = began >= 0 and bool(word[0])
        first = starts + at
        if over:
            first[0] = began
        lengths = np.diff(np.append(np.searchsorted(inside, starts), len(inside)))
        place = inside + at - np.repeat(first, lengths)
        weight = _PLACE[place & 0xFFFF]
        if place.max() > 0xFFFF:
            weight = weight ^ ((place >> 16).astype(np.uint64) * _FAR << _odd)
        sums = np.add.reduceat(_BYTE[raw[inside]] * weight, np.searchsorted(inside, starts))
        if over:
            out[-1][-1:] += sums[:1]
            sums = sums[1:]
        if len(sums):
            out.append(sums)
        began = int(first[-1]) if word[-1] else -1
    return mix(np.concatenate(out)) if out else np.empty(0, dtype=np.uint64)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; fewer words count as one whole run."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    total = words[: n - k + 1] * _ORDER[0]
    for j in range(1, k):
        total += words[j : n - k + 1 + j] * _ORDER[j]
    return np.unique(mix(total + np.uint64(k)))


def text_shingles(text: str | None, size: int) -> np.ndarray:
    """Shingle set of a text whose letters A-Z are lower-cased (bytes.lower changes only those)."""
    return shingle_set(word_hashes((text or "").encode("utf-8", "surrogatepass").lower()), size)
