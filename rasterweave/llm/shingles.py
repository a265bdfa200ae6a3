"""Sets of hashed word shingles of whole texts, in vectorised steps."""

from __future__ import annotations

import numpy as np

#: Groups of the count vector.
GROUPS = 512
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _BACK)):
            run = np.full(m, base, np.uint64)
            run[0] = 1
            _powers[i] = np.multiply.accumulate(run)
    return _powers


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash a word, A-Z lower-cased; blocks end between words."""
    out, at = [], 0
    while at < len(text):
        b = np.frombuffer(text, np.uint8, min(_BLOCK, len(text) - at), at)
        space = _SPACE[b]
        if at + len(b) < len(text) and not space[-1]:
            last = np.flatnonzero(space)
            if len(last):
                b, space = b[: last[-1] + 1], space[: last[-1] + 1]
            else:  # one word longer than a block
                b = np.frombuffer(text, np.uint8, len(text) - at, at)
                space = _SPACE[b]
        at += len(b)
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(start):
            up, down = _power(len(b) + 1)
            total = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(_VALUE[_LOWER[b]] * up[: len(b)], out=total[1:])
            out.append(mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence where
    it is shorter; none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    return np.unique(_hashed(w, min(k, len(w))))


def fingerprint(tokens: np.ndarray) -> int:
    """64 signed bits of a set: equal sets agree; others differ but for a chance
    of 2**-64 a pair."""
    return int(mix(np.array([mix(tokens ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + _U(len(tokens))], np.uint64)).view(np.int64)[0])


def _hashed(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words."""
    h = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        h = h * _U(0xD6E8FEB86659FD93) + words[i : len(words) - size + 1 + i]
    return mix(h)


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """shingle_set() of each text; short texts are hashed together, block by block."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) < _BLOCK // 8:
            size += len(texts[end]) + 1
            end += 1
        if end == at:
            out.append(shingle_set(texts[at], k))
            at += 1
            continue
        out += _block_sets(texts[at:end], k)
        at = end
    return out


def _block_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    # A blank between two texts keeps their words apart.
    b = np.frombuffer(b" ".join(texts), np.uint8)
    if not len(b):
        return [np.zeros(0, np.uint64)] * len(texts)
    space = _SPACE[b]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUE[_LOWER[b]] * up[: len(b)], out=total[1:])
    words = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    # Words of text i are first[i] up to first[i + 1].
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    runs = _hashed(words, k) if len(words) >= k else words[:0]
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= k:
            h = np.sort(runs[a : z - k + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        else:
            out.append(_hashed(words[a:z], z - a) if z > a else words[:0])
    return out


def fingerprints(sets: list[np.ndarray]) -> list[int | None]:
    """fingerprint() of each set; None of empty ones."""
    sizes = np.array([len(t) for t in sets], np.int64)
    full = np.flatnonzero(sizes)
    out: list[int | None] = [None] * len(sets)
    if len(full):
        flat = mix(np.concatenate([sets[i] for i in full]) ^ _U(0xA5A5A5A5A5A5A5A5))
        sums = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes[full])[:-1]])) + sizes[full].astype(np.uint64)
        for i, fp in zip(full.tolist(), mix(sums).view(np.int64).tolist(), strict=True):
            out[i] = fp
    return out


def count_vector(tokens: np.ndarray) -> np.ndarray:
    """How many tokens fall in each of GROUPS groups, in 16 bits.  A set too large
    for these is at the maximum everywhere, so that its bound never excludes."""
    counts = np.bincount((tokens >> _U(20)).astype(np.int64) & (GROUPS - 1), minlength=GROUPS)
    if counts.max(initial=0) > 65535:
        counts = np.full(GROUPS, 65535)
    return counts.astype(np.uint16)
