"""Word shingles of many texts at once, in numpy.

A word is a maximal run of letters, digits, underscores and characters above
ASCII in the lower-cased text (``WORD`` as an expression). Words and shingles
are known by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A word as a regular expression over the lower-cased text.
WORD = r"[0-9a-z_\x80-\U0010ffff]+"
SIZE = 5
#: Bytes that are hashed at once.
PIECE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True
_POWERS: dict[str, np.ndarray] = {}


def slices(texts: list[str | None], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """(first, last) of neighbouring texts of ``most`` characters together, or of one that is longer.

    What is held for a slice does not grow with the lengths that a batch happens to have.
    """
    first, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "") + 1
        if i > first and held + size > most:
            yield first, i
            first, held = i, 0
        held += size
    if texts:
        yield first, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd base, and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE + (1 << 16))
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def running(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash of bytes: one more than there are bytes."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the hashes of all words in order, and how many each text has."""
    hashes, counts, at = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64), 0
    raw = [("" if t is None else t).lower().encode("utf-8", "surrogatepass") for t in texts]
    while at < len(raw):
        held, upto = 0, at
        while upto < len(raw) and (upto == at or held + len(raw[upto]) < PIECE):
            held += len(raw[upto]) + 1
            upto += 1
        data = np.frombuffer(b"\n".join(raw[at:upto]) + b"\n", np.uint8)
        inside = _IS_WORD[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.r_[0, edge]
        start, end = edge[::2], edge[1::2]  # the last byte is no word's
        sums, (_, down) = running(data), powers(len(data))
        h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        hashes.append(h)
        bounds = np.cumsum([len(r) + 1 for r in raw[at:upto]])
        counts[at:upto] = np.diff(np.searchsorted(start, bounds), prepend=0)
        at = upto
    return np.concatenate(hashes), counts


def shingle_hashes(texts: list[str | None], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): all shingles of ``size`` words in order, and how many each text has.

    A text of fewer words, but one at least, has one shingle of them all.
    """
    words, counts = word_hashes(texts)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ends = np.cumsum(counts)
    first = np.repeat(ends - counts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    length = np.repeat(np.minimum(counts, size), n)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    out = length.astype(np.uint64)
    for k in range(size):
        out = mix(out ^ np.where(k < length, padded[first + k], np.uint64(0)))
    return out, n


def bags(texts: list[str | None], size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, weights, counts): each text's distinct shingles, sorted, with how often each occurs, and how many are distinct."""
    h, n = shingle_hashes(texts, size)
    doc = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    weights = np.diff(np.r_[at, len(h)])
    return h[at], weights, np.bincount(doc[at], minlength=len(texts))
