"""BagMinHash signatures of weighted sets, many sets at once, in numpy.

A weight w of an element stands for the stretch [0, w) of a line on which a
Poisson process in time drops points. Each point belongs to one of m registers,
which keeps the earliest of its points. Two sets agree in a register exactly if
the same point is the earliest of both, so the share of agreeing registers is
an unbiased estimate of the weighted Jaccard similarity.

The line is discretised at the integers and parted into blocks [0, 1), [1, 2),
[2, 4), [4, 8) and so on; a block's process runs at the rate of its length.
Blocks inside the weight are taken whole; the one that the weight cuts is split
further by the place of each point, so its process is the same whatever the
weight. Points are made in the order of time and only up to a time by which all
registers are full, so a set costs about m log m points besides one for each
element and block.
"""

from __future__ import annotations

import numpy as np

from .shingles import mix

_G = np.uint64(0x9E3779B97F4A7C15)


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from 64 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, m: int, seed: int = 1) -> np.ndarray:
    """uint64 (sets, m): the registers, as the bits of the times; sets without elements have all bits set.

    ``elements`` are 64-bit hashes and ``weights`` positive integers; ``counts``
    says how many of them each set has, one set after another.
    """
    sets = len(counts)
    owner = np.repeat(np.arange(sets), counts)
    best = np.full(sets * m, np.inf)
    # blocks of each element: 1 + the number of bits of (weight - 1)
    weights = np.asarray(weights, np.int64)
    blocks = np.zeros(len(weights), np.int64)
    rest = weights - 1
    while rest.any():
        blocks += rest > 0
        rest >>= 1
    each = np.repeat(np.arange(len(weights)), blocks + 1)
    level = np.arange(len(each)) - np.repeat(np.cumsum(blocks + 1) - (blocks + 1), blocks + 1)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    rate = np.maximum(low, 1).astype(np.float64)
    inside = (weights[each] - low).astype(np.float64) / rate  # the part of the block below the weight, 1 or more if whole
    of = owner[each]
    state = mix(elements[each] + _G * (np.uint64(seed) * np.uint64(1 << 20) + level.astype(np.uint64) + np.uint64(1)))
    mass = np.maximum(np.bincount(owner, weights=weights, minlength=sets), 1.0)
    limit = m * (np.log(m) + 3.0) / mass
    time = np.zeros(len(each))
    pending = np.arange(len(each))
    todo = np.asarray(counts) > 0
    waiting = pending  # processes whose next point lies beyond their set's limit, each with that point's time
    fresh = True
    while True:
        live = waiting
        if fresh:  # the first point of each process
            state[live] = mix(state[live] + _G)
            time[live] -= np.log(_uniform(state[live])) / rate[live]
            fresh = False
        beyond = []
        while len(live):
            late = time[live] > limit[of[live]]
            beyond.append(live[late])
            live = live[~late]
            if not len(live):
                break
            point = mix(state[live] ^ np.uint64(0xA0761D6478BD642F))
            taken = _uniform(mix(point + _G)) <= inside[live]
            hit = live[taken]
            np.minimum.at(best, of[hit] * m + (point[taken] % np.uint64(m)).astype(np.int64), time[hit])
            state[live] = mix(state[live] + _G)
            time[live] -= np.log(_uniform(state[live])) / rate[live]
        waiting = np.concatenate(beyond) if beyond else np.empty(0, np.int64)
        short = todo & (best.reshape(sets, m).max(axis=1) > limit)
        if not short.any():
            break
        limit = np.where(short, limit * 1.5, limit)
        waiting = waiting[short[of[waiting]]]
    best[np.isinf(best)] = np.nan
    bits = best.view(np.uint64)
    bits[np.isnan(best)] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return bits.reshape(sets, m)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int64 (sets, bands): a hash of each band of registers; bands differ even where their registers don't."""
    cut = registers[:, : bands * rows].reshape(len(registers), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _G, cut.shape[:2]).copy()
    for k in range(rows):
        out = mix(out ^ cut[:, :, k])
    return out.view(np.int64)
