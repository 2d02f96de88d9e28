"""Suffix arrays of byte strings in numpy, and what repeats in them."""

from __future__ import annotations

import numpy as np

from .shingles import mix, powers, running


def heads(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one big-endian number, zeros past the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)].astype(np.uint64)
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order, by the refinement of Larsson and Sadakane.

    Suffixes are sorted by their first eight bytes; then, with h = 8, 16, 32
    and so on, each group that still ties is sorted by the groups of the
    suffixes h further on. Groups of one are done and are not looked at again.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    key = heads(data)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank = np.empty(n + 1, np.int64)  # one more for the empty suffix, which sorts first
    rank[n] = 0
    place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = place + 1
    # zeros past the end may tie with zero bytes inside: the refinement tells them apart from h = 1 on
    h = 8 if n <= 8 or data[-1] else 1
    if h == 1:
        order = np.argsort(data, kind="stable")
        new = np.r_[True, data[order][1:] != data[order][:-1]]
        place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = place + 1
    elif n <= 8:
        return np.array(sorted(range(n), key=lambda i: data[i:].tobytes()), np.int64)
    tied = ~(new & np.r_[new[1:], True])
    slots = np.flatnonzero(tied)
    while len(slots):
        active = order[slots]
        pair = rank[active] * (n + 2) + rank[np.minimum(active + h, n)]
        sort = np.argsort(pair)
        active, pair = active[sort], pair[sort]
        order[slots] = active  # groups lie together and keep their slots
        new = np.r_[True, pair[1:] != pair[:-1]]
        rank[active] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))] + 1
        slots = slots[~(new & np.r_[new[1:], True])]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int, lane: int = 256) -> np.ndarray:
    """For each position how many bytes, up to ``depth``, its suffix shares with the one before it in ``order``.

    By the method of Kasai and others: going through the text, a position's
    value is at least the last one's less one, and only what is more is
    compared. The text is cut into lanes of ``lane`` positions which all go
    at once.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    key = np.concatenate([heads(data), np.zeros(1, np.uint64)])
    out = np.zeros(n, np.int64)
    starts = np.arange(0, n, lane)
    held = np.zeros(len(starts), np.int64)
    for step in range(min(lane, n)):
        at = starts + step
        at = at[at < n]
        with_ = before[at]
        shared = np.maximum(held[: len(at)] - 1, 0)
        going = np.flatnonzero(with_ >= 0)
        shared[with_ < 0] = 0
        while len(going):
            i, j = at[going] + shared[going], with_[going] + shared[going]
            room = n - np.maximum(i, j)
            differ = key[np.minimum(i, n)] ^ key[np.minimum(j, n)]
            more = np.full(len(going), 8)
            unlike = differ != 0
            # the leading zero bytes of what differs
            bits = np.frexp(differ[unlike].astype(np.float64))[1]
            lead = (64 - bits) // 8
            # a number close below a power of two is rounded up to it
            wrong = (bits > 8) & ((differ[unlike] >> np.maximum(bits - 1, 0).astype(np.uint64)) == 0)
            more[unlike] = np.where(wrong, (65 - bits) // 8, lead)
            more = np.minimum(more, np.maximum(room, 0))
            shared[going] += more
            going = going[(more == 8) & (shared[going] < depth)]
        held[: len(at)] = np.minimum(shared, depth)
        out[at] = held[: len(at)]
    return out


def repeated_starts(data: np.ndarray, length: int) -> np.ndarray:
    """A mask of the positions whose ``length`` bytes start at another position too."""
    out = np.zeros(len(data), bool)
    if len(data) > length:
        order = suffix_array(data)
        like = common_prefixes(data, order, length)[order] >= length
        out[order[like]] = True
        out[order[:-1][like[1:]]] = True
    return out


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """The hash of each ``width`` bytes, of the prefix sums by ``running``."""
    n = len(sums) - width
    if n <= 0:
        return np.empty(0, np.uint64)
    _, down = powers(n)
    return mix((sums[width:] - sums[:-width]) * down)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, in three passes whatever the width."""
    m = len(values)
    if m < width:
        return np.empty(0, values.dtype)
    padded = np.full(-(-m // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:m] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: m - width + 1], ahead[width - 1 : m])


def anchors(data: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, at): of each ``length`` bytes the least hash of ``width`` bytes inside, and the hashes at all positions that are the least of some.

    Equal strings have the same least hash, wherever they lie.
    """
    if len(data) < length:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = window_hashes(running(data), width)
    span = length - width + 1
    least = sliding_min(h, span)
    # a position is one if the greatest of the minima around it is its own hash
    pad = np.full(span - 1, np.uint64(0xFFFFFFFFFFFFFFFF))
    greatest = ~sliding_min(np.concatenate([pad, ~least, pad]), span)
    return least, h[h == greatest]


def intervals(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, exclusive, of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals; those that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > reach[:-1]]
    return starts[new], np.r_[reach[:-1][new[1:]], reach[-1]]
