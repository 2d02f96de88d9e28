"""Removal of repeats against counting every string."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rostrum.llm import dedup, suffixes


def brute(texts, length):
    """(bytes, removed, spans, digest) of each text."""
    raw = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if times[r[i : i + length]] > 1:
                gone[i : i + length] = True
        starts = int((np.diff(np.r_[0, gone.view(np.int8)]) == 1).sum())
        out.append((len(r), int(gone.sum()), starts, hashlib.sha256(bytes(b for b, g in zip(r, gone[:-1], strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "options"), [(60, {}), (60, {"shard": 3000}), (45, {"shard": 3000, "most_runs": 2}), (200, {"shard": 1})])
def test_matches_brute_force(docs, clash, length, options):
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(zip([str(d) for d, _ in pairs], brute([t for _, t in pairs], length), strict=True))
    got = dedup.deduplicated(clash(docs), length, **options).collect()
    got = sorted((str(r["doc_id"]), (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest())) for r in got)
    assert got == want
    assert any(w[1][1] for w in want)


def test_no_rows(no_docs):
    assert dedup.deduplicated(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=120), st.integers(1, 12))
def test_suffix_array_and_prefixes(data, depth):
    data = np.frombuffer(bytes(b % 3 for b in data) * 2, np.uint8)
    order = suffixes.suffix_array(data)
    assert list(order) == sorted(range(len(data)), key=lambda i: data[i:].tobytes())
    shared = suffixes.common_prefixes(data, order, depth, lane=16)
    for a, b in zip(order[:-1], order[1:], strict=True):
        n = 0
        while n < depth and max(a, b) + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        assert shared[b] == n


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=20, max_size=150))
def test_equal_strings_have_equal_anchors(data):
    data = np.frombuffer(bytes(b % 4 for b in data) * 2, np.uint8)
    least, at = suffixes.anchors(data, 20, 5)
    seen: dict = {}
    for i, h in enumerate(least):
        assert seen.setdefault(data[i : i + 20].tobytes(), h) == h
        assert h in at


def test_merged_intervals():
    a, b = suffixes.merged(np.array([5, 0, 9]), np.array([7, 5, 12]))
    assert (a.tolist(), b.tolist()) == ([0, 9], [7, 12])
