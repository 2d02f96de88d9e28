import zlib
from collections import Counter

import numpy as np
import pytest
from cases import prose

from rostrum.llm import packing
from rostrum.llm.queries import tokenizer_path


def best_fit_decreasing(histogram):
    """Sequences that best fit takes when lengths come longest first."""
    most = len(histogram) - 1
    open_, n = Counter(), 0
    for length in range(most, 0, -1):
        for _ in range(int(histogram[length])):
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                n, room = n + 1, most
            else:
                open_[room] -= 1
                open_ += Counter()
            open_[room - length] += 1
    return n


def histograms():
    rng = np.random.default_rng(3)
    draw = {
        "uniform": rng.integers(1, 129, 2000), "large": rng.integers(40, 75, 2000), "thirds": rng.integers(32, 48, 1500), "few": rng.choice([25, 43, 64, 38, 88], 3000),
        "tiny": rng.integers(1, 129, 12), "one length": np.full(1000, 50), "full": np.full(7, 128), "ones": np.ones(300, np.int64), "skewed": np.minimum(rng.geometric(0.05, 4000), 128),
    }
    return {k: np.bincount(v, minlength=129) for k, v in draw.items()}


@pytest.mark.parametrize("name", list(histograms()))
def test_plans_hold_all_in_few_sequences(name):
    histogram = histograms()[name]
    price, bound = packing.prices(histogram)
    plan = packing.rounded(histogram, price)
    held = Counter()
    for taken, times in plan:
        assert times > 0 and sum(x * k for x, k in taken) <= 128
        held.update({x: k * times for x, k in taken})
    assert held == Counter({int(x): int(histogram[x]) for x in np.flatnonzero(histogram)})
    n, total = sum(t for _, t in plan), int(np.arange(129) @ histogram)
    assert packing.slots(plan)[1] == n >= -(-total // 128)
    assert bound <= n + 1e-6  # the prices are feasible, so they bound every packing
    assert n <= best_fit_decreasing(histogram) + 1


def test_prices_learn_what_shares_of_a_sequence_are_worth():
    histogram = histograms()["one length"]
    assert packing.prices(histogram)[1] == pytest.approx(500, rel=1e-6)  # two fit, though lengths add up to 391
    assert packing.prices(np.zeros(129, np.int64))[1] == 0 and packing.rounded(np.zeros(129, np.int64), np.zeros(129)) == []


def test_plan_does_not_grow_with_the_number_of_documents():
    histogram = histograms()["uniform"]
    plans = [packing.rounded(h, packing.prices(h)[0]) for h in (histogram, histogram * 100_000)]
    assert len(plans[1]) < 2 * len(plans[0]) + 128


def placed(spark, docs, **kw):
    got = packing.packed(docs, tokenizer_path(), **kw).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= kw.get("most", 1024)
    return got, by


def test_pieces_are_those_of_whole_texts(spark, docs, texts, clash):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(head, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    for table in (docs, clash(docs).withColumns({c: docs["lang"] for c in ("head", "slot", "piece", "first", "class", "task")})):
        got, _ = placed(spark, table, most=64)
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


def test_sequences_can_be_put_together(spark, docs):
    pieces = packing.packed(docs, tokenizer_path(), most=256, ids=True)
    made = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    for r in pieces.collect():
        ids = made[r["sequence_id"]]["ids"]
        assert zlib.crc32(np.array(ids[r["offset"] : r["offset"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        assert len(ids) <= 256


def test_copies_and_partitions(spark):
    import random

    rng = random.Random(2)
    rows = [(i, "the same words in many rows") for i in range(400)] + [(1000 + i, prose(rng, rng.randint(1, 60))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for parts in (1, 7):
        got, by = placed(spark, docs.repartition(parts), most=128)
        assert len(got) == len({(r["sequence_id"], r["offset"]) for r in got})
        first.setdefault("n", len(by))
        assert abs(len(by) - first["n"]) == 0


def test_nothing_gives_nothing(spark, no_docs):
    assert packing.packed(no_docs, tokenizer_path()).collect() == []


def test_batch_size_of_the_session_stays(spark, docs):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    packing.packed(docs, tokenizer_path(), most=64)
    assert spark.conf.get(key) == before
