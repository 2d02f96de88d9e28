"""Containment search against comparing all pairs."""

import random

import pytest
from cases import prose

from rostrum.llm import decontam

ITEM = "item_id long, text string"


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(5)
    items = [prose(rng, rng.choice([6, 9, 17, 40, 90, 150])) for _ in range(30)]
    long = [prose(rng, rng.randint(50, 1500)) for _ in range(40)]
    docs = []
    for i, text in enumerate(long):
        w = text.split(" ")
        item = items[i % 30].split(" ")
        at = rng.randint(0, len(w))
        if i % 4 == 0:  # whole
            w[at:at] = item
        elif i % 4 == 1:  # a word changed near the end
            w[at:at] = [*item[:-1], "changed"]
        elif i % 4 == 2:  # half of it, which is too little
            w[at:at] = item[: len(item) // 2]
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, items[0].upper()), (102, items[0].upper()), (None, items[1] + "!"), (103, "a b"), (104, items[2] + " " + items[3])]
    items = [(i, t) for i, t in enumerate(items)] + [(90, None), (91, ""), (92, "a b"), (93, items[4]), (93, items[4]), (None, items[5])]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM)


def brute(docs, items):
    out = []
    for d in docs.collect():
        own = decontam.word_shingles(d["text"])
        for i in items.collect():
            asked = decontam.word_shingles(i["text"])
            if asked and len(asked & own) >= 0.8 * len(asked):
                out.append((str(d["doc_id"]), str(i["item_id"]), len(asked & own), len(asked)))
    return sorted(out)


@pytest.mark.parametrize("block", [10_000, 4])
def test_matches_all_pairs(case, clash, block):
    docs, items = case
    got = decontam.contained(clash(docs), clash(items), block=block).collect()
    assert sorted((str(r["doc_id"]), str(r["item_id"]), r["shared"], r["item_shingles"]) for r in got) == brute(docs, items)
    assert all(r["containment"] >= 0.8 for r in got)


@pytest.mark.parametrize("block", [10_000, 7])
def test_clean_keeps_the_rest(case, clash, block):
    docs, items = case
    dirty = {d for d, *_ in brute(docs, items)}
    out = decontam.clean(clash(docs), items, block=block)
    assert out.columns == clash(docs).columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r["doc_id"]) for r in docs.collect() if str(r["doc_id"]) not in dirty)


def test_sample_tables(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = decontam.contained(docs, items).collect()
    assert sorted((str(r["doc_id"]), str(r["item_id"]), r["shared"], r["item_shingles"]) for r in got) == brute(docs, items)


def test_empty_sides(spark, case):
    docs, items = case
    none = spark.createDataFrame([], ITEM)
    assert decontam.contained(docs, none).count() == 0
    assert decontam.clean(docs, none).count() == docs.count()
    assert decontam.contained(docs.limit(0), items).count() == 0


def missed(docs, items):
    """Pairs that comparing all texts finds and the index doesn't, and the other way round."""
    asked, own = [decontam.word_shingles(t) for t in items], [decontam.word_shingles(t) for t in docs]
    want = {(d, i, len(a & o), len(a)) for d, o in enumerate(own) for i, a in enumerate(asked) if a and len(a & o) >= 0.8 * len(a)}
    got = decontam.Index(list(range(len(items))), items).matches(docs)
    assert want
    assert len(set(got)) == len(got)
    return want ^ set(got)


@pytest.mark.parametrize("words", [5, 6, 7, 8, 9])
def test_small_items_at_all_offsets(words):
    rng = random.Random(words)
    items = [" ".join(f"i{rng.randrange(10**6)}" for _ in range(words)) for _ in range(600)]
    docs = []
    for k, item in enumerate(items):
        w = [f"d{rng.randrange(10**6)}" for _ in range(60)]
        w[k % 40 : k % 40] = item.split(" ")
        docs.append(" ".join(w))
    assert not missed(docs, items)


@pytest.mark.parametrize(("line", "times"), [(4, 16), (7, 20), (1, 60), (9, 5)])
def test_repeating_items_at_all_offsets(line, times):
    rng = random.Random(line)
    items = [" ".join([f"i{rng.randrange(10**6)}" for _ in range(line)] * times) for _ in range(120)]
    docs = []
    for k, item in enumerate(items):
        w = [f"d{rng.randrange(10**6)}" for _ in range(400)]
        w[k:k] = item.split(" ") if k % 2 else item.split(" ")[: 2 * line + 5]  # all of it, or its distinct shingles alone
        docs.append(" ".join(w))
    assert not missed(docs, items)
