"""Water-filling against a loop, and mixes against their targets."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rostrum.llm import mixing


def filled(sizes, weights, budget, cap):
    """Targets by clamping and sharing again, one source after another."""
    target = dict.fromkeys(sizes, 0.0)
    live = {s for s in sizes if sizes[s] and weights[s]}
    left = budget
    while live:
        level = left / sum(weights[s] for s in live)
        full = {s for s in live if level * weights[s] >= cap * sizes[s]}
        if not full:
            return target | {s: level * weights[s] for s in live}
        for s in full:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in full)
        live -= full
    return target


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.sampled_from([0.0, 1.0, 2.0, 7.0])), min_size=1, max_size=6), st.sampled_from([0.5, 1.0, 2.9]))
def test_water_fill(spark, sources, share):
    sizes = {f"s{i}": n for i, (n, _) in enumerate(sources)}
    weights = {f"s{i}": w for i, (_, w) in enumerate(sources)}
    budget = share * sum(sizes.values())
    df = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.water_fill(df, budget, 3.0).collect()}
    assert got == pytest.approx(filled(sizes, weights, budget, 3.0))


def words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_plan(docs, clash):
    rows = mixing.plan_mix(clash(docs)).collect()
    given = docs.collect()
    assert len(rows) == len(given)
    sizes: dict = {}
    for r in given:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = filled(sizes, {s: 1.0 + i % 3 for i, s in enumerate(order)}, float(sum(sizes.values())), 3.0)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        largest = max(words(r["text"]) for r in given if r["source"] == s)
        assert abs(taken[s] - targets[s]) <= largest
    again = sorted(tuple(map(str, r)) for r in mixing.plan_mix(docs).collect())
    assert again == sorted(tuple(map(str, r)) for r in rows)


def test_mix_has_the_planned_rows(docs, clash):
    plan = {}
    for r in mixing.plan_mix(docs).collect():
        key = (r["doc_id"], r["source"], r["size"])
        plan[key] = plan.get(key, 0) + r["copies"]
    out = mixing.mixed(clash(docs))
    assert out.columns == clash(docs).columns
    got: dict = {}
    for r in out.collect():
        key = (r["doc_id"], r["source"], words(r["text"]))
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in plan.items() if n}


def test_many_equal_documents_come_near(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 10).alias("text"), F.when(F.col("id") < 2000, "a").when(F.col("id") < 2900, "b").alias("source"))
    out = mixing.plan_mix(df).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 10 for r in out)


def test_no_rows_and_no_words(spark, no_docs):
    assert mixing.plan_mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, "a")], "doc_id long, text string, source string")
    assert {(r["size"], r["target"]) for r in mixing.plan_mix(blank).collect()} == {(0, 0.0)}
