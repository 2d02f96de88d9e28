"""Order by ranges against plain Python, with groups that hold most rows."""

import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rostrum.operators import bundle, events, frequency
from rostrum.operators.ordering import previous, running


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    made = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, *range(20), *(k / 4 for k in range(40))])) for i in range(900)]
    made = [(i, g, None if v is None else float(v)) for i, g, v in made]
    return made, spark.createDataFrame(made, "id long, grp string, value double").repartition(7)


def no_single_task(df):
    """The final plan: no exchange to one partition but over a row a range."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "windowspecdefinition(grp" not in plan and "windowspecdefinition(value" not in plan


def test_running_sums(spark, rows):
    made, df = rows
    got = {r["id"]: (r["n"], r["s"]) for r in running(df, [F.col("grp"), F.col("id")], {"n": F.lit(1), "s": F.col("id")}).collect()}
    n = s = 0
    for i, *_ in sorted(made, key=lambda r: (r[1] is not None, r[1] or "", r[0])):
        assert got[i] == (n, s)
        n, s = n + 1, s + i


def test_previous_crosses_ranges(spark, rows):
    made, df = rows
    out = previous(df, "grp", [F.col("id")], F.col("value"), "before")
    assert no_single_task(out)
    last = {}
    got = {r["id"]: r["before"] for r in out.collect()}
    for i, g, v in sorted(made):
        assert got[i] == last.get(g)
        last[g] = v


def test_repeats_of_a_hot_group(spark):
    rng = random.Random(3)
    lines = [("hot" if rng.random() < 0.9 else "rest", i, rng.choice(["a", "a", "b", None])) for i in range(600)]
    got = frequency.with_repeats(spark.createDataFrame(lines, "grp string, i long, line string").repartition(9), "grp", ["i"], "line")
    last, want = {}, {}
    for g, i, x in lines:
        want[i] = x is not None and last.get(g) == x
        last[g] = x
    assert {r["i"]: r["is_repeat"] for r in got.collect()} == want


def test_medians(spark, rows):
    made, df = rows
    by = defaultdict(list)
    for _, g, v in made:
        if v is not None:
            by[g].append(v)
    got = {r["grp"]: (r["n"], r["median"]) for r in bundle.party_medians(df, "value", "grp").collect()}
    assert got == {g: (len(v), statistics.median(v)) for g, v in by.items()}


def test_percentiles(spark, rows):
    made, df = rows
    known = sorted(v for *_, v in made if v is not None)
    got = {r["id"]: r["percentile"] for r in bundle.percentiles(df, "value").collect()}
    for i, _, v in made:
        want = None if v is None else 100 * sum(x <= v for x in known) / len(known)
        assert (got[i] is None) == (want is None) and (want is None or abs(got[i] - want) <= 0.5)


def test_ranks(spark):
    rng = random.Random(6)
    made = [(rng.choice([1, 1, 1, 2]), rng.choice("abcdefgh")) for _ in range(300)] + [(1, None)]
    got = {(r["cycle"], r["who"]): (r["n"], r["rank"]) for r in events.ranked(spark.createDataFrame(made, "cycle int, who string"), "cycle", "who").collect()}
    for label, names in (("ALL", [w for _, w in made if w]), ("1", [w for c, w in made if w and c == 1]), ("2", [w for c, w in made if w and c == 2])):
        ordered = sorted(Counter(names).items(), key=lambda x: (-x[1], x[0]))
        assert [got[label, w] for w, _ in ordered] == [(n, k + 1) for k, (_, n) in enumerate(ordered)]


def test_nothing_gives_nothing(spark):
    empty = spark.createDataFrame([], "id long, grp string, value double")
    assert running(empty, [F.col("id")], {"n": F.lit(1)}).collect() == []
    assert previous(empty, "grp", [F.col("id")], F.col("value"), "before").collect() == []
    assert bundle.party_medians(empty, "value", "grp").collect() == []


def test_a_common_given_name_pairs_nobody(spark):
    from rostrum.operators import network
    from rostrum.profile import HUNGARIAN

    people = [(f"Kovács{i} János", i) for i in range(50)] + [("Ritka Béla János", 100), ("Nagy Anna", 101), ("Nagy Anna Mária", 102)]
    people = spark.createDataFrame(people, "name string, person_id int").withColumns({"faction": F.lit("F"), "seq": F.col("person_id")})
    mentions = spark.createDataFrame([(m,) for m in ("János Béla", "Kovács7 János", "János Kovács9", "Béla Senki", "Mária Nagy", "Anna Nagy", "János")], "mention string")
    out = network.resolved(mentions, network.registry(people, HUNGARIAN))
    assert {r["mention"]: (r["person_id"], r["how"]) for r in out.collect()} == {
        "János Béla": (100, "tokens"), "Kovács7 János": (7, "exact"), "János Kovács9": (9, "tokens"), "Béla Senki": (None, None),
        "Mária Nagy": (102, "tokens"), "Anna Nagy": (None, None), "János": (None, None),
    }
