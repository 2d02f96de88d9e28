"""URL parts, rules and the trained filter."""

import pytest
from pyspark.sql import functions as F

from rostrum.llm import urls

CASES = [
    (None, "", "", None), ("no scheme", "", "", None), ("", "", "", None), ("https://A.Example.NET/en/25#top", "a.example.net", "/en/25", "example.net/en/"),
    ("http://x.net?q=/en/", "x.net", "", None), ("http://x.net/?q", "x.net", "/", "net/"), ("http://net/a", "net", "/a", "net/"), ("http://inet/a", "inet", "/a", None),
    ("http://example.com/de/1?x://y", "example.com", "/de/1", "example.com/de/"), ("http://b.org/fr/x", "b.org", "/fr/x", "org/fr/"), ("a://b://c.net/x", "b:", "//c.net/x", None), ("x://İ.Org/fr/", "İ.org", "/fr/", "org/fr/"),
    ("http://h.org/" + "a" * 20000, "h.org", "/" + "a" * 20000, None),
]


@pytest.fixture(scope="module")
def model(spark):
    return urls.train(urls.labelled_urls(spark))


def test_parts_and_rules(spark, model, clash):
    df = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(CASES)], "page_id long, url string")
    out = urls.judged(clash(df), model).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"]) for r in out] == [tuple(c[1:]) for c in CASES]
    verdicts = dict(urls.RULES)
    assert all(r["verdict"] == verdicts[r["rule"]] for r in out if r["rule"])
    assert all(r["verdict"] == ("block" if r["score"] >= urls.THRESHOLD else "allow") for r in out if not r["rule"])
    assert all(0 <= r["score"] <= 1 for r in out)


def test_rules_equal_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW p AS SELECT page_id, translate(regexp_extract(url, '{urls.HOST_AND_PATH}', 1), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(url, '{urls.HOST_AND_PATH}', 2) AS path FROM '{sf_dir}/pages.parquet'")
    want = con.execute(f"SELECT page_id, host, path, {urls.rules_sql('host', 'path')} FROM p ORDER BY 1").fetchall()
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    got = df.select("page_id", host, path, urls.fitting_rule(host, path)[0]).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == want


def test_words_held_out(spark):
    """Names none of whose words a training row has; fronts, tails, endings and most paths are those of both labels."""
    rows = urls.labelled_urls(spark).where("name <> ''").cache()
    part = lambda keep: (F.crc32("a") % 3 == 0 if keep else F.crc32("a") % 3 != 0) & (F.crc32("word") % 3 == 0 if keep else F.crc32("word") % 3 != 0)
    url = F.concat(F.lit("http://"), "host", "path").alias("url")
    out = urls.judged(rows.where(part(True)).select(url, "label"), urls.train(rows.where(part(False))), rules=()).collect()
    good, bad = ([r["score"] for r in out if r["label"] == label] for label in (0, 1))
    assert len(bad) > 100 and len(good) > 1000
    assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(good) / len(bad) > 0.85  # the area under the curve
    wrong, caught = (sum(x >= urls.THRESHOLD for x in side) / len(side) for side in (good, bad))
    print('held out', wrong, caught)
    assert wrong < 0.12 and caught > 0.5


def test_unknown_names_are_no_reason_to_block(spark, model, sf_dir):
    """Hosts of made-up syllables get one verdict, and are not blocked; names with words of the trade are."""
    out = urls.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), model).where("rule IS NULL")
    by = {r["host"]: (r["n"], r["blocked"]) for r in out.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked")).collect()}
    meant = ("casino", "bets", "pills", "spam-", "ads-", "adult")
    other = [v for h, v in by.items() if not any(w in h for w in meant)]
    assert sum(b for _, b in other) <= 0.05 * sum(n for n, _ in other)
    made = spark.createDataFrame([(f"http://www.{h}.example.com/en/7",) for h in ("grand-casino-nights", "best-bets", "lovepills", "spam-king")], "url string")
    assert [r["verdict"] for r in urls.judged(made, model, rules=()).collect()] == ["block"] * 4


def test_table_has_no_host_of_the_pages(spark, sf_dir):
    known = {r["host"] for r in urls.labelled_urls(spark).collect()}
    names = {r["name"] for r in urls.labelled_urls(spark).collect()} - {""}
    hosts = {r[0] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select(urls.host_of(F.col("url"))).distinct().collect()} - {""}
    assert not known & hosts
    assert not any(n in h for n in names for h in hosts)


def test_grams_are_all_of_them(spark):
    df = spark.createDataFrame([("abé", "/x")], "h string, p string").select(urls.grams(F.col("h"), F.col("p"), (3,)))
    assert df.first()[0] == ["h^ab", "habé", "hbé$", "p/x$"]


def test_no_rows(spark, model):
    assert urls.judged(spark.createDataFrame([], "page_id long, url string"), model).count() == 0
