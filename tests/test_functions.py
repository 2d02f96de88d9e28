"""Text functions and measures on golden values."""

import pytest
from pyspark.sql import functions as F

from rostrum.functions import maths, text
from rostrum.profile import HUNGARIAN, WESTERN


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "left", "removed"),
    [
        ("Tisztelt Országgyűlés! A költségvetésről beszélek.", "A költségvetésről beszélek.", 2),
        ("Köszönöm a szót, elnök úr. Tisztelt Ház! Kezdem.", "Kezdem.", 7),
        ("A tisztelt Ház dönt.", "A tisztelt Ház dönt.", 0),
        ("Tisztelt Ház!", "Tisztelt Ház!", 0),
    ],
)
def test_salutation(spark, given, left, removed):
    bare, n = text.without_salutation(F.col("t"))
    assert one(spark, bare, t=given) == left
    assert one(spark, n, t=given) == removed


def test_long_salutation_stays(spark):
    given = "Köszönöm " + "szó " * 70 + ". Vége."
    assert one(spark, text.without_salutation(F.col("t"))[1], t=given) == 0


@pytest.mark.parametrize(("name", "key"), [("Dr. Vadai Ágnes", "vadai agnes"), ("dr Vadai  Agnes", "vadai agnes"), ("Z. Kárpát Dániel", "karpat daniel"), ("Őry Csűrös", "ory csuros"), ("A\u0301gnes Škvorecký", "agnes skvorecky"), ("Nguyễn Łukasz", "nguyen łukasz")])
def test_name_key(spark, name, key):
    assert one(spark, text.name_key(F.col("t")), t=name) == key


@pytest.mark.parametrize(("word", "n"), [("egyszerű", 6), ("madzsar", 5), ("asszony", 5)])
def test_letters(spark, word, n):
    assert one(spark, text.letters(F.col("t"), HUNGARIAN), t=word) == n


@pytest.mark.parametrize(("word", "name"), [("Olgához", "Olga"), ("Bencének", "Bence"), ("Péternek", "Péter"), ("Péter", None)])
def test_case_stripped(spark, word, name):
    assert one(spark, text.case_stripped(F.col("t")), t=word) == name


def test_soft_hyphens(spark):
    bare, n = text.without_soft_hyphens(F.col("t"))
    assert one(spark, bare, t="a­b­c") == "abc"
    assert one(spark, n, t="a­b­c") == 2


@pytest.mark.parametrize(("span", "keep"), [("Fidesz", False), ("10.20", False), ("5", False), ("Taps.", True), ("Nagy taps", True)])
def test_remarks(spark, span, keep):
    assert one(spark, text.is_remark(F.col("t")), t=span) is keep


def test_whitespace_cells(spark):
    assert one(spark, text.decoded_whitespace(F.col("t")), t='"\\n "') == "\n "
    assert one(spark, text.decoded_whitespace(F.col("t")), t='"x') == "x"


def test_ngram_order(spark):
    assert one(spark, text.ngram_order(F.col("t")), t="taps#a#kormánypárt") == 3
    with pytest.raises(ValueError, match="delimiter"):
        text.ngram_order(F.col("t"), "")


def test_nulls_and_empty_texts(spark):
    assert one(spark, text.words(F.lit(None).cast("string"))) == []
    assert one(spark, text.whitespace_words(F.lit(""))) == 0
    assert one(spark, text.has_text(F.lit(" \n"))) is False


@pytest.mark.parametrize(("joint", "parts", "value"), [(10, [20, 25], 0.30103), (10, [10, 10], 1.0), (10, [10, 10, 10], 1.0)])
def test_npmi(spark, joint, parts, value):
    assert one(spark, maths.npmi(F.lit(joint), [F.lit(p) for p in parts], F.lit(100))) == pytest.approx(value, abs=1e-5)


def test_npmi_of_unknown_parts_is_null(spark):
    assert one(spark, maths.npmi(F.lit(3), [F.lit(0), F.lit(4)], F.lit(10))) is None
    with pytest.raises(ValueError, match="two parts"):
        maths.npmi(F.lit(1), [F.lit(1)], F.lit(1))


def test_lix_and_band(spark):
    value = maths.lix(F.lit(5), F.lit(2), F.lit(1))
    assert one(spark, value) == 45.0
    assert one(spark, maths.lix_band(value, WESTERN)) == "standard"
    assert one(spark, maths.ratio(F.lit(1), F.lit(0))) is None
