import random

import pytest
from cases import prose

EXTRA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, nulls, empties, one very long, and ties of ids."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(40, 160)) for _ in range(24)]
    passage = prose(rng, 60)
    out = list(base)
    out += [base[0], base[0], base[1]]
    for b in base[:6]:
        w = b.split(" ")
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(4)]
    out += [None, "", " ", "one two", "one two", "a" * 900, "né " * 150, "\n\n", "été\tà la  plage ", "🙂 emoji 🙂", prose(rng, 3000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s0", 1), (None, texts[5], "fr", "s1", 2), (None, None, None, None, None)]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EXTRA)


def clashing(df):
    """The table with columns that are named like those of operators."""
    from pyspark.sql import functions as F

    names = ("size", "target", "copies", "score", "predicted", "key", "label", "starts", "media", "payload", "secrets", "host", "rule", "n", "start", "pos", "hash", "bucket", "row", "full", "text_key", "__key", "__some", "__text_key", "__full", "__at", "__mix_size", "__mix_source", "__mix_draw", "__mix_copies", "__mix_copy", "__mix_of", "__mix_slice", "__id", "__pick")
    return df.withColumns({c: F.lit("clash") for c in names})


@pytest.fixture(scope="session")
def clash():
    return clashing
