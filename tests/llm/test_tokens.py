"""The token store against plain encoding, and its damage."""

import dataclasses
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.llm import tokens
from rostrum.llm.queries import tokenizer_path


def encoded(texts):
    t = tokens._tokenizer(tokenizer_path())
    return [e.ids for e in t.encode_batch(list(texts), add_special_tokens=False)]


def test_encoder_equals_plain_encoding(texts):
    rng = random.Random(4)
    odd = ["".join(rng.choice(" \n\tab1!é\xa0\x1c\0　🙂'ls.,%_-") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    odd += ["<|endoftext|> a", "it's they'll .'s", "a.\nB. c,\n d", "\n", " ", "x  y", *(t or "" for t in texts)]
    encoder = tokens.Encoder(tokenizer_path(), most_pieces=500)
    for k in range(0, len(odd), 400):
        assert [list(x) for x in encoder(odd[k : k + 400])] == encoded(odd[k : k + 400])


def test_new_pieces_cost_no_call_of_their_own():
    """Words that are met for the first time, with marks or without, are looked up and told apart without a Python function for each."""
    encoder, calls = tokens.Encoder(tokenizer_path()), [0]
    words = [f"{a}{b}{c}" for a in "kmnprst" for b in "aeiouáé" for c in "bdfglvxz"]
    texts = [" ".join(words), " ".join(f"{w}q." for w in words), "\n".join(words), " ".join(f"{w}'s q{w}!" for w in words)]

    def count(frame, event, arg):
        calls[0] += event == "call"

    sys.setprofile(count)
    try:
        encoder.flat(texts)
    finally:
        sys.setprofile(None)
    assert calls[0] < len(words)
    assert [list(x) for x in encoder(texts)] == encoded(texts)


def test_other_tokenizers_encode_whole_texts(texts):
    path = tokenizer_path("word_bpe_49k.json")
    encoder, odd = tokens.Encoder(path), [t or "" for t in texts]
    assert not encoder.by_pieces
    assert [list(x) for x in encoder(odd)] == [e.ids for e in tokens._tokenizer(path).encode_batch(odd, add_special_tokens=False)]


def test_wide_ids_and_large_doc_ids(spark, monkeypatch):
    """A vocabulary above 65,536 is stored in four bytes and read back from there; ids above 2^53 stay what they are."""
    rows = [((1 << 60) + 1, "one two"), (None, "three"), ((1 << 60) + 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    store = tokens.write_store(docs, tokenizer_path(), end_id=70_000)
    got = {r["doc_id"]: r["ids"] for r in tokens.read_store(store, ids=True).collect()}
    assert got == {d: [*x, 70_000] for (d, t), x in zip(rows, encoded([t or "" for _, t in rows]), strict=True)}


def test_store_round_trip(spark, docs, clash):
    store = tokens.write_store(clash(docs).drop("start"), tokenizer_path())
    got = [tuple(r) for r in tokens.read_store(store, ids=True).collect()]
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    ids = [[*x, 2] for x in encoded([t for _, t in rows])]
    crc = lambda x: zlib.crc32(np.asarray(x, "<u4").tobytes())
    want = sorted((str(d), len(x), crc(x)) for (d, _), x in zip(rows, ids, strict=True))
    assert sorted((str(d), n, c) for d, _, n, c, _ in got) == want
    at = 0
    for doc_id, start, n, c, x in sorted(got, key=lambda r: r[1]):
        assert (start, c) == (at, crc(x))
        at += n
    known = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert known[:2] == [None, None]
    assert known[2:] == sorted(known[2:])
    again = tokens.documents_of(spark, store.path)
    assert tokens.read_store(again).count() == len(rows)
    assert store.manifest.where(f"level = {store.manifest.agg({'level': 'max'}).first()[0]}").count() == 1


def test_chunks_are_stored_once(docs):
    store = tokens.write_store(docs.unionByName(docs), tokenizer_path())
    assert store.index.select("digest").distinct().count() == store.index.count()


def test_reading_copies_is_spread(spark, docs):
    """Of two tasks with equal texts one owns all chunks; the documents of the other go to all tasks."""
    twice = docs.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).repartitionByRange(2, "half")
    store = tokens.write_store(twice, tokenizer_path())
    assert store.recipes.select("home").distinct().count() == 2
    assert store.index.select("pack").distinct().count() == 1
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        tasks = tokens.read_store(store).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set(coalesce, before)
    assert sum(r["count"] for r in tasks) == 2 * docs.count()
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_damage_is_found(spark, docs):
    store = tokens.write_store(docs, tokenizer_path())
    name = store.index.first()["pack"].removeprefix("file://")
    with open(name, "r+b") as f:
        f.seek(0)
        f.write(b"\xff\xff")
    with pytest.raises(Exception, match="is damaged"):
        tokens.read_store(store).collect()


@pytest.mark.parametrize("bits", [20, 8])
def test_lost_doubled_and_changed_recipes_are_found(spark, docs, bits, monkeypatch):
    monkeypatch.setattr(tokens, "RUN_BITS", bits)
    monkeypatch.setattr(tokens, "NODE_BITS", 2)
    store = tokens.documents_of(spark, tokens.write_store(docs, tokenizer_path()).path)
    assert tokens.read_store(store).count() == docs.count()
    recipes, top = store.recipes, store.manifest.agg(F.max("level")).first()[0]
    assert (top > 1) == (bits == 8)
    one = F.col("start") == recipes.orderBy("start").collect()[9]["start"]
    other = recipes.where("n_tokens > 3").orderBy("start").first()
    copied = {c: F.when(one, F.lit(other[c])).otherwise(F.col(c)) for c in ("n_tokens", "root", "home")}
    chunks = recipes.where(F.col("start") == other["start"]).select(F.col("chunks").alias("theirs"))
    changed = recipes.crossJoin(chunks).withColumns({**copied, "chunks": F.when(one, F.col("theirs")).otherwise(F.col("chunks"))}).drop("theirs")
    wrong = [recipes.where(~one), recipes.unionByName(recipes.where(one)), recipes.limit(0), changed]
    wrong += [recipes.withColumn("doc_id", F.when(one, F.lit(12345)).otherwise(F.col("doc_id")))]
    for r in wrong:
        with pytest.raises(Exception, match="manifest"):
            tokens.read_store(dataclasses.replace(store, recipes=r)).collect()
    for m in (store.manifest.where(f"level < {top}"), store.manifest.where("node > 0"), store.manifest.unionByName(store.manifest)):
        with pytest.raises(Exception, match="manifest"):
            tokens.read_store(dataclasses.replace(store, manifest=m)).collect()


def test_cut_points_cover_and_repeat():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50000, 40000).astype(np.uint32)
    ends = tokens.cut_points(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids)
    assert sizes.max() <= tokens.MOST
    shifted = tokens.cut_points(np.r_[rng.integers(0, 50000, 777).astype(np.uint32), ids])
    assert len({e - 777 for e in shifted} & set(ends)) > len(ends) * 0.7


def test_merkle():
    one, two, three = (bytes([k]) * 32 for k in range(3))
    assert tokens.merkle([one]) == one
    assert tokens.merkle([one, two, three]) != tokens.merkle([one, three, two])


def test_no_rows(no_docs):
    store = tokens.write_store(no_docs, tokenizer_path())
    assert tokens.read_store(store).count() == 0
