"""A topic model over vectors that can be kept: outliers, their reassignment, probabilities, diverse terms.

Stands for a topic model by density clustering, which Spark has none of:
seeded bisecting k-means over vectors of length 1, where a document that lies
far outside its topic is an outlier (topic -1). A model is tables: centres,
radii and terms. It is saved with a fingerprint of its terms, and loading one
whose parts don't agree fails.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .topics import fingerprint, unit

OUTLIER = -1
CENTRES = "topic int, n long, radius double, vector array<double>"


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors of length 1; a vector of zeros is like none."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, d: s + d)


@dataclass(frozen=True)
class TopicModel:
    """``centres`` (topic, n, radius, vector), one row a topic, and ``terms`` (topic, token, weight, rank)."""

    centres: DataFrame
    terms: DataFrame

    def fingerprint(self) -> str:
        """16 hexadecimal digits for the topics and their terms in order. A topic has few terms, so they are gathered."""
        return fingerprint(topic_terms(self.terms))


def topic_terms(terms: DataFrame) -> dict[int, list[str]]:
    """The terms of each topic in the order of their rank."""
    rows = terms.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("all")).select("topic", "all.token").collect()
    return {int(r["topic"]): list(r["token"]) for r in rows}


def fit(vectors: DataFrame, terms: Callable[[DataFrame], DataFrame], k: int, key: str = "vec_id", vector: str = "embedding", spread: float = 2.0, seed: int = 7) -> TopicModel:
    """A model of ``k`` topics at most.

    ``terms`` is a function from assignments (key, topic) to (topic, token,
    weight, rank), such as ``topics.class_terms`` over the documents' tokens.
    A topic's radius is its members' mean distance and ``spread`` deviations.
    Only the ``k`` centres reach the driver.
    """
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(key, unit(F.col(vector)).alias("__u"))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="__v", predictionCol="topic").fit(rows.select(array_to_vector("__u").alias("__v")))
    spark = vectors.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "topic int, vector array<double>")
    near = nearest(rows, centres, key, "__u")
    radii = near.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), (F.avg("distance") + F.lit(spread) * F.stddev_pop("distance")).alias("radius"))
    centres = centres.join(radii, "topic").select("topic", "n", "radius", "vector")
    # settled: what is assigned and what is saved are the same centres
    centres = spark.createDataFrame(centres.collect(), CENTRES)
    return TopicModel(centres, terms(assigned(vectors, centres, key, vector).where(F.col("topic") != OUTLIER).select(key, "topic")))


def nearest(units: DataFrame, centres: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, topic, distance) to the nearest of ``centres`` (topic, vector), which are as few as a model's topics; of those that tie the first."""
    held = centres.agg(F.array_sort(F.collect_list(F.struct("topic", "vector")))).first()[0]
    gap = lambda v: F.sqrt(F.aggregate(F.zip_with(F.col(vector), v, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    each = [F.struct(gap(F.array(*map(F.lit, c["vector"]))).alias("distance"), F.lit(c["topic"]).alias("topic")) for c in held]
    best = F.array_min(F.array(*each))
    return units.select(key, best["topic"].alias("topic"), best["distance"].alias("distance"))


def assigned(vectors: DataFrame, centres: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, topic, nearest, distance): the nearest topic, or -1 for a document outside its radius."""
    rows = nearest(vectors.select(key, unit(F.col(vector)).alias("__u")), centres, key, "__u")
    radii = centres.select(F.col("topic").alias("__t"), "radius")
    rows = rows.join(F.broadcast(radii), F.col("topic") == F.col("__t"))  # one row a topic
    return rows.select(key, F.when(F.col("distance") <= F.col("radius"), F.col("topic")).otherwise(OUTLIER).alias("topic"), F.col("topic").alias("nearest"), "distance")


def topic_vectors(vectors: DataFrame, assignments: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(topic, vector): the mean of a topic's documents, scaled to length 1. Outliers have none; sums are by component."""
    rows = vectors.select(key, vector).join(assignments.where(F.col("topic") != OUTLIER).select(key, "topic"), key)
    means = rows.select("topic", F.posexplode(vector).alias("i", "x")).groupBy("topic", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"])
    return means.groupBy("topic").agg(held.alias("v")).select("topic", unit(F.col("v")).alias("vector"))


def similarities(vectors: DataFrame, topics: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, likeness): an array of (topic, cosine) over all topics, in their order. Topics are sent to all tasks, one row each."""
    held = topics.agg(F.array_sort(F.collect_list(F.struct("topic", "vector"))).alias("__topics"))
    rows = vectors.select(key, unit(F.col(vector)).alias("__u")).join(F.broadcast(held))
    each = F.transform("__topics", lambda t: F.struct(t["topic"].alias("topic"), cosine(F.col("__u"), t["vector"]).alias("cosine")))
    return rows.select(key, each.alias("likeness"))


def reassigned(assignments: DataFrame, vectors: DataFrame, least: float = 0.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, topic, reduced): outliers are given the topic whose mean vector is most like theirs, if ``least`` or more; the raw topic stays beside it."""
    topics = topic_vectors(vectors, assignments, key, vector)
    out = assignments.where(F.col("topic") == OUTLIER).select(key)
    like = similarities(vectors.join(out, key, "left_semi"), topics, key, vector)
    best = F.array_max(F.transform(F.filter("likeness", lambda t: t["cosine"] >= least), lambda t: F.struct(t["cosine"].alias("c"), (-t["topic"]).alias("t"))))
    found = like.select(F.col(key).alias("__key"), (-best["t"]).alias("__to"))
    rows = assignments.select(key, "topic").join(found, F.col(key) == F.col("__key"), "left")
    return rows.select(key, "topic", F.when(F.col("topic") == OUTLIER, F.coalesce("__to", F.lit(OUTLIER))).otherwise(F.col("topic")).alias("reduced"))


def probabilities(vectors: DataFrame, topics: DataFrame, sharpness: float = 20.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, topic, p): how far a document belongs to each of ``topics`` (topic, vector): the cosines' exponentials, ``sharpness`` times, as parts of their sum."""
    like = similarities(vectors, topics, key, vector)
    top = F.array_max(F.transform("likeness", lambda t: t["cosine"]))
    like = like.withColumn("__top", top)
    weights = F.transform("likeness", lambda t: F.struct(t["topic"].alias("topic"), F.exp((t["cosine"] - F.col("__top")) * sharpness).alias("w")))
    like = like.withColumn("__w", weights).withColumn("__sum", F.aggregate("__w", F.lit(0.0), lambda s, t: s + t["w"]))
    return like.select(key, F.explode(F.transform("__w", lambda t: F.struct(t["topic"].alias("topic"), (t["w"] / F.col("__sum")).alias("p")))).alias("t")).select(key, "t.topic", "t.p")


def marginal_relevance(own: np.ndarray, candidates: np.ndarray, diversity: float, top: int) -> list[int]:
    """Rows of ``candidates`` (unit vectors) in the order they are chosen.

    The first is most like ``own``; each next one has the highest likeness to
    it less its likeness to what has been chosen, weighted by ``diversity``.
    Ties go to the earlier row.
    """
    like = candidates @ own
    chosen: list[int] = []
    nearest_chosen = np.full(len(candidates), -np.inf)
    while len(chosen) < min(top, len(candidates)):
        score = (1 - diversity) * like - diversity * nearest_chosen if chosen else like
        score = np.where(np.isin(np.arange(len(score)), chosen), -np.inf, score)
        best = int(score.argmax())
        chosen.append(best)
        nearest_chosen = np.maximum(nearest_chosen, candidates @ candidates[best])
    return chosen


def diverse_terms(terms: DataFrame, factory: Callable[[], Callable[[list[str]], list[list[float]]]], diversity: float = 0.3, top: int = 10) -> DataFrame:
    """(topic, token, weight, rank): of each topic's candidate ``terms`` (topic, token, weight, rank) a choice that repeats itself less.

    Terms are encoded by an injected encoder; a topic is its terms' mean. A
    topic's candidates are a list that ``rank`` bounds, thirty say.
    """
    if not 0 <= diversity <= 1:
        raise ValueError("diversity lies in [0, 1]")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "token"], ignore_index=True)
        vectors = np.asarray(factory()(rows["token"].tolist()), float)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        own = vectors.mean(axis=0)
        picked = marginal_relevance(own / max(np.linalg.norm(own), 1e-12), vectors, diversity, top)
        return rows.loc[picked].assign(rank=range(1, len(picked) + 1))[["topic", "token", "weight", "rank"]]

    return terms.select("topic", "token", "weight", "rank").groupBy("topic").applyInPandas(choose, terms.select("topic", "token", "weight", F.col("rank").cast("int")).schema)


class ModelMismatch(RuntimeError):
    """A stored model whose parts don't agree, or that isn't the one that was meant."""


def save(model: TopicModel, path: str) -> str:
    """Writes a model below ``path``, reads it back and holds it against what was written; returns its fingerprint.

    A model that can't be loaded again is none, so a difference in topics,
    centres or terms fails.
    """
    spark = model.centres.sparkSession
    model.centres.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    model.terms.select("topic", "token", "weight", "rank").coalesce(1).write.mode("overwrite").parquet(f"{path}/terms")
    told = {"topics": sorted(r["topic"] for r in model.centres.select("topic").collect()), "fingerprint": model.fingerprint()}
    spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    back = load(spark, path)
    differs = lambda a, b: not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty()
    if differs(model.centres, back.centres) or back.fingerprint() != told["fingerprint"]:
        raise ModelMismatch(f"{path} reloads as another model")
    return told["fingerprint"]


def load(spark: SparkSession, path: str) -> TopicModel:
    """A model that ``save`` wrote. Topics or terms that its manifest doesn't name fail."""
    told = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    model = TopicModel(spark.read.schema(CENTRES).parquet(f"{path}/centres"), spark.read.parquet(f"{path}/terms"))
    found = sorted(r["topic"] for r in model.centres.select("topic").collect())
    if found != told["topics"]:
        raise ModelMismatch(f"{path} has topics {found}, not {told['topics']}")
    if (now := model.fingerprint()) != told["fingerprint"]:
        raise ModelMismatch(f"{path} has terms of fingerprint {now}, not {told['fingerprint']}")
    return model


def named(model: TopicModel, names: dict[int, str], expected: str) -> DataFrame:
    """(topic, name) of a model's topics, null where there is none; names that were made for another fingerprint fail."""
    if (now := model.fingerprint()) != expected:
        raise ModelMismatch(f"the names are for {expected}, the model is {now}: each may now mean another topic")
    spark = model.centres.sparkSession
    rows = spark.createDataFrame(sorted(names.items()), "topic int, name string")
    if extra := [r["topic"] for r in rows.join(model.centres, "topic", "left_anti").collect()]:
        raise ModelMismatch(f"names for topics that the model lacks: {sorted(extra)}")
    return model.centres.select("topic").join(rows, "topic", "left")
