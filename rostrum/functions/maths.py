"""Measures as columns. Zero denominators give null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profile import Profile


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles, null if b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rate(a: Column, b: Column, per: float) -> Column:
    return F.try_divide(a.cast("double") * per, b.cast("double"))


def npmi(joint: Column, parts: list[Column], total: Column) -> Column:
    """Normalised pointwise mutual information of n parts; null where a count is 0 or the joint is the total of parts' absence."""
    if len(parts) < 2:
        raise ValueError("at least two parts")
    ln = lambda x: F.log(x.cast("double") / total.cast("double"))
    alone = reduce(lambda a, b: a + b, (ln(p) for p in parts))
    value = (ln(joint) - alone) / (-(len(parts) - 1) * ln(joint))
    ok = reduce(lambda a, b: a & b, (p > 0 for p in parts), joint > 0)
    return F.when(ok & (joint == total), 1.0).when(ok, value)


def log_likelihood(a: Column, b: Column, total_a: Column, total_b: Column) -> Column:
    """Dunning's G2 of a word's counts in two corpora."""
    a, b, ta, tb = (x.cast("double") for x in (a, b, total_a, total_b))
    share = (a + b) / (ta + tb)
    part = lambda x, t: F.when(x > 0, x * F.log(x / (t * share))).otherwise(0.0)
    return 2 * (part(a, ta) + part(b, tb))


def log_ratio(a: Column, b: Column, total_a: Column, total_b: Column) -> Column:
    """Binary logarithm of the ratio of relative frequencies."""
    a, b, ta, tb = (x.cast("double") for x in (a, b, total_a, total_b))
    return F.log2((a / ta) / (b / tb))


def lix(n_words: Column, n_long: Column, n_sentences: Column) -> Column:
    return ratio(n_words, n_sentences) + rate(n_long, n_words, 100.0)


def lix_band(value: Column, profile: Profile) -> Column:
    """The name of the band that a value lies in; null for null."""
    tests = reversed(profile.lix_bands)
    return F.when(value.isNotNull(), reduce(lambda rest, b: F.when(value < b[0], F.lit(b[1])).otherwise(rest), tests, F.lit("very difficult")))


def rank_divergence(rank_a: Column, rank_b: Column, alpha: float = 1 / 3) -> Column:
    """A word's share, before normalisation, of the rank-turbulence divergence of two lists."""
    a, b = rank_a.cast("double"), rank_b.cast("double")
    return F.pow(F.abs(F.pow(1 / a, F.lit(alpha)) - F.pow(1 / b, F.lit(alpha))), F.lit(1 / (alpha + 1)))
