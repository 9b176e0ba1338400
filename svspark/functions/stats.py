"""Likelihood columns and fitted score models."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def log_two_sided_tail(z: pd.Series) -> pd.Series:
    """ln(2 sf(|z|)) of a standard normal; -inf where it underflows, null stays null."""

    def one(x):
        p = math.erfc(abs(x) / math.sqrt(2))
        return math.log(p) if p > 0 else -math.inf

    return pd.Series([None if x is None or x != x else one(x) for x in z], dtype="float64")


def score_columns(score: Column, aligned_length: Column, lam: Column, match: int = 2) -> tuple[Column, Column]:
    """(log likelihood, log cdf) of an alignment score under an exponential penalty."""
    diff = aligned_length * match - score
    return F.log(lam) - lam * diff, -lam * diff


def length_columns(length: Column, mean: Column, sd: Column) -> tuple[Column, Column]:
    """(z score, log likelihood) of a template length; the constant has the sign that the filter's threshold expects."""
    z = (length - mean) / sd
    return z, -F.log(1 / (F.lit(math.sqrt(2 * math.pi)) * sd)) - z * z / 2


def fragment_stats(histogram: DataFrame, keys: list[str], length: str = "length", count: str = "n") -> DataFrame:
    """Mean and sample standard deviation of each group of a histogram."""
    n, s, ss = F.sum(count), F.sum(F.col(length) * F.col(count)), F.sum(F.col(length) * F.col(length) * F.col(count))
    mean = s / n
    var = F.try_divide(ss - n * mean * mean, n - 1)
    return histogram.groupBy(*keys).agg(mean.alias("fragment_mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("fragment_stddev"))


def fragment_range(mean: Column, sd: Column, k: float) -> tuple[Column, Column]:
    """int(mean - k sd), int(mean + k sd), cut towards 0."""
    return (mean - k * sd).cast("int"), (mean + k * sd).cast("int")


def exponential_fit(scores: DataFrame, match: int = 2) -> DataFrame:
    """(aligned_length, expon_lda): 1 over the mean penalty, 1 at most; a mean of 0 gives 1."""
    penalty = F.col("aligned_length") * match - F.col("score")
    return scores.groupBy("aligned_length").agg(F.least(F.coalesce(F.try_divide(F.lit(1.0), F.avg(penalty)), F.lit(1.0)), F.lit(1.0)).alias("expon_lda"))


def cdf_thresholds(model: DataFrame, valid: float = 0.01, match: int = 2) -> DataFrame:
    """(aligned_length, threshold): the greatest score + 1 below which the discretised exponential leaves at most ``valid``.

    Scores run from match * length down to -match * length; the threshold follows the first score whose cumulated share exceeds 1 - valid.
    """
    top = F.col("aligned_length") * match
    steps = model.withColumn("score", F.explode(F.sequence(top, -top, F.lit(-1)))).withColumn("density", F.exp(-F.col("expon_lda") * (top - F.col("score"))))
    w = Window.partitionBy("aligned_length")
    run = F.sum("density").over(w.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    share = steps.withColumn("share", run / F.sum("density").over(w))
    return share.where(F.col("share") > 1 - valid).groupBy("aligned_length").agg((F.max("score") + 1).cast("int").alias("threshold"))


def posteriors(alignments: DataFrame, keys: list[str], prior: float = 0.01) -> DataFrame:
    """Posterior of each alignment and of its fragment being concordant.

    Input: keys, read_end (0 or 1), likelihood, concordant (product of the pair's likelihoods, 0 if none).
    posterior = (prior L sum(L of the other end) + (1 - 2 prior) C) / (prior S0 S1 + (1 - 2 prior) sum C); the concordant
    posterior's numerator has 1 - prior, so that it may exceed 1.
    """
    w = Window.partitionBy(*keys)
    s0 = F.sum(F.when(F.col("read_end") == 0, F.col("likelihood")).otherwise(0.0)).over(w)
    s1 = F.sum(F.when(F.col("read_end") == 1, F.col("likelihood")).otherwise(0.0)).over(w)
    c = F.sum(F.when(F.col("read_end") == 0, F.col("concordant")).otherwise(0.0)).over(w)
    other = F.when(F.col("read_end") == 0, s1).otherwise(s0)
    total = prior * s0 * s1 + (1 - 2 * prior) * c
    return alignments.withColumns({"posterior": F.try_divide(prior * F.col("likelihood") * other + (1 - 2 * prior) * F.col("concordant"), total), "posterior_concordant": F.try_divide((1 - prior) * c, total)})


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in np.atleast_1d(x)])
