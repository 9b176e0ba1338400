"""Row and fragment filters of the analysis, as expressions, window sums and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chromosome_pairs(pairs: DataFrame, include: tuple[str, str] | None = None, exclude: tuple[str, ...] = (), columns: tuple[str, str] = ("chromosome_1", "chromosome_2")) -> DataFrame:
    """With ``include``, the pairs on exactly these two chromosomes in any order; else those not wholly on chromosomes in ``exclude``."""
    a, b = (F.col(c) for c in columns)
    if include:
        return pairs.where(((a == include[0]) & (b == include[1])) | ((a == include[1]) & (b == include[0])))
    return pairs.where(~(a.isin(*exclude) & b.isin(*exclude))) if exclude else pairs


def hash_share(keys: list[str], seed: int = 2014) -> Column:
    """A number in [0, 1) for each key, the same in every run, task and engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def subsample(rows: DataFrame, keys: list[str], share: float | Column, seed: int = 2014) -> DataFrame:
    """The rows of each key with the probability ``share``, which may differ by row; all rows of a key go together."""
    return rows.where(hash_share(keys, seed) < share)


def sample_exact(rows: DataFrame, keys: list[str], n: int, seed: int = 2014) -> DataFrame:
    """n keys' rows by least seeded hash; fewer keys than n are an error."""
    found = rows.select(*keys).distinct().withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))).orderBy("_h", *keys).limit(n)
    have = found.count()
    if have < n:
        raise ValueError(f"{n} of {have} rows can't be sampled")
    return rows.join(found.drop("_h"), keys, "left_semi")


def mate_score(rows: DataFrame, threshold: float = 60.0) -> DataFrame:
    """Predictions whose mean mate score is not above the threshold; unknown scores are dropped."""
    return rows.where(F.col("mate_score") <= threshold)


def long_enough(alignments: DataFrame, model: DataFrame, keys: list[str], adjust: int = 5) -> DataFrame:
    """Alignments of fragments of which both ends' best aligned length less ``adjust`` reaches the least length of the model."""
    ends = alignments.groupBy(*keys, "read_end").agg(F.max("aligned_length").alias("_best"))
    both = ends.groupBy(*keys).agg(F.min("_best").alias("_worst"), F.count("*").alias("_ends")).where("_ends = 2")
    least = model.agg(F.min("aligned_length").alias("_least"))  # one row
    kept = both.join(F.broadcast(least), F.col("_worst") - adjust >= F.col("_least")).select(*keys)
    return alignments.join(kept, keys, "left_semi")


def discordant_fragments(rows: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Alignments of fragments whose posterior of being concordant is below the threshold."""
    return rows.where(F.col("posterior_concordant") < threshold)


def likely_alignments(rows: DataFrame, keys: list[str], threshold: float = 0.1) -> DataFrame:
    """Alignments whose posterior reaches the threshold, of fragments that keep one of each end."""
    ends = F.size(F.collect_set("read_end").over(Window.partitionBy(*keys)))
    return rows.where(F.col("posterior") >= threshold).withColumn("_ends", ends).where("_ends = 2").drop("_ends")


def valid_scores(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows whose score reaches the threshold of their aligned length; lengths without a threshold are dropped."""
    return rows.join(thresholds.select("aligned_length", "threshold"), "aligned_length").where(F.col("score") >= F.col("threshold")).drop("threshold")


def window_guard(score: Column, adjusted: Column, length: Column, least: int = 16) -> Column:
    """The score where the read starts ``least`` or more into the break sequence and not beyond its half, else 0."""
    return F.when((adjusted >= least) & (adjusted <= F.floor(length / 2)), score).otherwise(0)
