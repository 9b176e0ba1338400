"""Stages from clusters to result tables, as pure functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svspark.functions import seq, stats
from svspark.operators import aggregates as agg
from svspark.operators import joins

READ = ["library_id", "read_id"]
SPOT = ["cluster_id", "breakpoint_id"]


def select_predictions(likelihoods: DataFrame, template_min: int = 40, min_log_likelihood: float = -5.0) -> DataFrame:
    """The best breakpoint of each cluster: best row per read, summed likelihood, then the greatest sum (ties to the greater id) with both template lengths long enough."""
    best = agg.best_row(likelihoods, [*SPOT, *READ], [F.desc("log_likelihood"), F.desc("tl1"), F.desc("tl2")])
    sums = best.groupBy(*SPOT).agg(F.round(F.sum("log_likelihood"), 6).alias("log_likelihood"), F.max("tl1").alias("tl1"), F.max("tl2").alias("tl2"))
    return agg.best_row(sums, ["cluster_id"], [F.desc("log_likelihood"), F.desc("breakpoint_id")]).where(F.least("tl1", "tl2") >= template_min)


def tabulate(likelihoods: DataFrame, breakpoints: DataFrame, min_log_likelihood: float = -5.0) -> DataFrame:
    """Statistics and type of each selected prediction over its accepted reads; one aggregation, since all parts share the key."""
    chosen = select_predictions(likelihoods).select(*SPOT)
    reads = likelihoods.where(F.col("log_likelihood") >= min_log_likelihood).join(chosen, SPOT, "left_semi")
    table = reads.groupBy("cluster_id").agg(
        F.round(F.avg("log_likelihood"), 6).alias("log_likelihood"),
        F.max("tl1").alias("template_length_1"),
        F.max("tl2").alias("template_length_2"),
        F.count("*").alias("num_reads"),
        F.countDistinct(F.struct("library_id", "tl1", "tl2")).alias("num_unique_reads"),
    )
    kind = seq.breakpoint_type(*[F.col(f"{c}_{i}") for i in (1, 2) for c in ("chromosome", "strand", "position")])
    return table.join(breakpoints, "cluster_id").select("cluster_id", "log_likelihood", "template_length_1", "template_length_2", "num_reads", "num_unique_reads", F.least("template_length_1", "template_length_2").alias("template_length_min"), kind.alias("type"))


def library_counts(likelihoods: DataFrame) -> DataFrame:
    return likelihoods.groupBy(F.col("cluster_id").alias("prediction_id"), "library_id").agg(F.count("*").alias("num_reads"), F.countDistinct(F.struct("tl1", "tl2")).alias("num_unique_reads"))


def cluster_weights(breakpoints: DataFrame, epsilon: float = 1e-4, far: float = 1e9) -> DataFrame:
    """1 + epsilon ln(distance + 1); breakpoints between chromosomes count as ``far`` apart."""
    distance = F.when(F.col("chromosome_1") == F.col("chromosome_2"), F.abs(F.col("position_1") - F.col("position_2")) + 1.0).otherwise(far)
    return breakpoints.select("cluster_id", (1 + epsilon * F.log(distance)).alias("weight"))


def predict_breaks(clusters: DataFrame, spanning: DataFrame, split: DataFrame, max_predictions: int = 10) -> DataFrame:
    """Spanning (id 0) and up to ten split predictions of each cluster, with its mean mate score."""
    keys = [*READ, "read_end", "align_id"]
    hits = clusters.join(spanning, keys)
    scores = agg.nested_mean(hits, ["cluster_id"], READ, "mate_score", "mate_score")
    spans = agg.span_envelope(hits.withColumns({"start": seq.align_start(F.col("strand"), F.col("position"), F.col("aligned_length")), "end": seq.align_end(F.col("strand"), F.col("position"), F.col("aligned_length"))}), ["cluster_id", "cluster_end"])
    spans = spans.withColumn("position", seq.break_position(F.col("strand"), F.col("start"), F.col("end")))
    ends = [F.first(F.when(F.col("cluster_end") == i, F.col(c)), ignorenulls=True).alias(f"{c}_{i + 1}") for i in (0, 1) for c in ("chromosome", "strand", "position")]
    zero = spans.groupBy("cluster_id").agg(*ends).withColumns({"breakpoint_id": F.lit(0), "homology": F.lit(0), "count": F.lit(0), "inserted": F.lit("")})

    one = clusters.where("cluster_end = 0").select("cluster_id", *READ, F.col("read_end").alias("end_1"), F.col("align_id").alias("align_id_1")).distinct()
    two = clusters.where("cluster_end = 1").select("cluster_id", *READ, F.col("read_end").alias("end_2"), F.col("align_id").alias("align_id_2")).distinct()
    pairs = one.join(two, ["cluster_id", *READ])
    straight = split.withColumn("flip", F.lit(False))
    turned = split.withColumn("flip", F.lit(True))
    for c in ("align_id", "chromosome", "strand", "position"):
        turned = seq.column_flip(turned, F.lit(True), f"{c}_1", f"{c}_2")
    cut = pairs.join(straight.unionByName(turned), [*READ, "align_id_1", "align_id_2"])
    seed = F.when(F.col("flip"), 1 - F.col("read_end")).otherwise(F.col("read_end"))
    text = F.when(F.col("inserted") == ".", "").otherwise(F.col("inserted"))
    cut = cut.withColumn("inserted", F.when(seed != 0, seq.reverse_complement(text)).otherwise(text)).withColumn("inslen", F.length("inserted"))
    group = ["cluster_id", "position_1", "position_2", "homology", "inslen"]
    votes = cut.groupBy(*group).agg(F.sum("score").alias("score"), F.count("*").cast("int").alias("count"), *[F.max(f"{c}_{i}").alias(f"{c}_{i}") for i in (1, 2) for c in ("chromosome", "strand")])
    texts = agg.mode_consensus(cut.where("inslen > 0"), group, "inserted").withColumnRenamed("consensus", "inserted")
    votes = votes.join(texts, group, "left").withColumn("inserted", F.coalesce("inserted", F.lit("")))
    ranked = agg.top_n(votes, ["cluster_id"], [F.desc("score"), F.desc("position_1"), F.desc("position_2"), F.desc("homology"), F.desc("inslen")], max_predictions).withColumnRenamed("rank", "breakpoint_id")
    columns = ["cluster_id", "breakpoint_id", "chromosome_1", "strand_1", "position_1", "chromosome_2", "strand_2", "position_2", "homology", "count", "inserted"]
    return zero.select(*columns).unionByName(ranked.select(*columns)).join(scores, "cluster_id")


def read_likelihoods(realignments: DataFrame, score_stats: DataFrame, breakpoints: DataFrame, libstats: DataFrame, match: int = 2) -> DataFrame:
    """Likelihood of each pair of realigned ends; lengths the score model never saw are dropped."""
    ll, cdf = stats.score_columns(F.col("score"), F.col("aligned_length"), F.col("expon_lda"), match)
    rows = realignments.join(score_stats, "aligned_length").withColumns({"score_log_likelihood": ll, "score_log_cdf": cdf})
    parts = ["read_end", "aligned_length", "template_length", "score", "score_log_likelihood", "score_log_cdf"]
    key = [*SPOT, *READ]
    sides = [rows.where(F.col("cluster_end") == i).select(*key, *[F.col(c).alias(f"{c}_{i + 1}") for c in parts]).distinct() for i in (0, 1)]
    both = sides[0].join(sides[1], key).where("read_end_1 <> read_end_2")
    both = both.join(breakpoints.select(*SPOT, seq.inserted_length(F.col("inserted")).alias("inslen")), SPOT).join(libstats, "library_id")
    length = F.col("template_length_1") + F.col("template_length_2") + F.col("inslen")
    z, length_ll = stats.length_columns(length, F.col("fragment_mean"), F.col("fragment_stddev"))
    both = both.withColumns({"template_length": length, "length_z_score": z, "length_log_likelihood": length_ll, "length_log_cdf": stats.log_two_sided_tail(z)})
    return both.withColumns({"log_likelihood": F.col("score_log_likelihood_1") + F.col("score_log_likelihood_2") + F.col("length_log_likelihood"), "log_cdf": F.col("score_log_cdf_1") + F.col("score_log_cdf_2") + F.col("length_log_cdf")})


def tabulate_reads(reads: DataFrame, clusters: DataFrame, passed: DataFrame) -> DataFrame:
    """Reads of each cluster, with ``filtered`` true unless (cluster, library, read) is among the passed."""
    of = clusters.select("cluster_id", *READ).distinct()
    flag = passed.select("cluster_id", *READ).distinct().withColumn("_ok", F.lit(True))
    return reads.join(of, READ).join(flag, ["cluster_id", *READ], "left").withColumn("filtered", F.col("_ok").isNull()).drop("_ok")


def assert_same_clusters(a: DataFrame, b: DataFrame) -> None:
    """Fail unless both tables hold the same cluster ids."""
    one, two = a.select("cluster_id").distinct(), b.select("cluster_id").distinct()
    if one.join(two, "cluster_id", "left_anti").limit(1).count() or two.join(one, "cluster_id", "left_anti").limit(1).count():
        raise ValueError("cluster ids differ")


def demo_predict(spark, d) -> DataFrame:
    """``predict_breaks`` on the derived views."""
    from svspark.plans.views import view

    a = view(spark, d, "aln")
    key = [*READ, "read_end", "align_id"]
    spanning = a.groupBy(*key).agg(*[F.max(c).alias(c) for c in ("chromosome", "strand", "position", "aligned_length", "mate_score")])
    clusters = spanning.select((F.col("read_id") % 997).alias("cluster_id"), F.col("read_end").alias("cluster_end"), *key)
    one = spanning.where("read_end = 0").select(*READ, F.col("align_id").alias("align_id_1"), F.col("chromosome").alias("chromosome_1"), F.col("strand").alias("strand_1"), (F.col("position") % 100).alias("position_1"))
    two = spanning.where("read_end = 1").select(*READ, F.col("align_id").alias("align_id_2"), F.col("chromosome").alias("chromosome_2"), F.col("strand").alias("strand_2"), (F.col("position") % 90).alias("position_2"), "mate_score")
    split = one.join(two, READ).select("*", F.lit(0).alias("read_end"), (F.col("position_1") % 4).cast("int").alias("homology"), F.when(F.col("position_2") % 3 == 0, ".").otherwise("AC").alias("inserted"), F.col("mate_score").alias("score")).drop("mate_score")
    out = predict_breaks(clusters, spanning, split)
    return out.withColumns({"mate_score": F.round("mate_score", 6), "breakpoint_id": F.col("breakpoint_id").cast("int"), "count": F.col("count").cast("int")})


def demo_reads(spark, d) -> DataFrame:
    from svspark.plans.views import view

    a = view(spark, d, "aln")
    reads = a.groupBy(*READ, "read_end").agg(F.max("aligned_length").alias("length"))
    clusters = a.select((F.col("read_id") % 997).alias("cluster_id"), *READ)
    return tabulate_reads(reads, clusters, clusters.join(a.where("mate_score < 30").select(*READ).distinct(), READ, "left_semi")).select("cluster_id", *READ, "read_end", "length", "filtered")


__all__ = ["assert_same_clusters", "cluster_weights", "joins", "library_counts", "predict_breaks", "read_likelihoods", "select_predictions", "tabulate", "tabulate_reads"]
