"""Registered queries: each applies library operators to the derived views over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svspark.functions import seq, stats
from svspark.operators import aggregates as agg
from svspark.operators import align, filters, graph, joins
from svspark.plans import pipeline, refdata, somatic
from svspark.plans.views import view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
READ = ["library_id", "read_id"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _starts(rows):
    return rows.withColumns({"start": seq.align_start(F.col("strand"), F.col("position"), F.col("aligned_length")), "end": seq.align_end(F.col("strand"), F.col("position"), F.col("aligned_length"))})


def _clusters(spark, d):
    return view(spark, d, "aln").withColumns({"cluster_id": F.col("read_id") % 997, "cluster_end": F.col("read_end")})


@query
def tabulate_breakpoints(spark, d):
    return pipeline.tabulate(view(spark, d, "lik"), view(spark, d, "bp"))


@query
def library_counts(spark, d):
    return pipeline.library_counts(view(spark, d, "lik"))


@query
def select_predictions(spark, d):
    return pipeline.select_predictions(view(spark, d, "lik"))


@query
def best_row_per_key(spark, d):
    rows = agg.best_row(view(spark, d, "lik"), ["cluster_id", "breakpoint_id", *READ], [F.desc("log_likelihood"), F.desc("tl1"), F.desc("tl2")])
    return rows.select("cluster_id", "breakpoint_id", *READ, "log_likelihood", "tl1", "tl2")


@query
def mate_pairing(spark, d):
    pairs = joins.mate_pairs(view(spark, d, "aln").select(*READ, "read_end", "chromosome", "position"), READ)
    return pairs.groupBy("library_id").agg(F.count("*").alias("n_pairs"), F.sum("position_1").alias("sum_1"), F.sum("position_2").alias("sum_2"), F.sum(F.when(F.col("chromosome_1") == F.col("chromosome_2"), 1).otherwise(0)).alias("same"))


@query
def both_ends_mapped(spark, d):
    return joins.both_ends(view(spark, d, "aln"), READ)


@query
def discordant_filter(spark, d):
    return joins.discordant(view(spark, d, "aln"), READ, 200_000).select(*READ, "read_end", "align_id", "chromosome", "strand", "position")


@query
def semi_select(spark, d):
    keep = _clusters(spark, d).where("mate_score > 50").select("cluster_id")
    return joins.semi_join(_clusters(spark, d), keep, ["cluster_id"]).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query
def or_semi_select(spark, d):
    a = view(spark, d, "aln")
    keys = a.where("mate_score = 0").select("library_id", F.col("position").alias("p"), F.col("aligned_length").alias("q"))
    return joins.or_semi_join(a, keys, [[("library_id", "library_id"), ("position", "p")], [("library_id", "library_id"), ("aligned_length", "q")]]).groupBy("library_id").agg(F.count("*").alias("n"), F.sum("position").alias("positions"))


@query
def natural_join_select(spark, d):
    c = _clusters(spark, d).select("cluster_id", *READ).distinct()
    return joins.natural_join(view(spark, d, "aln"), c).groupBy("cluster_id", "library_id").agg(F.count("*").alias("n"), F.max("position").alias("last"))


@query
def span_envelope(spark, d):
    return agg.span_envelope(_starts(_clusters(spark, d)), ["cluster_id", "cluster_end"])


@query
def pivot_cluster_ends(spark, d):
    e = agg.span_envelope(_starts(_clusters(spark, d)), ["cluster_id", "cluster_end"]).withColumn("position", seq.break_position(F.col("strand"), F.col("start"), F.col("end")))
    p = e.groupBy("cluster_id").pivot("cluster_end", [0, 1]).agg(F.first("chromosome").alias("chromosome"), F.first("strand").alias("strand"), F.first("position").alias("position"))
    return p.select("cluster_id", *[F.col(f"{i}_{c}").alias(f"{c}_{i + 1}") for i in (0, 1) for c in ("chromosome", "strand", "position")])


@query
def mate_score_mean(spark, d):
    return agg.nested_mean(_clusters(spark, d), ["cluster_id"], READ, "mate_score", "mate_score")


@query
def split_vote(spark, d):
    rows = view(spark, d, "aln").withColumns({"cluster_id": F.col("read_id") % 97, "pos": F.col("position") % 50, "homology": F.col("aligned_length") % 5})
    return rows.groupBy("cluster_id", "pos", "homology").agg(F.sum("mate_score").alias("score"), F.count("*").alias("count"), F.max("chromosome").alias("chromosome"), F.max("strand").alias("strand"))


@query
def topn_per_cluster(spark, d):
    return agg.top_n(split_vote(spark, d), ["cluster_id"], [F.desc("score"), F.desc("pos"), F.desc("homology")], 10).select("cluster_id", "pos", "homology", "score", F.col("rank").cast("long").alias("rank"))


@query
def mode_consensus(spark, d):
    rows = view(spark, d, "seqs").select((F.col("doc_id") % 37).alias("k"), F.col("seq").alias("inserted"))
    return agg.mode_consensus(rows, ["k"])


@query
def fragment_stats(spark, d):
    h = _t(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("library_id"), F.floor("l_quantity").alias("length")).agg(F.count("*").alias("n"))
    out = stats.fragment_stats(h, ["library_id"])
    lo, hi = stats.fragment_range(F.col("fragment_mean"), F.col("fragment_stddev"), 6.0)
    return out.select("library_id", F.round("fragment_mean", 6).alias("fragment_mean"), F.round("fragment_stddev", 6).alias("fragment_stddev"), lo.alias("fragment_min"), hi.alias("fragment_max"))


def _scores(spark, d):
    return _t(spark, d, "lineitem").select((F.floor("l_quantity") + 30).cast("int").alias("aligned_length"), ((F.floor("l_quantity") + 30) * 2 - F.floor(F.col("l_discount") * 100)).cast("int").alias("score"))


@query
def score_histogram(spark, d):
    return _scores(spark, d).groupBy("aligned_length", "score").agg(F.count("*").alias("freq"))


@query
def expon_fit(spark, d):
    return stats.exponential_fit(_scores(spark, d)).select("aligned_length", F.round("expon_lda", 9).alias("expon_lda"))


@query
def score_cdf_threshold(spark, d):
    return stats.cdf_thresholds(stats.exponential_fit(_scores(spark, d)))


@query
def score_likelihood(spark, d):
    rows = _scores(spark, d).distinct().join(stats.exponential_fit(_scores(spark, d)), "aligned_length")
    ll, cdf = stats.score_columns(F.col("score"), F.col("aligned_length"), F.col("expon_lda"))
    return rows.select("aligned_length", "score", F.round(ll, 6).alias("log_likelihood"), F.round(cdf, 6).alias("log_cdf"))


@query
def length_log_cdf(spark, d):
    rows = _t(spark, d, "lineitem").select(F.floor("l_quantity").alias("length")).distinct()
    z, ll = stats.length_columns(F.col("length"), F.lit(25.5), F.lit(14.4))
    return rows.select("length", z.alias("z"), ll.alias("log_likelihood"), stats.log_two_sided_tail(z).alias("log_cdf"))


@query
def posterior(spark, d):
    a = view(spark, d, "aln").groupBy(*READ, "read_end", "align_id").agg(F.max("mate_score").alias("m"))
    a = a.withColumns({"likelihood": F.exp(-F.col("m") / 20.0), "concordant": F.when((F.col("read_end") == 0) & (F.col("m") % 2 == 0), F.exp(-F.col("m") / 10.0)).otherwise(0.0)})
    return stats.posteriors(a, READ).select(*READ, "read_end", "align_id", F.round("posterior", 6).alias("posterior"), F.round("posterior_concordant", 6).alias("posterior_concordant"))


@query
def cluster_weights(spark, d):
    return pipeline.cluster_weights(view(spark, d, "bp")).select("cluster_id", F.round("weight", 9).alias("weight"))


@query
def region_excluded_reads(spark, d):
    return joins.excluded_reads(view(spark, d, "aln"), view(spark, d, "regions"), READ)


@query
def region_contained(spark, d):
    q = view(spark, d, "aln").select("chromosome", F.col("position").alias("q_start"), (F.col("position") + 3).alias("q_end"))
    return joins.contained(q, view(spark, d, "regions")).groupBy("chromosome").agg(F.count("*").alias("n"), F.sum("q_start").alias("starts"))


def _intervals(spark, d):
    b = view(spark, d, "aln").select("chromosome", F.col("position").alias("start"), (F.col("position") + F.col("aligned_length") - 40).alias("end")).distinct()
    return b.withColumn("prediction_id", F.col("start") * 1000 + F.col("end") - F.col("start"))


@query
def tolerance_interval_join(spark, d):
    known = view(spark, d, "regions").select(F.col("region_id").alias("id"), "chromosome", "start", "end")
    hits = joins.tolerance_join(_intervals(spark, d), known, 500)
    return hits.groupBy("prediction_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("id")), lambda x: x.cast("string")), ", ").alias("dgv_ids"))


def _ends(spark, d):
    b = view(spark, d, "brk")
    return b.withColumns({"position_1": F.col("position_1") % 20000, "position_2": F.col("position_2") % 20000, "flagged": F.col("mate_score") < 20})


@query
def truth_match(spark, d):
    found = agg.unpivot_ends(_ends(spark, d), ["prediction_id"]).withColumnRenamed("prediction_id", "id")
    true = agg.unpivot_ends(_ends(spark, d).where("prediction_id % 7 = 0").withColumns({"position_1": F.col("position_1") + 30, "position_2": F.col("position_2") - 20}), ["prediction_id"]).withColumnRenamed("prediction_id", "id")
    return joins.truth_match(found, true, 200)


@query
def nearest_feature(spark, d):
    points = view(spark, d, "brk").select(F.col("prediction_id").alias("point_id"), F.col("chromosome_1").alias("chromosome"), F.col("position_1").alias("position"))
    return joins.nearest_feature(points, view(spark, d, "regions").withColumnRenamed("region_id", "feature_id"))


@query
def nearest_filtered_breakend(spark, d):
    return agg.nearest_flagged(agg.unpivot_ends(_ends(spark, d), ["prediction_id", "flagged"]), "flagged", "prediction_id")


@query
def breakpoint_types(spark, d):
    b = _ends(spark, d).withColumns({"chromosome_1": F.lit("1"), "chromosome_2": F.when(F.col("mate_score") % 3 == 0, "2").otherwise("1")})
    kind = seq.breakpoint_type(*[F.col(f"{c}_{i}") for i in (1, 2) for c in ("chromosome", "strand", "position")])
    return b.select("prediction_id", kind.alias("type"))


@query
def rearrangement_types(spark, d):
    b = _ends(spark, d)
    kind = seq.breakpoint_type(F.lit("1"), F.col("strand_1"), F.col("position_1"), F.lit("1"), F.col("strand_2"), F.col("position_2"))
    size = F.abs(F.col("position_1") - F.col("position_2"))
    return b.select("prediction_id", seq.rearrangement_type(kind, size * 100, F.col("flagged")).alias("rearrangement_type"), size.alias("size"))


@query
def somatic_filter(spark, d):
    return somatic.somatic(*somatic.demo_inputs(_ends(spark, d), view(spark, d, "brklib")))


@query
def changepoints(spark, d):
    return somatic.changepoints(*somatic.demo_inputs(_ends(spark, d), view(spark, d, "brklib"))[:2])


@query
def library_pivot(spark, d):
    return agg.pivot_counts(view(spark, d, "brklib"), "prediction_id", "library", "num_reads", ["lib0", "lib1", "lib2", "lib3"])


@query
def control_filter(spark, d):
    return library_pivot(spark, d).where("lib0_count = 0").select("prediction_id", "lib1_count", "lib2_count", "lib3_count")


@query
def chrom_pair_shards(spark, d):
    c1, c2 = F.col("chromosome_1"), F.col("chromosome_2")
    return view(spark, d, "brk").groupBy(F.least(c1, c2).alias("chromosome_a"), F.greatest(c1, c2).alias("chromosome_b")).agg(F.count("*").alias("n"))


@query
def dense_renumber(spark, d):
    rows = _clusters(spark, d).select("library_id", "cluster_id").distinct()
    return agg.dense_ids(rows, ["library_id", "cluster_id"], "new_id").select("library_id", "cluster_id", "new_id")


@query
def revcomp(spark, d):
    return view(spark, d, "seqs").select("doc_id", seq.reverse_complement(F.col("seq")).alias("rc"))


@query
def seed_trim(spark, d):
    s = view(spark, d, "seqs")
    ends = s.select("doc_id", F.lit(0).alias("read_end"), F.substring("seq", 1, 36).alias("seed")).unionByName(s.select("doc_id", F.lit(1).alias("read_end"), F.substring(seq.reverse_complement(F.col("seq")), 1, 36).alias("seed")))
    return ends


@query
def break_sequence(spark, d):
    s = view(spark, d, "seqs")
    left, right = F.substring("seq", 1, 30), F.substring("seq", 31, 30)
    s1, s2 = F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-"), F.when(F.col("doc_id") % 3 == 0, "+").otherwise("-")
    ins = F.when(F.col("doc_id") % 5 == 0, ".").otherwise(F.substring("seq", 61, 3))
    return s.select("doc_id", seq.break_sequence(left, s1, right, s2, ins).alias("sequence"), seq.inserted_length(ins).cast("long").alias("inslen"))


@query
def microhomology(spark, d):
    s = view(spark, d, "seqs")
    other = seq.reverse_complement(F.col("seq"))
    s1, s2 = F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-"), F.when(F.col("doc_id") % 3 == 0, "+").otherwise("-")
    m = seq.microhomology(F.col("seq"), s1, F.lit(60), other, s2, (F.col("doc_id") % 50 + 40).cast("int"), 10)
    return s.select("doc_id", m.alias("m")).select("doc_id", "m.homology", "m.position_1", "m.position_2")


@query
def union_shards(spark, d):
    a = view(spark, d, "aln").select("read_id", "position")
    low, high = a.where("read_id % 2 = 0"), a.where("read_id % 3 = 0 or read_id % 2 <> 0")  # every row; multiples of 6 are in both
    every = low.unionByName(high).groupBy().agg(F.count("*").alias("n_all"))
    return every.crossJoin(low.union(high).distinct().groupBy().agg(F.count("*").alias("n_distinct")))  # two single rows


@query
def name_difference(spark, d):
    a = view(spark, d, "aln")
    return a.where("strand = '+'").select("read_id").distinct().exceptAll(a.where("strand = '-'").select("read_id").distinct())


@query
def edge_symmetric_difference(spark, d):
    a = view(spark, d, "aln")
    return agg.symmetric_difference(a.where("strand = '+'").select("chromosome", "position"), a.where("strand = '-'").select("chromosome", "position"))


@query
def read_stats(spark, d):
    """Counts, read lengths and fragment lengths as (type, key, value)."""
    a = view(spark, d, "aln")
    total = a.select(*READ).distinct().groupBy().agg(F.count("*").alias("value")).select(F.lit("read_count").alias("type"), F.lit("total").alias("key"), "value")
    lengths = a.groupBy(F.col("aligned_length").cast("string").alias("key")).agg(F.count("*").alias("value")).select(F.lit("read_length").alias("type"), "key", "value")
    frag = a.groupBy((F.col("mate_score") + 300).cast("string").alias("key")).agg(F.count("*").alias("value")).select(F.lit("fragment_length").alias("type"), "key", "value")
    return total.unionByName(lengths).unionByName(frag)


@query
def reservoir_sample(spark, d):
    """The 500 orders with the least seeded hashes."""
    return filters.sample_exact(_t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 500)


@query
def name_partition(spark, d):
    first = F.substring(F.md5(F.concat(F.lit("2013:"), F.col("o_orderkey").cast("string"))), 1, 1) < "8"
    return _t(spark, d, "orders").groupBy(F.when(first, 1).otherwise(2).cast("long").alias("part")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query
def exact_k_mix(spark, d):
    """300 orders and 200 parts by seeded hash, named by source."""

    def pick(table, key, suffix, k):
        rows = _t(spark, d, table).select(F.concat(F.col(key).cast("string"), F.lit(suffix)).alias("name")).distinct()
        return rows.orderBy(F.md5(F.concat(F.lit("2013:"), F.col("name"))), "name").limit(k)

    return pick("orders", "o_orderkey", "A", 300).unionByName(pick("part", "p_partkey", "B", 200))


@query
def roc_points(spark, d):
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return agg.roc_points(rows.withColumn("score", F.floor(F.col("n_chars") / 50)), "score", F.col("quality") == 1)


@query
def accuracy_metrics(spark, d):
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    said, true = F.col("n_chars") > 800, F.col("quality") == 1
    out = rows.groupBy("lang").agg(F.avg(said.cast("int")).alias("share"), F.try_divide(F.sum((said & true).cast("int")), F.sum(true.cast("int"))).alias("sensitivity"), F.try_divide(F.sum((~said & ~true).cast("int")), F.sum((~true).cast("int"))).alias("specificity"))
    return out.select("lang", *[F.round(c, 9).alias(c) for c in ("share", "sensitivity", "specificity")])


@query
def coclustering_recall(spark, d):
    """Pairs of a read's alignments that a clustering keeps together, from group sizes rather than pairs."""
    c = _clusters(spark, d).select("read_id", "chromosome")
    both = c.groupBy("read_id", "chromosome").agg(F.count("*").alias("n"))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    true = both.groupBy("read_id").agg(F.sum("n").alias("n")).groupBy().agg(pairs.alias("t"))
    return both.groupBy().agg(pairs.alias("k")).crossJoin(true).select(F.col("k").cast("long").alias("kept"), F.col("t").cast("long").alias("true_pairs"))  # two single rows


@query
def group_max_broadcast(spark, d):
    from pyspark.sql import Window

    a = view(spark, d, "aln").select("library_id", "read_id", "align_id", "mate_score").distinct()
    return a.withColumn("top", F.max("mate_score").over(Window.partitionBy(*READ))).where("mate_score = top").select("library_id", "read_id", "align_id", "top")


@query
def segment_edges(spark, d):
    return agg.segments(agg.unpivot_ends(_ends(spark, d), ["prediction_id"]))


@query
def cluster_size_filter(spark, d):
    c = _clusters(spark, d)
    return c.groupBy("cluster_id").agg(F.count("*").alias("n"), F.countDistinct(*READ).alias("n_reads")).where("n >= 2 and n_reads >= 2")


@query
def connected_components(spark, d):
    a = view(spark, d, "aln").where("mate_score >= 0")
    edges = a.select((F.col("read_id") * 2).alias("a"), (F.col("position") % 200003 * 2 + 1).alias("b"))
    return graph.connected_components(edges, "a", "b")


@query
def linkage_clusters(spark, d):
    b = _ends(spark, d)
    p = b.select("prediction_id", F.col("chromosome_1").alias("part"), F.col("position_1").alias("x"), F.col("position_2").alias("y"))
    return graph.linkage(p, "prediction_id", 300)


@query
def set_cover_assign(spark, d):
    sets = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("set_id"), F.col("l_orderkey").alias("element"))
    return graph.set_cover(sets, sets.select("set_id").distinct().withColumn("weight", 1.0 + (F.col("set_id") % 10) / 10.0))


@query
def banded_alignment(spark, d):
    s = view(spark, d, "seqs").select("doc_id", F.col("seq").alias("ref"), F.concat(F.substring("seq", 1, 20), F.substring("seq", 22, 50)).alias("read"))
    return s.select("doc_id", align.banded_alignment("ref", "read").alias("a")).select("doc_id", F.element_at("a.scores", -1).alias("score"), F.element_at("a.ref_lengths", -1).alias("ref_length"))


@query
def seed_alignment(spark, d):
    s = view(spark, d, "seqs")
    return s.select("doc_id", align.seed_alignment(F.col("seq"), F.substring("seq", 30, 16)).alias("a")).select("doc_id", F.array_max("a").alias("score"), F.array_position("a", F.array_max("a")).alias("position"))


@query
def best_split(spark, d):
    s = view(spark, d, "seqs")
    read = F.concat(F.substring("seq", 1, 30), F.substring("seq", 101, 30))
    rows = s.select("doc_id", align.banded_alignment(F.substring("seq", 1, 60), read).alias("f"), align.banded_alignment(F.reverse(F.substring("seq", 71, 60)), F.reverse(read)).alias("r"))
    return rows.select("doc_id", align.split_alignment("f.scores", "r.scores").alias("x")).select("doc_id", "x.score", "x.first", "x.second")


@query
def gibbs_clusters(spark, d):
    b = _ends(spark, d)
    p = graph._cut(b.select("prediction_id", F.col("chromosome_1").alias("part"), F.col("position_1").alias("x"), F.col("position_2").alias("y")))  # read many times
    comp = graph.linkage(p, "prediction_id", 60)
    pairs = p.join(comp, "prediction_id").select("component", F.col("prediction_id").alias("pair_id"), F.col("x").cast("double"), F.col("y").cast("double"), F.lit(300.0).alias("u"), F.lit(30.0).alias("s"))
    return graph.mixture_clusters(pairs)


@query
def shortest_cycle(spark, d):
    b = _ends(spark, d)
    strand = [F.when(F.col(f"strand_{i}") == "+", 0).otherwise(1) for i in (1, 2)]
    ref = [F.col(f"chromosome_{i}").cast("int") for i in (1, 2)]
    rows = b.select((F.col("prediction_id") % 400).alias("component"), F.col("prediction_id").alias("id"), ref[0].alias("ref1"), strand[0].alias("strand1"), F.col("position_1").alias("pos1"), ref[1].alias("ref2"), strand[1].alias("strand2"), F.col("position_2").alias("pos2"), F.lit(0.1).alias("score"))
    return graph.shortest_cycles(rows, score_limit=40.0)


@query
def balanced_rearrangements(spark, d):
    b = _ends(spark, d).withColumn("patient_id", (F.col("prediction_id") % 2000).cast("string"))
    return graph.balanced_rearrangements(b.select("patient_id", "prediction_id", *[f"{c}_{i}" for i in (1, 2) for c in ("chromosome", "strand", "position")]), "patient_id")


@query
def mate_score_filter(spark, d):
    rows = _clusters(spark, d).groupBy("cluster_id").agg(F.avg("mate_score").alias("mate_score"))
    return filters.mate_score(rows, 48.0).select("cluster_id", F.round("mate_score", 6).alias("mate_score"))


@query
def chromosome_pair_filter(spark, d):
    b = view(spark, d, "brk").select("prediction_id", "chromosome_1", "chromosome_2")
    one = filters.chromosome_pairs(b, include=("1", "2")).withColumn("mode", F.lit("include"))
    return one.unionByName(filters.chromosome_pairs(b, exclude=("1", "2", "3")).withColumn("mode", F.lit("exclude"))).groupBy("mode", "chromosome_1", "chromosome_2").agg(F.count("*").alias("n"))


@query
def fragment_subsample(spark, d):
    """A tenth of the reads of chromosome 1 and half of the others."""
    a = view(spark, d, "aln").select(*READ, F.when(F.col("chromosome") == "1", 0.1).otherwise(0.5).alias("share")).distinct()
    return filters.subsample(a, READ, F.col("share")).select(*READ, "share")


@query
def length_filter(spark, d):
    a = view(spark, d, "aln")
    return filters.long_enough(a, stats.exponential_fit(_scores(spark, d).where("aligned_length >= 80")), READ).groupBy(*READ).agg(F.count("*").alias("n"))


@query
def discordant_fragments(spark, d):
    return filters.discordant_fragments(posterior(spark, d), 0.3)


@query
def likely_alignments(spark, d):
    return filters.likely_alignments(posterior(spark, d), READ, 0.1)


@query
def score_filter(spark, d):
    return filters.valid_scores(_scores(spark, d), score_cdf_threshold(spark, d)).groupBy("aligned_length", "score").agg(F.count("*").alias("n"))


@query
def window_guard(spark, d):
    score = filters.window_guard(F.col("mate_score"), F.col("position") % 100, F.col("aligned_length"))
    return view(spark, d, "aln").groupBy("library_id", "read_end").agg(F.sum(score).alias("score"), F.sum("mate_score").alias("unguarded"))


@query
def fragment_pairs(spark, d):
    a = view(spark, d, "aln").select(*READ, "read_end", "align_id", "chromosome")
    return joins.fragment_pairs(a, READ, exclude=("1", "2", "3", "4")).groupBy(*READ).agg(F.count("*").alias("n"))


@query
def break_reads(spark, d):
    a = view(spark, d, "aln")
    spanning = a.groupBy(*READ, "read_end", "align_id").agg(F.max("position").alias("position")).where("position % 3 <> 0")
    clusters = a.select((F.col("read_id") % 997).alias("cluster_id"), *READ, "read_end", "align_id").distinct()
    reads = a.where("mate_score < 70").groupBy(*READ, "read_end").agg(F.max("aligned_length").alias("length"))
    return joins.break_reads(view(spark, d, "bp"), clusters, spanning, reads, READ).select("cluster_id", "position_1", *READ, "read_end", "align_id", "position", "length")


@query
def left_neighbours(spark, d):
    ends = agg.unpivot_ends(_ends(spark, d), ["prediction_id"]).select((F.col("prediction_id") * 2 + F.col("side")).alias("id"), "chromosome", "strand", "position")
    return joins.left_neighbours(ends)


@query
def delaunay_space(spark, d):
    b = _ends(spark, d)
    s, t = seq.delaunay_space(F.col("position_1"), F.col("position_2"), F.lit(300))
    return b.select("prediction_id", s.alias("s"), t.alias("t"))


@query
def annotated_types(spark, d):
    """Types as coded and as intended; demo groups are predictions of one number modulo a third of the predictions' range."""
    b = _ends(spark, d)
    kind = seq.breakpoint_type(*[F.col(f"{c}_{i}") for i in (1, 2) for c in ("chromosome", "strand", "position")])
    rows = b.select("prediction_id", kind.alias("type"), F.abs(F.col("position_1") - F.col("position_2")).alias("dist"), F.floor(F.col("prediction_id") / 3).alias("g"))
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("type")).alias("kinds")).where("n >= 2")
    rows = rows.join(groups, "g", "left")
    types = [seq.annotated_type(F.col("type"), F.col("dist"), F.col("n"), F.col("kinds"), mode).alias(name) for mode, name in ((False, "as_coded"), (True, "as_intended"))]
    return rows.select("prediction_id", "dist", *types)


@query
def truth_table(spark, d):
    a = view(spark, d, "aln")
    found, truth = (a.where(w).select("chromosome", "strand", "position").distinct() for w in ("mate_score < 60", "mate_score > 40"))
    return joins.truth_table(found, truth, ["chromosome", "strand", "position"])


@query
def reference_regions(spark, d):
    return refdata.demo(spark, d)


@query
def predict_breaks(spark, d):
    return pipeline.demo_predict(spark, d)


@query
def tabulate_reads(spark, d):
    return pipeline.demo_reads(spark, d)


@query
def event_windows(spark, d):
    """An extension: the batch form of the windowed stream."""
    from svspark.streaming.mates import window_counts

    return window_counts(_t(spark, d, "events"), "1 hour")


@query
def event_mates(spark, d):
    """An extension: the batch form of the stream-stream mate join; views and clicks of a user within ten minutes."""
    from svspark.streaming.mates import stream_mates

    e = _t(spark, d, "events").where("event_type in ('view', 'click')")
    rows = e.select(F.col("user_id").alias("name"), "ts", "value", F.when(F.col("event_type") == "view", 0).otherwise(1).alias("read_end"))
    return stream_mates(rows).groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value_1"), 4).alias("v1"), F.round(F.sum("value_2"), 4).alias("v2"))
