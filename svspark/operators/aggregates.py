"""Grouped operators: consensus, best rows, votes, top-n, nearest flagged rows, segments, numbering and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svspark.operators.graph import _cut
from svspark.operators.joins import both_ways


def nested_mean(rows: DataFrame, outer: list[str], inner: list[str], value: str, name: str) -> DataFrame:
    """Mean over outer of the greatest value of each (outer, inner)."""
    return rows.groupBy(*outer, *inner).agg(F.max(value).alias("_m")).groupBy(*outer).agg(F.avg("_m").alias(name))


def span_envelope(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max("chromosome").alias("chromosome"), F.max("strand").alias("strand"), F.min("start").alias("start"), F.max("end").alias("end"))


def mode_consensus(rows: DataFrame, keys: list[str], text: str = "inserted") -> DataFrame:
    """Most frequent letter at each position of a group's strings; ties to the least letter."""
    letters = rows.select(*keys, F.posexplode(F.split(text, "")).alias("pos", "letter")).where("letter <> ''")
    counted = letters.groupBy(*keys, "pos", "letter").agg(F.count("*").alias("n"))
    best = counted.groupBy(*keys, "pos").agg(F.max_by("letter", F.struct("n", -F.ascii("letter"))).alias("letter"))
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "").alias("consensus"))


def best_row(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under a total order."""
    return top_n(rows, keys, order, 1).drop("rank")


def top_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with ``rank`` from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def nearest_flagged(ends: DataFrame, flag: str, key: str) -> DataFrame:
    """(key, distance): least distance of any of a key's breakends to a flagged one on its chromosome and strand.

    Ties in position see each other; null if there is none.  Positions are binned, see ``both_ways``.
    """
    at = F.when(F.col(flag), F.col("position"))
    near = both_ways(ends.select(key, flag, "chromosome", "strand", "position"), ["chromosome", "strand"], "position", at, -at)
    return near.select(key, F.least(F.col("position") - F.col("l"), -F.col("r") - F.col("position")).alias("d")).groupBy(key).agg(F.min("d").alias("distance"))


def segments(ends: DataFrame, width: int = 1_000_000) -> DataFrame:
    """(chromosome, start, end, length) between neighbouring distinct positions; the last one of a bin meets the first of the next."""
    places = ends.select("chromosome", "position").distinct().withColumn("_bin", F.floor(F.col("position") / width))
    firsts = places.groupBy("chromosome", "_bin").agg(F.min("position").alias("_first"))
    firsts = firsts.select("chromosome", "_bin", F.lead("_first").over(Window.partitionBy("chromosome").orderBy("_bin")).alias("_next"))
    nearest = F.lead("position").over(Window.partitionBy("chromosome", "_bin").orderBy("position"))
    found = places.select("chromosome", "_bin", F.col("position").alias("start"), nearest.alias("_lead")).join(firsts, ["chromosome", "_bin"])
    return found.select("chromosome", "start", F.coalesce("_lead", "_next").alias("end")).where("end is not null").withColumn("length", F.col("end") - F.col("start"))


def dense_ids(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Consecutive ids from 0 of the distinct keys in order, joined back to all rows.

    Keys are range-partitioned and counted; each partition numbers its own from its offset, so no task sees all keys.
    The partitions are written first: range bounds are sampled, and counts and numbers must come from the same ones.
    """
    spark = rows.sparkSession
    distinct = rows.select(*keys).distinct()
    parts = _cut(distinct.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()))
    counts = {r["_p"]: r["n"] for r in parts.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row for each partition
    total, starts = 0, []
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    base = spark.createDataFrame(starts or [(0, 0)], "_p int, _base long")
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*keys)) - 1
    ids = parts.withColumn("_n", local).join(F.broadcast(base), "_p").select(*keys, (F.col("_n") + F.col("_base")).cast("long").alias(name))
    return rows.join(ids, keys)


def pivot_counts(rows: DataFrame, key: str, library: str, count: str, libraries: list[str]) -> DataFrame:
    """One ``<library>_count`` column for each library, 0 where it has no rows."""
    out = rows.groupBy(key).pivot(library, libraries).agg(F.sum(count))
    return out.select(key, *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(f"{x}_count") for x in libraries])


def unpivot_ends(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The two breakends of each row as rows (keep, side, chromosome, strand, position)."""
    ends = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), *[F.col(f"{c}_{i + 1}").alias(c) for c in ("chromosome", "strand", "position")]) for i in (0, 1)])).alias("e")
    return rows.select(*keep, ends).select(*keep, "e.side", "e.chromosome", "e.strand", "e.position")


def roc_points(rows: DataFrame, score: str, label: Column) -> DataFrame:
    """(score, n_true, n_false): how many true and false rows score at least as much, for each distinct score.

    Scores are first counted, and only then cumulated, so the ordered pass sees distinct scores alone.
    """
    counted = rows.groupBy(score).agg(F.sum(F.when(label, 1).otherwise(0)).alias("t"), F.sum(F.when(label, 0).otherwise(1)).alias("f"))
    w = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    return counted.select(score, F.sum("t").over(w).cast("long").alias("n_true"), F.sum("f").over(w).cast("long").alias("n_false"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in exactly one of two sets."""
    both = a.distinct().withColumn("_in", F.lit(1)).unionByName(b.distinct().withColumn("_in", F.lit(1)))
    return both.groupBy(*a.columns).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
