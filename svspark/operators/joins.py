"""Joins as DataFrame expressions; range joins bin their keys so that they stay equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svspark.operators.filters import chromosome_pairs


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all common columns."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("no common columns")
    return left.join(right, common, how)


def semi_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose key is in right; each once, whatever right repeats."""
    return left.join(right.select(*keys), keys, "left_semi")


def or_semi_join(left: DataFrame, right: DataFrame, either: list[list[tuple[str, str]]]) -> DataFrame:
    """Distinct rows of left that match right under any of several key lists; a union of semi-joins, not a nested loop."""
    parts = []
    for keys in either:
        names = right.select(*[F.col(b).alias(f"_{i}") for i, (_, b) in enumerate(keys)])
        cond = [F.col(a) == F.col(f"_{i}") for i, (a, _) in enumerate(keys)]
        parts.append(left.join(names, cond, "left_semi"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def mate_pairs(rows: DataFrame, keys: list[str], end: str = "read_end") -> DataFrame:
    """End 0 with end 1 of each key, columns suffixed _1 and _2; all combinations within a key."""

    def side(which: int, suffix: str) -> DataFrame:
        return rows.where(F.col(end) == which).select(*keys, *[F.col(c).alias(f"{c}{suffix}") for c in rows.columns if c not in [*keys, end]])

    return side(0, "_1").join(side(1, "_2"), keys)


def fragment_pairs(rows: DataFrame, keys: list[str], include: tuple[str, str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Every alignment of end 0 with every one of end 1 of a fragment, less the pairs that ``chromosome_pairs`` drops."""
    return chromosome_pairs(mate_pairs(rows, keys), include, exclude)


def break_reads(breakpoints: DataFrame, clusters: DataFrame, spanning: DataFrame, reads: DataFrame, keys: list[str]) -> DataFrame:
    """Breakpoints with the alignments of their clusters' members and those members' sequences; members that ``spanning`` or ``reads`` lack are skipped."""
    members = clusters.join(spanning, [*keys, "read_end", "align_id"])
    return breakpoints.join(members, "cluster_id").join(reads, [*keys, "read_end"])


def left_neighbours(ends: DataFrame, key: str = "id") -> DataFrame:
    """(key, left): the nearest breakend of the opposite strand to the left on its chromosome; null if there is none.

    A + breakend lies before a - breakend of the same position; of several in one place the greatest id is nearest.
    """
    placed = ends.select(key, "chromosome", "strand", (F.col("position") * 2 + F.when(F.col("strand") == "-", 1).otherwise(0)).alias("_at"))
    out = None
    for own, other in (("+", "-"), ("-", "+")):
        there = F.when(F.col("strand") == other, F.struct("_at", F.col(key).alias("id")))
        found = both_ways(placed, ["chromosome"], "_at", there, F.lit(None).cast("int")).where(F.col("strand") == own).select(key, F.col("l.id").alias("left"))
        out = found if out is None else out.unionByName(found)
    return out


def truth_table(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of predictions and truth on all keys, with ``status``: both, found_only or truth_only."""
    one, two = found.withColumn("_f", F.lit(True)), truth.withColumn("_t", F.lit(True))
    both = one.join(two, keys, "full")
    status = F.when(F.col("_f") & F.col("_t"), "both").when(F.col("_f"), "found_only").otherwise("truth_only")
    return both.withColumn("status", status).drop("_f", "_t")


def both_ends(rows: DataFrame, keys: list[str], end: str = "read_end") -> DataFrame:
    """Keys with rows of both ends."""
    return rows.groupBy(*keys).agg(F.countDistinct(end).alias("_ends")).where("_ends = 2").drop("_ends")


def discordant(rows: DataFrame, keys: list[str], max_fragment: int) -> DataFrame:
    """Rows of fragments without any pair on one chromosome, + before -, of an inferred length in [0, max_fragment)."""
    pairs = mate_pairs(rows.select(*keys, "read_end", "chromosome", "strand", "position"), keys)
    plus, minus = (F.when(F.col("strand_1") == a, F.col("position_1")).otherwise(F.col("position_2")) for a in ("+", "-"))
    size = minus - plus + 1
    near = pairs.where((F.col("chromosome_1") == F.col("chromosome_2")) & (F.col("strand_1") != F.col("strand_2")) & (size >= 0) & (size < max_fragment))
    return rows.join(near.select(*keys), keys, "left_anti")


def point_in_interval(points: DataFrame, regions: DataFrame, position: str = "position", width: int = 10_000) -> DataFrame:
    """All (point, region) pairs with start <= position <= end on one chromosome; regions repeat in each bin they touch."""
    binned = regions.select("chromosome", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_bin"))
    return points.withColumn("_bin", F.floor(F.col(position) / width)).join(binned, ["chromosome", "_bin"]).where(F.col(position).between(F.col("start"), F.col("end"))).drop("_bin")


def contained(queries: DataFrame, regions: DataFrame, width: int = 10_000) -> DataFrame:
    """(query, region) pairs with the query's [q_start, q_end] inside a region."""
    binned = regions.select("chromosome", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_bin"))
    return queries.withColumn("_bin", F.floor(F.col("q_start") / width)).join(binned, ["chromosome", "_bin"]).where((F.col("q_start") >= F.col("start")) & (F.col("q_end") <= F.col("end"))).drop("_bin")


def excluded_reads(alignments: DataFrame, regions: DataFrame, keys: list[str], ends: int = 2) -> DataFrame:
    """Keys of reads of which at least ``ends`` ends have an alignment in a region."""
    hit = point_in_interval(alignments, regions).select(*keys, "read_end").distinct()
    return hit.groupBy(*keys).agg(F.count("*").alias("_ends")).where(F.col("_ends") >= ends).drop("_ends")


def tolerance_join(breaks: DataFrame, known: DataFrame, tolerance: int = 500) -> DataFrame:
    """(prediction_id, id) with overlapping intervals whose starts and ends differ by less than the tolerance.

    breaks: prediction_id, chromosome, start, end; known: id, chromosome, start, end.
    """
    near = known.select("chromosome", "id", F.col("start").alias("k_start"), F.col("end").alias("k_end"), F.explode(F.array(*[F.floor(F.col("start") / tolerance) + d for d in (-1, 0, 1)])).alias("_bin"))
    pairs = breaks.withColumn("_bin", F.floor(F.col("start") / tolerance)).join(near, ["chromosome", "_bin"])
    ok = (F.abs(F.col("start") - F.col("k_start")) < tolerance) & (F.abs(F.col("end") - F.col("k_end")) < tolerance) & (F.col("start") <= F.col("k_end")) & (F.col("end") >= F.col("k_start"))
    return pairs.where(ok).select("prediction_id", "id")


def both_ways(rows: DataFrame, keys: list[str], at: str, left: Column, right: Column, width: int = 1_000_000) -> DataFrame:
    """``rows`` with ``l``, the greatest ``left`` at places up to its own, and ``r``, the greatest ``right`` at places from its own on.

    Places are cut into bins of ``width``: a task holds a bin of a key and not the whole key, and bins hand their greatest
    values on.  Frames are ranges, so ties see each other; both frames grow, none is begun anew for each row.
    """
    binned = rows.withColumns({"_bin": F.floor(F.col(at) / width), "_l": left, "_r": right})
    own = Window.partitionBy(*keys, "_bin")
    over = Window.partitionBy(*keys)
    tops = binned.groupBy(*keys, "_bin").agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    before = F.max("_l").over(over.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    after = F.max("_r").over(over.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(*keys, "_bin", before.alias("_before"), after.alias("_after"))
    up = F.max("_l").over(own.orderBy(at).rangeBetween(Window.unboundedPreceding, 0))
    down = F.max("_r").over(own.orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, 0))
    near = binned.withColumns({"_up": up, "_down": down}).join(tops, [*keys, "_bin"])
    return near.withColumns({"l": F.greatest("_up", "_before"), "r": F.greatest("_down", "_after")}).drop("_bin", "_l", "_r", "_up", "_down", "_before", "_after")


def nearest_feature(points: DataFrame, features: DataFrame, key: str = "point_id") -> DataFrame:
    """(key, feature_id, distance): the nearest feature on the point's chromosome, 0 inside; ties to the lesser id.

    An as-of join in both directions: the union of points and feature edges is ordered once for each side, so
    no pair outside the answer is made.  Features may overlap; the greatest end so far stands for all that begin before.
    """
    p = points.select("chromosome", F.col("position").alias("at"), F.col(key).alias("pid"), F.lit(1).alias("kind"), F.lit(None).cast("struct<e:bigint,i:bigint>").alias("left"), F.lit(None).cast("struct<s:bigint,i:bigint>").alias("right"))
    f = features.select("chromosome", F.col("start").alias("at"), F.lit(None).cast("long").alias("pid"), F.lit(0).alias("kind"), F.struct(F.col("end").alias("e"), (-F.col("feature_id")).alias("i")).alias("left"), F.struct((-F.col("start")).alias("s"), (-F.col("feature_id")).alias("i")).alias("right"))
    both = both_ways(p.unionByName(f), ["chromosome"], "at", F.col("left"), F.col("right"))
    dl, dr = F.greatest(F.lit(0), F.col("at") - F.col("l.e")), -F.col("r.s") - F.col("at")
    il, ir = -F.col("l.i"), -F.col("r.i")
    left = F.col("l").isNotNull() & (F.col("r").isNull() | (dl < dr) | ((dl == dr) & (il <= ir)))
    return both.where("kind = 1").select(F.col("pid").alias(key), F.when(left, il).otherwise(ir).alias("feature_id"), F.when(left, dl).otherwise(dr).alias("distance"))


def truth_match(found: DataFrame, truth: DataFrame, tolerance: int = 200) -> DataFrame:
    """Best (prediction_id, true_id): both breakends within the tolerance on equal chromosome and strand, on distinct sides of the truth.

    found and truth are breakends (id, side, chromosome, strand, position); least total distance, then least id.  Both ends are
    joined at once, so no pair is made that is near at one end only; of truths in one place the least id stands for all.
    """
    at = ["chromosome", "strand", "position"]
    place = [f"{c}_{i}" for i in (1, 2) for c in at]

    def both(rows: DataFrame, sides) -> DataFrame:
        ends = rows.where("id is not null").groupBy("id").agg(F.collect_list(F.struct("side", *at)).alias("one")).withColumn("two", F.col("one"))
        for c in ("one", "two"):
            ends = ends.withColumn(c, F.explode(c))
        return ends.where(sides).select("id", *[F.col(f"{e}.{c}").alias(f"{c}_{i}") for i, e in ((1, "one"), (2, "two")) for c in at])

    ours = both(found, "one.side = 0 and two.side = 1")
    theirs = both(truth, "one.side <> two.side").groupBy(*place).agg(F.min("id").alias("true_id"))
    cell = [F.floor(F.col(f"position_{i}") / (tolerance + 1)) for i in (1, 2)]
    key = [f"{c}_{i}" for i in (1, 2) for c in ("chromosome", "strand", "_bin")]
    near = theirs
    for i in (1, 2):
        near = near.withColumn(f"_bin_{i}", F.explode(F.array(*[cell[i - 1] + d for d in (-1, 0, 1)])))
    near = near.select(*key, "true_id", F.col("position_1").alias("true_1"), F.col("position_2").alias("true_2"))
    apart = [F.abs(F.col(f"position_{i}") - F.col(f"true_{i}")) for i in (1, 2)]
    hits = ours.withColumns({f"_bin_{i}": cell[i - 1] for i in (1, 2)}).join(near, key).where((apart[0] <= tolerance) & (apart[1] <= tolerance))
    return hits.groupBy("id").agg(F.min(F.struct((apart[0] + apart[1]).alias("distance"), "true_id")).alias("b")).select(F.col("id").alias("prediction_id"), F.col("b.true_id").alias("true_id"), F.col("b.distance").alias("distance"))
