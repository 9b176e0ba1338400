"""Somatic selection: germline, DGV and multi-patient flags, distance to filtered breakends, final filter and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svspark.functions import seq
from svspark.operators import aggregates as agg
from svspark.operators import graph

# Fixed values.
CHROMOSOMES = [*map(str, range(1, 23)), "X", "Y"]


def _kept(distance: str = "dist_filtered") -> Column:
    return ~F.col("is_filtered") & (F.col(distance) > 50) & (F.col("num_reads") >= 2) & (F.col("num_split") >= 2) & (F.col("log_likelihood") > -20) & (F.col("template_length_min") > 120)


def flags(breakpoints: DataFrame, libraries: DataFrame, patients: DataFrame, controls: list[str]) -> DataFrame:
    """Breakpoints with num_patients, is_germline, is_dgv and is_filtered; missing counts as false."""
    present = libraries.where("num_reads > 0")
    per = present.join(patients, "library").groupBy("prediction_id").agg(F.countDistinct("patient_id").alias("num_patients"))
    germ = present.groupBy("prediction_id").agg(F.bool_or(F.col("library").isin(controls)).alias("is_germline"))
    out = breakpoints.join(per, "prediction_id", "left").join(germ, "prediction_id", "left")
    out = out.withColumns({"num_patients": F.coalesce("num_patients", F.lit(0)), "is_germline": F.coalesce("is_germline", F.lit(False)), "is_dgv": F.col("dgv_ids").isNotNull()})
    return out.withColumn("is_filtered", F.col("is_germline") | F.col("is_dgv") | (F.col("num_patients") > 1))


def with_distance(rows: DataFrame) -> DataFrame:
    """Distance to the nearest filtered breakend; null, and later dropped, where there is none."""
    near = agg.nearest_flagged(agg.unpivot_ends(rows, ["prediction_id", "is_filtered"]), "is_filtered", "prediction_id")
    return rows.join(near.withColumnRenamed("distance", "dist_filtered"), "prediction_id", "left")


def somatic(breakpoints: DataFrame, libraries: DataFrame, patients: DataFrame, controls: list[str], balanced: DataFrame | None = None) -> DataFrame:
    """(prediction_id, type, size, rearrangement_type, dist_filtered, num_patients) of somatic predictions."""
    kept = with_distance(flags(breakpoints, libraries, patients, controls)).where(_kept())
    if balanced is not None:
        kept = kept.join(balanced.select("prediction_id").distinct().withColumn("balanced", F.lit(True)), "prediction_id", "left")
    is_balanced = F.coalesce("balanced", F.lit(False)) if balanced is not None else F.lit(False)
    size = F.abs(F.col("position_1") - F.col("position_2"))
    return kept.select("prediction_id", "type", size.alias("size"), seq.rearrangement_type(F.col("type"), size, is_balanced).alias("rearrangement_type"), "dist_filtered", F.col("num_patients").cast("long").alias("num_patients"))


def balanced_of(kept: DataFrame, libraries: DataFrame, patients: DataFrame) -> DataFrame:
    """Balanced groups within each patient."""
    of = libraries.where("num_reads > 0").join(patients, "library").select("prediction_id", "patient_id").distinct()
    return graph.balanced_rearrangements(kept.join(of, "prediction_id").select("patient_id", "prediction_id", *[f"{c}_{i}" for i in (1, 2) for c in ("chromosome", "strand", "position")]), "patient_id")


def changepoints(breakpoints: DataFrame, libraries: DataFrame, controls: tuple[str, ...] = ("lib0",)) -> DataFrame:
    """Breakends (chromosome, position) of predictions that pass without DGV and patient terms, on the usual chromosomes."""
    germ = libraries.where("num_reads > 0").groupBy("prediction_id").agg(F.bool_or(F.col("library").isin(*controls)).alias("is_germline"))
    rows = breakpoints.join(germ, "prediction_id", "left").withColumn("is_filtered", F.coalesce("is_germline", F.lit(False)))
    kept = with_distance(rows).where(_kept())
    return agg.unpivot_ends(kept, ["prediction_id"]).where(F.col("chromosome").isin(CHROMOSOMES)).select("chromosome", "position").distinct()


def demo_inputs(ends: DataFrame, libraries: DataFrame):
    """Inputs of ``somatic`` from the derived views."""
    kind = seq.breakpoint_type(*[F.col(f"{c}_{i}") for i in (1, 2) for c in ("chromosome", "strand", "position")])
    m = F.col("mate_score")
    rows = ends.select(
        (F.col("prediction_id") % 100000000).alias("pid"), "library_id", *[f"{c}_{i}" for i in (1, 2) for c in ("chromosome", "strand", "position")], kind.alias("type"), m.alias("m"),
    )
    rows = rows.groupBy(F.col("pid").alias("prediction_id")).agg(F.min(F.struct("library_id", "chromosome_1", "strand_1", "position_1", "chromosome_2", "strand_2", "position_2", "type", "m")).alias("b"))
    m = F.col("b.m")
    b = rows.select("prediction_id", *[f"b.{c}_{i}" for i in (1, 2) for c in ("chromosome", "strand", "position")], "b.type", (m + 1).alias("num_reads"), (m % 7).alias("num_split"), (-m / 4.0).alias("log_likelihood"), (m * 10).alias("template_length_min"), F.when(m % 10 == 9, "dgv").alias("dgv_ids"))
    patients = libraries.sparkSession.createDataFrame([("p1", "lib0"), ("p1", "lib1"), ("p2", "lib2"), ("p2", "lib3")], "patient_id string, library string")
    return b, libraries, patients, ["lib0"]
