"""Reference tables: chromosome names of annotations and repeat regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remap_annotation(rows: DataFrame, names: DataFrame, column: str = "chromosome") -> DataFrame:
    """Ensembl to UCSC names; rows of unknown chromosomes are dropped.  names: ucsc, ensembl (a fixed small table)."""
    return rows.join(F.broadcast(names), rows[column] == names["ensembl"]).withColumn(column, F.col("ucsc")).drop("ucsc", "ensembl")


def repeat_regions(rows: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All repeats, and satellites, as closed 1-based regions with Ensembl names.  rows: chromosome, start (0-based), end, class."""
    named = rows.join(F.broadcast(names), rows["chromosome"] == names["ucsc"]).select(F.col("ensembl").alias("chromosome"), (F.col("start") + 1).alias("start"), "end", "class")
    return named.drop("class"), named.where("class = 'Satellite'").drop("class")


def remap_alignments(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose own and mate's reference are both known, renamed."""
    own, mate = names.select(F.col("old").alias("ref"), F.col("new").alias("_r")), names.select(F.col("old").alias("mate_ref"), F.col("new").alias("_m"))
    return rows.join(own, "ref").join(mate, "mate_ref").withColumns({"ref": F.col("_r"), "mate_ref": F.col("_m")}).drop("_r", "_m")


def demo(spark, d) -> DataFrame:
    """Satellite regions of each chromosome from the parts table."""
    names = spark.createDataFrame([(f"chr{i}", str(i)) for i in range(1, 21)], "ucsc string, ensembl string")
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("chr"), F.col("p_partkey") % 23 + 1).alias("chromosome"), (F.col("p_partkey") * 100).alias("start"), (F.col("p_partkey") * 100 + F.col("p_size")).alias("end"), F.when(F.col("p_size") % 2 == 0, "Satellite").otherwise("LINE").alias("class"))
    _, satellites = repeat_regions(rows, names)
    return satellites.groupBy("chromosome").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))
