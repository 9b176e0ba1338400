"""``python -m svspark`` (or spark-submit): ``predict`` and ``extract_somatic`` over tab-separated tables.

predict: clusters, spanning and split alignments to predictions.  extract_somatic: the breakpoint and library tables of a
run to somatic breakpoints.  Stages below ``--work`` are kept, so a run that was stopped goes on where it was.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from svspark.plans import pipeline, somatic
from svspark.plans.stages import stage
from svspark.sources.text import write_sorted, write_tsv


def _table(spark: SparkSession, path: str):
    rows = spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(path)
    return rows.withColumns({c: rows[c].cast("string") for c in rows.columns if c.startswith("chromosome")})


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="svspark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("predict")
    for name in ("clusters", "spanning", "split", "out"):
        one.add_argument(name)
    two = commands.add_parser("extract_somatic")
    for name in ("breakpoints", "libraries", "patients", "out"):
        two.add_argument(name)
    two.add_argument("--control", action="append", default=[])
    for command in (one, two):
        command.add_argument("--work", required=True, help="a folder that the driver and all executors share")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("svspark").getOrCreate()
    if args.command == "predict":
        tables = [_table(spark, p) for p in (args.clusters, args.spanning, args.split)]
        write_sorted(stage(spark, args.work, "predictions", lambda: pipeline.predict_breaks(*tables)), args.out, "cluster_id")
    else:
        tables = [_table(spark, p) for p in (args.breakpoints, args.libraries, args.patients)]
        write_tsv(stage(spark, args.work, "somatic", lambda: somatic.somatic(*tables, args.control)), args.out, header=True)


if __name__ == "__main__":
    main()
