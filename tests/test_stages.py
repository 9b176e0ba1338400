"""Stages, sinks and the command line."""

import pytest
from pyspark.sql import functions as F

from svspark.__main__ import main
from svspark.operators import filters
from svspark.plans.queries import QUERIES
from svspark.plans.stages import stage
from svspark.sources import text
from svspark.streaming import mates  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_a_stage_is_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    assert stage(spark, str(tmp_path), "a", build).count() == stage(spark, str(tmp_path), "a", build).count() == 5 and len(built) == 1
    (tmp_path / "a" / "_SUCCESS").unlink()
    assert stage(spark, str(tmp_path), "a", build).count() == 5 and len(built) == 2


def test_exact_samples(spark):
    rows = spark.range(100).withColumn("x", F.lit(1))
    one, two = (sorted(r.id for r in filters.sample_exact(rows.repartition(n), ["id"], 20).collect()) for n in (2, 7))
    assert one == two and len(one) == 20
    with pytest.raises(ValueError):
        filters.sample_exact(rows, ["id"], 101)


def test_all_pairs_of_a_file_become_reads(spark, tmp_path):
    rows = [("b", 0, "+", "ACG", "abc", 0x40), ("b", 1, "-", "AAC", "xyz", 0x80), ("a", 0, "-", "TTG", "123", 0x50), ("a", 1, "+", "C", "4", 0x80), ("a", 1, "+", "GG", "55", 0x180), ("bad", 0, "+", "A", "1", 0x240), ("bad", 1, "+", "A", "1", 0x80), ("one", 0, "+", "A", "1", 0x40)]
    df = spark.createDataFrame(rows, "read_id string, read_end int, strand string, seq string, qual string, flag int")
    want = {("a", 0, "CAA", "a", "321"), ("a", 1, "C", "a", "4"), ("b", 0, "ACG", "b", "abc"), ("b", 1, "GTT", "b", "zyx")}
    assert set(map(tuple, text.paired_reads(df).collect())) == want
    renamed = text.paired_reads(df, rename=True)
    assert set(map(tuple, renamed.collect())) == {({"a": "0", "b": "1"}[f], *rest) for f, *rest in want}
    text.write_fastq(renamed, str(tmp_path / "out"))
    assert text.read_fastq(spark, str(tmp_path / "out")).count() == 4


def test_sorted_sink(spark, tmp_path):
    df = spark.createDataFrame([(10, "b"), (9, "z"), (10, "a"), (100, "c")], "cluster_id long, name string").repartition(3)
    text.write_sorted(df, str(tmp_path / "t"), "cluster_id")
    files = sorted(p for p in (tmp_path / "t").iterdir() if p.name.startswith("part"))
    assert "".join(p.read_text() for p in files).splitlines() == ["9\tz", "10\ta", "10\tb", "100\tc"]


def test_extract_somatic_from_the_command_line(spark, tmp_path):
    from svspark.plans import somatic
    from svspark.plans.queries import _ends
    from svspark.plans.views import view

    inputs = somatic.demo_inputs(_ends(spark, SF), view(spark, SF, "brklib"))
    for name, table in zip(("breakpoints", "libraries", "patients"), inputs, strict=False):
        text.write_tsv(table, str(tmp_path / name), header=True)
    main(["extract_somatic", *(str(tmp_path / n) for n in ("breakpoints", "libraries", "patients", "out")), "--control", "lib0", "--work", str(tmp_path / "work")])
    got = spark.read.parquet(str(tmp_path / "work" / "somatic"))
    assert got.count() == QUERIES["somatic_filter"](spark, SF).count()
    assert (tmp_path / "out" / "_SUCCESS").exists()
