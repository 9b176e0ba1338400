"""Queries read whole tables and whole texts."""

import duckdb
import pytest
from compare import connect, differences
from test_queries import SF

from svspark.plans.oracles import ORACLE_SQL
from svspark.plans.queries import QUERIES
from svspark.plans.views import view

TEXTS = [(1, "Ab, c" * 90), (2, "short"), (3, "x" * 450 + "acgt" * 30), (4, ""), (5, None), (6, "the quick brown fox jumps over the lazy dog " * 40), (7, "q" * 21)]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def letters(text: str) -> str:
    return "".join("ACGT"[(ord(c) - 97) % 4] for c in text.lower() if "a" <= c <= "z")


def test_alignments_read_whole_texts(spark, small):
    from svspark.operators.align import best_split, end_to_end, prefix_scores

    seqs = {i: letters(t) for i, t in TEXTS if t is not None}
    assert {r.doc_id: r.seq for r in view(spark, small, "seqs").collect()} == seqs
    one = lambda ref, read, band=7: prefix_scores([ref], [read], band)[0]
    banded, seeds, splits = {}, {}, {}
    for i, s in seqs.items():
        scores, lengths = one(s, s[:20] + s[21:71])
        banded[i] = (scores[-1], lengths[-1])
        ends = end_to_end(s, s[29:45])
        seeds[i] = (max(ends), ends.index(max(ends)) + 1) if ends else (None, None)
        read = s[:30] + s[100:130]
        splits[i] = best_split(one(s[:60], read)[0], one(s[70:130][::-1], read[::-1])[0]) or (None, None, None)
    assert {r.doc_id: (r.score, r.ref_length) for r in QUERIES["banded_alignment"](spark, small).collect()} == banded
    assert {r.doc_id: (r.score, r.position) for r in QUERIES["seed_alignment"](spark, small).collect()} == seeds
    assert {r.doc_id: (r.score, r.first, r.second) for r in QUERIES["best_split"](spark, small).collect()} == splits
    far = prefix_scores(["A" * 5000, "ACG"], ["AAAA", "ACGTACGTACGTACGT"])
    assert far == [one("A" * 5000, "AAAA"), one("ACG", "ACGTACGTACGTACGT")]


LINES = "l_suppkey long, l_orderkey long, l_linenumber long, l_partkey long, l_returnflag string, l_quantity double, l_discount double"


def orders(spark, tmp_path, *rows):
    """A lineitem table of (order, supplier, parts): one line for each part; and DuckDB over it."""
    lines = [(supplier, order, k, part, "N", 1.0, 0.03) for order, supplier, parts in rows for k, part in enumerate(parts, 1)]
    spark.createDataFrame(lines, LINES).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    return str(tmp_path), con


def test_somatic_queries_read_every_id(spark, tmp_path):
    d, con = orders(spark, tmp_path, (7001, 1, (23, 46)), (9001, 4, (69, 92)), (2001, 4, (115, 138)), (12001, 1, (161, 184)))
    got = {name: QUERIES[name](spark, d) for name in ("somatic_filter", "changepoints")}
    for name, df in got.items():
        assert differences(df, con, ORACLE_SQL[name]) == []
    assert {r.prediction_id for r in got["somatic_filter"].collect()} == {7001, 12001}
    assert {r.position for r in got["changepoints"].collect()} == {2301, 4601, 16101, 18401}


def test_components_have_every_edge(spark, tmp_path):
    # reads 5 and 10 meet only by way of 7, which 5 does not divide
    d, con = orders(spark, tmp_path, (5, 1, (10,)), (7, 2, (10, 20)), (10, 3, (20,)), (11, 1, (30,)))
    got = QUERIES["connected_components"](spark, d)
    assert differences(got, con, ORACLE_SQL["connected_components"]) == []
    of = {r.vertex: r.component for r in got.collect()}
    assert of[10] == of[14] == of[20] == 10 and of[22] == 22


def test_shards_have_every_row(spark, con):
    every, distinct = con.execute("with a as (select distinct l_suppkey % 4 as lib, l_orderkey as read_id, l_linenumber as n, l_partkey * 100 + floor(l_quantity) as position, l_partkey, l_quantity, l_discount, l_returnflag = 'R' as s from lineitem) select count(*) + count(*) filter (where read_id % 6 = 0), count(distinct (read_id, position)) from a").fetchone()
    got = QUERIES["union_shards"](spark, SF).collect()
    assert [(r.n_all, r.n_distinct) for r in got] == [(every, distinct)]
