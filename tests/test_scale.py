"""Operators that number or link rows must not depend on how rows are dealt to tasks."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from svspark.operators import graph
from svspark.operators.aggregates import dense_ids
from svspark.sources import text


def test_dense_ids_of_a_million_keys_are_consecutive(spark):
    rows = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("k")).repartition(8)
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    try:
        ids = dense_ids(rows, ["k"], "n")
        lag = ids.where("n % 1000 = 0 or n < 50").orderBy("n").collect()
        n, most, least, distinct = ids.agg(F.count("*"), F.max("n"), F.min("n"), F.countDistinct("n")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert (n, most, least, distinct) == (1_000_000, 999_999, 0, 1_000_000)
    assert [r.k for r in lag] == sorted(r.k for r in lag)


def test_records_of_split_files_stay_whole(spark, tmp_path):
    reads, d = {}, tmp_path / "reads"
    d.mkdir()
    for f, n in (("a", 3001), ("b", 2003)):
        lines = []
        for i in range(n):
            seq = "ACGT" * (1 + i % 7)
            reads[(f"{f}{i}", i % 2)] = seq
            lines += [f"@{f}{i}/{i % 2 + 1}", seq, "+", "@" * len(seq)]
        (d / f"{f}.fastq").write_text("\n".join(lines) + "\n")
    fasta, tiles, rng = [], set(), random.Random(3)
    for c in range(7):
        fasta.append(f">chr{c} x")
        at = 1
        for _ in range(rng.randrange(1, 900)):
            s = "".join(rng.choice("ACGT") for _ in range(rng.choice((60, 60, 7))))
            fasta.append(s)
            tiles.add((f"chr{c}", at, s))
            at += len(s)
    (tmp_path / "g.fa").write_text("\n".join(fasta) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4001")
    try:
        assert {(r.fragment, r.read_end): r.seq for r in text.read_fastq(spark, str(d)).collect()} == reads
        assert {(r.chromosome, r.start, r.seq) for r in text.read_fasta(spark, str(tmp_path / "g.fa")).collect()} == tiles
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_components_of_long_chains_take_few_rounds(spark):
    rounds = []
    order = list(range(4000))
    random.Random(5).shuffle(order)
    pairs = [*zip(order, order[1:], strict=False), *zip(range(10_000, 12_000), range(10_001, 12_001), strict=True)]
    edges = spark.createDataFrame(pairs, "a long, b long")

    def save(df):
        rounds.append(1)
        return graph._cut(df)

    got = {r.vertex: r.component for r in graph.star_components(edges, "a", "b", save).collect()}
    assert got == {**{v: 0 for v in order}, **{v: 10_000 for v in range(10_000, 12_001)}}
    assert len(rounds) <= 2 * 14 + 1


def test_linkage_equals_all_pairs(spark):
    rng = random.Random(1)
    points = [(i, rng.choice("ab"), rng.randrange(0, 900), rng.randrange(0, 900)) for i in range(300)] + [(1000 + i, "a", 5000 + i % 20, 5000 + i // 20) for i in range(400)]
    got = {r.id: r.component for r in graph.linkage(spark.createDataFrame(points, "id long, part string, x long, y long"), "id", 40).collect()}
    parent = {p[0]: p[0] for p in points}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, p in enumerate(points):
        for q in points[i + 1 :]:
            if p[1] == q[1] and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 < 1600:
                x, y = sorted((find(p[0]), find(q[0])))
                parent[y] = x
    assert got == {k: find(k) for k in parent}


def test_truths_that_are_near_at_one_end_only_are_not_paired(spark):
    """Each found breakpoint shares its first end with all truths; an operator that joins one end at a time makes 4 million rows."""
    from svspark.operators.aggregates import unpivot_ends
    from svspark.operators.joins import truth_match

    def ends(rows):
        table = spark.createDataFrame(rows, "id long, chromosome_1 string, strand_1 string, position_1 long, chromosome_2 string, strand_2 string, position_2 long")
        return unpivot_ends(table, ["id"])

    found = ends([(i, "1", "+", 1000, "2", "-", 1000 * i) for i in range(2000)])
    truth = ends([(9000 + i, "2", "-", 1000 * i + 7, "1", "+", 1100) for i in range(2000)] + [(5000 + i, "2", "-", 7007, "1", "+", 1100) for i in range(2000)])
    matched = truth_match(found, truth, 200)
    got = {r.prediction_id: (r.true_id, r.distance) for r in matched.collect()}
    assert got == {i: (5000 if i == 7 else 9000 + i, 107) for i in range(2000)}
    joins = []

    def walk(node):
        if "Join" in node.nodeName():
            joins.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            walk(node.plan())

    walk(matched._jdf.queryExecution().executedPlan())
    assert joins and max(joins) < 100_000


def test_set_cover_holds_a_component_in_few_bytes(spark):
    """A component arrives as sorted batches and is two arrays; as a pandas group it took over 300 bytes a row."""
    rng = np.random.default_rng(2)
    rows = sorted({(int(s), int(e)) for s, e in zip(rng.integers(0, 60, 700), rng.integers(0, 200, 700), strict=True)})
    weight = {s: 1.0 + s % 10 / 10 for s in range(60)}
    cover = graph.set_cover(spark.createDataFrame([(s, f"e{e}") for s, e in rows], "set_id long, element string"), spark.createDataFrame(list(weight.items()), "set_id long, weight double"))
    sets, want, done = {s: {e for t, e in rows if t == s} for s, _ in rows}, {}, set()
    while any(m - done for m in sets.values()):
        _, s = min((weight[s] / len(m - done), s) for s, m in sets.items() if m - done)
        want |= {f"e{e}": (s, len({p for _, p in want.values()})) for e in sets[s] - done}
        done |= sets[s]
    assert {r.element: (r.set_id, r.pick) for r in cover.collect()} == want
    assert "MapInArrow" in cover._jdf.queryExecution().toString() and "FlatMapGroups" not in cover._jdf.queryExecution().toString()
    sets, codes = np.repeat(np.arange(10_000), 30), rng.integers(0, 75_000, 300_000).astype(np.int32)
    tracemalloc.start()
    graph._greedy(sets, codes, np.ones(len(sets)), 75_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * len(sets)
