import inspect
import itertools
import math
import random
import sys
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from svspark.functions import seq
from svspark.operators import align, graph

# Golden cases of microhomology (strands, both sequences, homology), position 15 each.
CASES = [
    ("+", "-", "AGCTTAGCTAGCTTAAGATCGATCGGGATCGTAGCTAGCTA", "CGTAGCTAGGCTAGCATGCTAGCTAGATCGTAGCTAACGTAG", 0),
    ("+", "-", "AGCTTAGCTAGCTTACGATCGATCGGGATCGTAGCTAGCTA", "CGTAGCTAGGCTAGCATGCTAGCTAGATCGTAGCTAACGTAG", 1),
    ("+", "-", "AGCTTAGCTAGCTTACGATCGATCGGGATCGTAGCTAGCTA", "CGTAGCTAGGCTAACATGCTAGCTAGATCGTAGCTAACGTAG", 2),
    ("+", "-", "AGCTTAGCTAGCTTACATTCGATCGGGATCGTAGCTAGCTA", "CGTAGCTAGGCTTACATGCTAGCTAGATCGTAGCTAACGTAG", 8),
    ("+", "+", "AGCTTAGCTAGCTTACATTCGATCGGGATCGTAGCTAGCTA", "CGTAGCTAGGCTTACATGCTAGCTAGATCGTAGCTAACGTAG", 0),
    ("+", "+", "AGCTTAGCTAGCTTAGTATTCGATCGGGATCGTAGCTAGCTA", "CGTAGCTAGGCTTACATGCTAGCTAGATCGTAGCTAACGTAG", 3),
    ("+", "+", "AGCTTAGCTAGCTTAGTATTCGATCGGGATCGTAGCTAGCTA", "CGTAGCTAGGCTTACTAACTAGCTAGATCGTAGCTAACGTAG", 6),
    ("-", "-", "AGCTTAGCTAGCTTAGTATTCGATCGGGATCGTAGCTAGCTA", "CGTAGCTAGGCTTACTAACTAGCTAGATCGTAGCTAACGTAG", 0),
    ("-", "-", "AGCTTAGCTAGCTGAGTATTCGATCGGGATCGTAGCTAGCTA", "CGTAGCTAGGCTTTCTAACTAGCTAGATCGTAGCTAACGTAG", 2),
]


def test_microhomology_goldens(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, s1 string, s2 string, q1 string, q2 string, want int")
    got = df.select("i", "want", seq.microhomology(F.col("q1"), F.col("s1"), F.lit(15), F.col("q2"), F.col("s2"), F.lit(15), 10)["homology"].alias("h")).collect()
    assert [r.h for r in sorted(got)] == [c[4] for c in CASES]


def _scalar(ref, read, band, match=2, mismatch=-3, gap=-4):
    bad = -(10**6)
    out, prev = [], None
    for j in range(len(read) + 1):
        cur = [bad] * (len(ref) + 1)
        for i in range(max(0, j - band), min(len(ref), j + band) + 1):
            options = [0] if i == j == 0 else []
            if i and j and prev[i - 1] > bad:
                options.append(prev[i - 1] + (match if ref[i - 1] == read[j - 1] else mismatch))
            if i and cur[i - 1] > bad:
                options.append(cur[i - 1] + gap)
            if j and prev[i] > bad:
                options.append(prev[i] + gap)
            cur[i] = max(options, default=bad)
        top = max(cur)
        out.append((top, cur.index(top)))
        prev = cur
    return out


@pytest.mark.parametrize("band", [7, None])
def test_prefix_scores_equal_the_scalar_recurrence(band):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("ACGT", k=rng.randint(60, 90))), "".join(rng.choices("ACGT", k=rng.randint(20, 50)))) for _ in range(60)]
    pairs += [(r, r[: rng.randint(20, 40)] + r[45:55]) for r, _ in pairs[:20]]
    got = align.prefix_scores([p[0] for p in pairs], [p[1] for p in pairs], band)
    for (ref, read), (scores, lengths) in zip(pairs, got, strict=True):
        assert list(zip(scores, lengths, strict=True)) == _scalar(ref, read, band or 200)


def test_end_to_end_equals_brute_force():
    rng = random.Random(2)
    for _ in range(20):
        ref, seed = "".join(rng.choices("ACGT", k=40)), "".join(rng.choices("ACGT", k=16))
        got = align.end_to_end(ref, seed)
        for at in (1, 10, 25, 40):
            want = max(_scalar_global(ref[s:at], seed) for s in range(at + 1))
            assert got[at - 1] == want


def _scalar_global(a, b, match=2, mismatch=-3, gap=-4):
    row = [i * gap for i in range(len(a) + 1)]
    for j, c in enumerate(b, 1):
        new = [j * gap]
        for i, d in enumerate(a, 1):
            new.append(max(row[i - 1] + (match if c == d else mismatch), row[i] + gap, new[-1] + gap))
        row = new
    return row[-1]


def test_best_split_finds_the_cut():
    read = "ACGTACGGTCATTGCA" + "TTGACCAGTACCGGAT"
    f = align.prefix_scores([read[:16] + "AAAAAAAAAAAAAAAA"], [read])[0][0]
    r = align.prefix_scores([(("C" * 16) + read[16:])[::-1]], [read[::-1]])[0][0]
    assert align.best_split(f, r) == (64, 16, 16)
    assert align.best_split(f[:8], r[:8]) is None


def test_path_and_cycle_goldens():
    g = graph.BreakGraph([(1, 1, 0, 200, 2, 1, 100, 1), (2, 2, 0, 200, 3, 1, 100, 1)], 10, 1)
    assert g.path((1, 0, 100), (3, 1, 200)) == (32.0, [1, 2])
    g = graph.BreakGraph([(12511188, 11, 0, 70596341, 11, 0, 72732885, 4.97534e-07)], 2000, 200)
    score, ids = g.path((11, 0, 70596485), (11, 0, 72732835))
    assert ids == [12511188] and math.isclose(score, 0.74500048160552979, abs_tol=1e-6)
    g = graph.BreakGraph([(i, i + 1, 0, 200, (i + 1) % 4 + 1, 1, 100, 1) for i in range(4)], 10, 1)
    assert g.cycle(0) == (43.0, [0, 3, 2, 1, 0])
    rows = [(0, 6, 0, 17782176, 4, 1, 59212722, 1e-10), (1, 6, 0, 17782176, 4, 1, 59212722, 1e-11), (2, 6, 0, 17782176, 4, 1, 59212722, 1e-16), (3, 6, 0, 17782176, 3, 1, 59212722, 1)]
    rows += [(4, 2, 0, 11861249, 9, 0, 134085264, 2), (5, 2, 1, 11861626, 3, 0, 59212565, 3), (6, 6, 1, 17782626, 9, 1, 134085420, 2)]
    score, ids = graph.BreakGraph(rows, 10, 10).cycle(5)
    assert ids == [5, 4, 6, 3, 5] and math.isclose(score, 119.0)


def test_cycle_search_settles_each_breakend_once():
    rng = random.Random(8)
    for n in (3, 12, 70):
        rows = [(i, rng.randrange(1, 4), rng.randrange(2), rng.randrange(3000), rng.randrange(1, 4), rng.randrange(2), rng.randrange(3000), rng.choice([0, 0.1, 0.5, 2.0])) for i in range(n)]
        g = graph.BreakGraph(rows, 2000.0, 200.0)
        want = {}
        for i in range(n):  # relaxation of all breakends until nothing changes
            cost, changed = {(i, 1): 0.0}, True
            while changed:
                changed = False
                for e, v in list(cost.items()):
                    r, s, p = g.ends[e[0], 1 - e[1]]
                    for k, (r2, s2, q) in g.ends.items():
                        if (r2, s2) == (r, 1 - s) and k[0] != i and v + g.travel(s, p, q) + g.cost[k[0]] < cost.get(k, math.inf) - 1e-12:
                            cost[k], changed = v + g.travel(s, p, q) + g.cost[k[0]], True
            r, s, p = g.ends[i, 1]
            arrived = {e: g.ends[e[0], 1 - e[1]] for e in cost}
            want[i] = min((cost[e] + g.travel(1 - s, a[2], p) for e, a in arrived.items() if a[:2] == (r, 1 - s)), default=math.inf)
        want = {i: v for i, v in want.items() if v <= 30}
        one = {i: got[0] for i in range(n) if (got := g.cycle(i, score_limit=30.0, visit_limit=2 * n + 1)) and got[0] <= 30}
        together = {i: got for i, got in g.cycles(30.0) if got[0] <= 30}
        assert one == pytest.approx(want) and {i: v for i, (v, _) in together.items()} == pytest.approx(want)
        assert all(way[0] == way[-1] == i for i, (_, way) in together.items())


def test_equal_breakpoints_are_searched_once(spark):
    rng = random.Random(9)
    rows, plain = [], {}
    for c, n in ((0, 8), (1, 40)):
        base = [(rng.randrange(1, 4), rng.randrange(2), rng.randrange(3000), rng.randrange(1, 4), rng.randrange(2), rng.randrange(3000), 0.1) for _ in range(n)]
        mine = [(1000 * c + k, *base[k % n]) for k in range(2 * n - 2)]
        g = graph.BreakGraph(mine, 2000.0, 200.0)
        plain |= {i: got[0] for i, *_ in mine if (got := g.cycle(i, score_limit=30.0)) and got[0] <= 30}
        rows += [(c, *r) for r in mine]
    table = spark.createDataFrame(rows, "component int, id long, ref1 int, strand1 int, pos1 long, ref2 int, strand2 int, pos2 long, score double")
    got = {r.id: r for r in graph.shortest_cycles(table, score_limit=30.0).collect()}
    assert {i: r.score for i, r in got.items()} == pytest.approx(plain)
    assert all(r.path[0] == r.path[-1] == i and i not in r.path[1:-1] for i, r in got.items())
    # a chunk of searches that stand for several may pass their own breakpoint again
    first = {r[2:]: r[1:] for r in reversed(rows) if r[0]}
    g = graph.BreakGraph([*first.values()], 2000.0, 200.0)
    again = {i for i in g.cost if i - 1000 < 38}
    want = {i: got[0] for i in g.cost if (got := g.cycle(i, i in again, score_limit=30.0)) and got[0] <= 30}
    assert want == pytest.approx({i: plain[i] for i in g.cost if i in plain})
    assert {i: v for i, (v, _) in g.cycles(30.0, again=again) if v <= 30} == pytest.approx(want)


def test_perfect_matching_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.choice([2, 4, 6, 8])
        edges = {(a, b): rng.randint(-5, 9) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.7}

        def best(left):
            if not left:
                return 0
            a, rest = left[0], left[1:]
            return min((edges[a, b] + best([x for x in rest if x != b]) for b in rest if (a, b) in edges), default=math.inf)

        want = best(list(range(n)))
        got = graph.perfect_matching(list(range(n)), edges)
        assert (math.inf if got is None else got[0]) == want
        if got:
            assert sorted(v for e in got[1] for v in e) == list(range(n))


def test_blossoms_match_as_cheaply_as_the_sweep():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.choice([4, 8, 10, 14])
        edges = {(a, b): rng.randint(-5, 9) * rng.choice([1, 50]) for a, b in itertools.combinations(range(n), 2) if rng.random() < rng.choice([0.3, 0.8])}
        want, got = graph.perfect_matching(list(range(n)), edges, 10**9), graph.perfect_matching(list(range(n)), edges, 0)
        assert (want is None) == (got is None)
        if got:
            assert got[0] == want[0] == sum(edges[e] for e in got[1]) and sorted(v for e in got[1] for v in e) == list(range(n))


def test_groups_are_found_among_many_crossing_breakpoints():
    """The sweep alone would hold 2 to the power of dozens of states here."""
    columns = "prediction_id chromosome_1 strand_1 position_1 chromosome_2 strand_2 position_2".split()
    rng = random.Random(7)
    rows = [(i, f"a{rng.randrange(9)}", "+", 10**6 * (i + 1), f"b{rng.randrange(9)}", "-", 10**6 * rng.randrange(1, 999)) for i in range(70)]
    rows += [(100, "1", "+", 1000, "2", "-", 1001), (101, "2", "+", 1000, "1", "-", 1001)]
    assert graph.balanced_groups(pd.DataFrame(rows, columns=columns)) == [[100, 101]]


def test_blossoms_may_nest_deeper_than_the_stack():
    """A recursive search failed on 474 breakpoints of one patient at the usual limit; here the stack is shorter and 400 are enough."""
    columns = "prediction_id chromosome_1 strand_1 position_1 chromosome_2 strand_2 position_2".split()
    rng = random.Random(1)
    rows = pd.DataFrame([(i, *(x for _ in (1, 2) for x in ("1", rng.choice("+-"), rng.randrange(20_000)))) for i in range(400)], columns=columns)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(len(inspect.stack()) + 150)
    began = time.process_time()
    try:
        groups = graph.balanced_groups(rows)
    finally:
        sys.setrecursionlimit(limit)
    assert sum(map(len, groups)) == len({i for g in groups for i in g}) > 100 and time.process_time() - began < 4


def test_balanced_translocation_is_found():
    columns = "prediction_id chromosome_1 strand_1 position_1 chromosome_2 strand_2 position_2".split()
    rows = [(1, "1", "+", 1000, "2", "-", 1001), (2, "2", "+", 1000, "1", "-", 1001), (3, "5", "+", 10, "7", "-", 5)]
    assert graph.balanced_groups(pd.DataFrame(rows, columns=columns)) == [[1, 2]]


def test_cluster_probability_equals_the_long_form():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = rng.integers(1, 6)
        x, y, u, s = rng.uniform(0, 200, n), rng.uniform(0, 200, n), rng.uniform(100, 150, n), rng.uniform(25, 50, n)
        w = u - x.max() + x - y.max() + y
        norm = [(b * math.exp(-a * a / (2 * b * b)) + a * math.sqrt(2 * math.pi) * graph._phi(a / b)) / math.sqrt(2 * math.pi) for a, b in zip(u, s, strict=True)]
        alpha, beta, gamma = (1 / s**2).sum(), (w / s**2).sum(), (w**2 / s**2).sum()
        long = -sum(math.log(k * math.sqrt(2 * math.pi) * b) for k, b in zip(norm, s, strict=True)) - 0.5 * (gamma - beta**2 / alpha) - math.log(alpha)
        long += math.log(math.exp(-(beta**2) / (2 * alpha)) + beta * math.sqrt(2 * math.pi) * graph._phi(beta / math.sqrt(alpha)) / math.sqrt(alpha))
        assert abs(graph.cluster_log_prob(x, y, u, s) - long) < 1e-6


def test_mixture_recalls_separate_clusters():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.uniform(0, 150, 12), rng.uniform(3000, 3150, 12)])
    y = 300 - (x % 3000) + rng.normal(0, 30, 24)
    labels = graph.gibbs(x.tolist(), y.tolist(), [300.0] * 24, [30.0] * 24)
    assert not set(labels[:12]) & set(labels[12:])
    assert max(labels[:12].count(k) for k in set(labels[:12])) >= 8


def test_a_step_of_the_sampler_does_not_grow_with_its_clusters():
    rng = np.random.default_rng(6)
    for _ in range(30):
        n = rng.integers(1, 8)
        x, y, u, s = rng.uniform(0, 900, n), rng.uniform(0, 900, n), rng.uniform(100, 400, n), rng.uniform(25, 50, n)
        alone = sum(graph.cluster_log_prob([a], [b], [c], [d]) + (c * c) / (d * d) / 2 + math.log(1 / d**2) for a, b, c, d in zip(x, y, u, s, strict=True))
        tails = sum(math.log1p(c / d * graph._phi(c / d) * math.sqrt(2 * math.pi) * math.exp((c / d) ** 2 / 2)) for c, d in zip(u, s, strict=True))
        w = u + x + y
        got = graph._log_prob((1 / s**2).sum(), (w / s**2).sum(), (w * w / s**2).sum(), alone - tails, x.max() + y.max())
        assert abs(got - graph.cluster_log_prob(x, y, u, s)) < 1e-6
    x = rng.uniform(0, 150, 200)
    began = time.process_time()
    labels = graph.gibbs(x.tolist(), (300 - x + rng.normal(0, 30, 200)).tolist(), [300.0] * 200, [30.0] * 200)
    assert time.process_time() - began < 1.5 and len(labels) == 200


def test_the_sampler_works_out_equal_steps_once(monkeypatch):
    """Equal pairs share their place, and clusters that hold the same share what a pair would do to them."""
    calls, plain = [], graph._log_prob
    monkeypatch.setattr(graph, "_log_prob", lambda *a: calls.append(1) or plain(*a))
    x, y = [0.0, 40.0, 2000.0] * 40, [10.0, 0.0, 1500.0] * 40
    labels = graph.gibbs(x, y, [300.0] * 120, [30.0] * 120)
    assert labels == [0, 0, 2] * 40
    assert len(calls) < 20 * 120
    assert graph.gibbs([v + 777 for v in x], y, [300.0] * 120, [30.0] * 120) == labels
    near = graph._near([0.0, 5.0, 11.0, 400.0], [0.0, 9.0, 0.0, 0.0], 10.0)
    assert near == [[0, 1], [0, 1, 2], [1, 2], [3]]
