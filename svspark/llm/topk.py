"""Exact top-k inner products over a pivot-distance index.

Vectors get one more coordinate that brings all to the greatest norm M, so that the greatest inner
product is the least distance: |q - x|^2 = |q|^2 + M^2 - 2 q.x.  They are keyed by nearest pivot and distance
to it, range-partitioned on that key and packed into sorted annuli of at most ``ANNULUS`` vectors; an annulus
knows its least and greatest distance to every pivot.  Queries are packed into blocks in the same order.

A search begins with a block's own annulus and expands to others in the order of their triangle-inequality bound,
|q - x| >= |d(q, p) - d(x, p)| for every pivot p, in rounds that grow: after each, every query's k-th
score is the one to beat, and the search stops once no annulus left can beat it.

Pivots are spread over a bounded sample and only affect speed.  All scores are exact integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svspark.llm.store import Workspace, small

#: Pivots for each dimension, chosen farthest first from at most SAMPLE vectors (least hashes); rows of an annulus and of a block of queries.
PIVOTS, SAMPLE, ANNULUS, QUERY_BLOCK = 32, 2048, 1024, 256
#: Vectors with a component or a norm beyond these have no place among the pivots; every query meets them.
MAX_COMPONENT, MAX_NORM2 = 2.0**31, 2.0**62
#: Annuli of a block's first round; each later round has GROWTH times as many.
FIRST, GROWTH = 1, 4
#: Summaries of annuli are broadcast up to so many; beyond, they are dealt to tasks.
SUMMARIES = 50_000


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, dim, v, norm2, wide) with v the floors of scale * component as whole doubles; invalid vectors left out."""
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ok)

    def floors(batches):
        for pdf in batches:
            v = [np.floor(np.asarray(x, dtype=np.float64) * scale) for x in pdf["v"]]
            if any(not np.isfinite(x).all() for x in v):
                raise OverflowError("a scaled component does not fit in a double")
            norm2 = [float(x @ x) for x in v]
            wide = [n > MAX_NORM2 or float(np.abs(x).max(initial=0)) >= MAX_COMPONENT for x, n in zip(v, norm2, strict=True)]
            yield pd.DataFrame({"vec_id": pdf["vec_id"].astype("Int64"), "dim": np.array([len(x) for x in v], dtype=np.int32), "v": v, "norm2": norm2, "wide": wide})

    return rows.mapInPandas(floors, "vec_id long, dim int, v array<double>, norm2 double, wide boolean")


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles, else in 64 bits, else in Python's integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return np.rint(a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape) for m in (a, b)]
    return whole[0] @ whole[1].T if a.shape[1] else np.zeros((len(a), len(b)), dtype=np.int64)


def _spread(points: np.ndarray, count: int) -> np.ndarray:
    """Pivots: the first point, then always the one farthest from those chosen."""
    chosen = [0]
    gap = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(count, len(points)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))])


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0))


def _bound(most: Column, qnorm2: Column, near: Column, far: Column, lo: Column, hi: Column) -> Column:
    """The greatest inner product that a query of a block can have with a vector of an annulus, by all pivots."""
    gaps = F.zip_with(F.zip_with(lo, far, lambda a, b: a - b), F.zip_with(near, hi, lambda a, b: a - b), lambda a, b: F.greatest(a, b))
    gap = F.aggregate(gaps, F.lit(0.0), lambda a, x: F.greatest(a, x))
    scale = qnorm2 + most
    return (scale - gap * gap) / 2 + scale * 1e-9 + 1


def top_k(table: DataFrame, queries: DataFrame | None = None, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, modulus: int = 50, stats: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by ``modulus``; candidates are every row but the query's own
    (rows with the query's id).  Vectors of different length are never compared.  ``stats`` gets the number of block visits made, of
    those possible, and of rounds.

    Defined cases: vectors that are null or hold a null, NaN or infinite component take no part; null ids are candidates that no query shares, never
    queries, and rank last among ties; repeated rows each count; with fewer than k candidates all are returned; an empty table gives no rows;
    a score among the answers that does not fit in 64 bits is an error; other columns are ignored.
    """
    spark = table.sparkSession
    work = Workspace(spark, "topk")
    vectors = work.save(integer_vectors(table, id_col, vector_col, scale), "vectors")
    sizes = vectors.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.when(~F.col("wide"), F.col("norm2"))).alias("most")).orderBy(F.desc("n"), "dim").limit(64).collect()
    model: dict[int, tuple[float, np.ndarray]] = {}
    for row in sizes:  # other, rarer lengths have no pivots: all their annuli are met
        if row.most is not None:
            sample = vectors.where((F.col("dim") == row.dim) & ~F.col("wide")).orderBy(F.xxhash64("v"), F.xxhash64("vec_id")).limit(SAMPLE).collect()
            model[row.dim] = (row.most, _spread(_lifted(np.array([r.v for r in sample]).reshape(len(sample), row.dim), row.most), PIVOTS))
    held = spark.sparkContext.broadcast(model)

    def key(batches):
        for pdf in batches:
            out = pdf[["vec_id", "dim", "wide", "v"]].copy()
            out["pivot"], out["dist"] = -1, 0.0
            for dim, part in pdf[~pdf["wide"].astype(bool)].groupby("dim"):
                if dim in held.value:
                    most, p = held.value[dim]
                    d = _distances(_lifted(np.stack(part["v"].to_list()).reshape(len(part), dim), most), p)
                    out.loc[part.index, "pivot"] = d.argmin(1)
                    out.loc[part.index, "dist"] = d.min(1)
            yield out[["vec_id", "dim", "pivot", "dist", "v"]]

    keyed = work.save(vectors.mapInPandas(key, "vec_id long, dim int, pivot int, dist double, v array<double>"), "keyed")
    n = keyed.count()
    order = ["dim", "pivot", "dist", "vec_id"]
    ranged = keyed.withColumn("tie", F.xxhash64("vec_id", "v")).repartitionByRange(max(1, -(-n // (8 * ANNULUS))), *order, "tie").sortWithinPartitions(*order, "tie")

    def pack(batches):
        rows, dim, pivot = [], None, None

        def annulus():
            m = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), dim)
            ids = [r[0] for r in rows]
            own = [i for i, x in enumerate(ids) if x is not None and x % modulus == 0]
            lo, hi = [], []
            if pivot >= 0:
                most, p = held.value[dim]
                d = _distances(_lifted(m, most), p)
                lo, hi = (d.min(0) - 1e-6).tolist(), (d.max(0) + 1e-6).tolist()
            return {"dim": dim, "pivot": pivot, "n": len(rows), "ids": [0 if x is None else x for x in ids], "nulls": [x is None for x in ids], "m": m.tobytes(), "lo": lo, "hi": hi, "q": own}

        for pdf in batches:
            done = []
            for vec_id, d, p, v in zip(pdf["vec_id"].tolist(), pdf["dim"].tolist(), pdf["pivot"].tolist(), pdf["v"], strict=True):
                if rows and ((d, p) != (dim, pivot) or len(rows) >= ANNULUS):
                    done.append(annulus())
                    rows = []
                dim, pivot = d, p
                rows.append((None if vec_id is None or vec_id != vec_id else int(vec_id), v))
            if done:
                yield pd.DataFrame(done)
        if rows:
            yield pd.DataFrame([annulus()])

    schema = "dim int, pivot int, n int, ids array<long>, nulls array<boolean>, m binary, lo array<double>, hi array<double>, q array<int>"
    index = work.save(ranged.select(*order, "v").mapInPandas(pack, schema).withColumn("annulus", F.monotonically_increasing_id()), "index")
    work.drop(keyed)
    work.drop(vectors)

    def blocks_of(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                m, ids = np.frombuffer(r.m, dtype=np.float64).reshape(r.n, r.dim), np.asarray(r.ids)
                for at in range(0, len(r.q), QUERY_BLOCK):
                    q = np.asarray(r.q[at : at + QUERY_BLOCK], dtype=int)
                    near, far, most, qnorm2 = [], [], 0.0, float((m[q] * m[q]).sum(1).max())
                    if r.pivot >= 0:
                        most, p = held.value[r.dim]
                        d = _distances(np.column_stack([m[q], np.zeros(len(q))]), p)
                        near, far = d.min(0).tolist(), d.max(0).tolist()
                    out.append((f"{r.annulus}/{at}", r.annulus, r.dim, ids[q].tolist(), m[q].tobytes(), near, far, most, qnorm2))
            yield pd.DataFrame(out, columns=["block", "home", "dim", "qids", "qm", "near", "far", "most", "qnorm2"])

    blocks = work.save(index.where(F.size("q") > 0).select("annulus", "dim", "pivot", "n", "ids", "m", "q").mapInPandas(blocks_of, "block string, home long, dim int, qids array<long>, qm binary, near array<double>, far array<double>, most double, qnorm2 double"), "queries")
    # every block's annuli in the order of their bounds; summaries only, a few numbers for a thousand vectors
    rings = index.select("annulus", "dim", "lo", "hi")
    n_rings = rings.count()
    deals = max(1, n_rings // SUMMARIES)
    view = blocks.drop("qids", "qm").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    faced = view.join(small(rings.withColumn("deal", F.pmod(F.xxhash64("annulus"), F.lit(deals)).cast("int")), n_rings, SUMMARIES), ["dim", "deal"])
    bounded = (F.size("lo") > 0) & (F.size("near") > 0)
    bound = F.when(bounded, _bound(F.col("most"), F.col("qnorm2"), F.col("near"), F.col("far"), F.col("lo"), F.col("hi"))).otherwise(F.lit(float("inf")))
    ranked = faced.select("block", "annulus", bound.alias("bound"), (F.col("annulus") == F.col("home")).alias("own"))
    plan = work.save(ranked.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("own"), F.desc("bound"), "annulus"))), "plan")

    def meet(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                q, x = np.frombuffer(r.qm, dtype=np.float64).reshape(len(r.qids), r.dim), np.frombuffer(r.m, dtype=np.float64).reshape(r.n, r.dim)
                ids, nulls = np.asarray(r.ids, dtype=np.int64), np.asarray(r.nulls, dtype=bool)
                beat = {b["at"]: b["score"] for b in r.beat} if r.beat is not None else {}
                for i, s in enumerate(_dot(q, x)):
                    ok = np.flatnonzero((nulls | (ids != r.qids[i])) & (s >= beat.get(i, -(2**200) if s.dtype == object else -(2**63))))
                    if len(ok) > k:
                        ok = np.array(sorted(ok.tolist(), key=lambda j: (-s[j], nulls[j], ids[j]))[:k]) if s.dtype == object else ok[np.lexsort((ids[ok], nulls[ok], -s[ok]))[:k]]
                    for j in ok.tolist():
                        if not -(2**63) <= s[j] < 2**63:
                            raise OverflowError("a score does not fit in 64 bits")
                        out.append((r.block, i, r.qids[i], None if nulls[j] else int(ids[j]), int(s[j])))
            yield pd.DataFrame(out, columns=["block", "at", "query_id", "vec_id", "score"]).astype({"at": "int32", "query_id": "int64", "vec_id": "Int64", "score": "int64"})

    first = Window.partitionBy("block", "at").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    best = state = None
    done, width, rounds, visits = 0, FIRST, 0, 0
    while True:
        open_plan = plan.where(F.col("place") > done)
        if state is not None:  # queries without k answers yet beat nothing
            open_plan = open_plan.join(state.select("block", "least"), "block", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        now = work.save(open_plan.where(F.col("place") <= done + width).select("block", "annulus"), "visits")
        made = now.count()
        if not made and not open_plan.limit(1).count():
            break
        beats = blocks.select("block", "dim", "qids", "qm")
        beats = beats.join(state.select("block", "beat"), "block", "left") if state is not None else beats.withColumn("beat", F.lit(None).cast("array<struct<at:int,score:bigint>>"))
        met = now.join(beats, "block").join(index.select("annulus", "n", "ids", "nulls", "m"), "annulus")
        found = met.mapInPandas(meet, "block string, at int, query_id long, vec_id long, score long")
        found = found if best is None else found.unionByName(best)
        new = work.save(found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).drop("rank"), "best")
        work.drop(best)
        best = new
        kth = best.groupBy("block", "at").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k)
        kth = kth.groupBy("block").agg(F.count("*").alias("full"), F.min("score").alias("low"), F.collect_list(F.struct("at", "score")).alias("beat"))
        state = work.save(blocks.select("block", F.size("qids").alias("all")).join(kth, "block").select("block", "beat", F.when(F.col("full") == F.col("all"), F.col("low")).alias("least")), "state")
        done, width, rounds, visits = done + width, width * GROWTH, rounds + 1, visits + made
    if stats is not None:
        stats |= {"visits": visits, "possible": plan.count(), "rounds": rounds}
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # a query id that several rows share is several queries with one name; their answers are ranked together, as rows of one query
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return best.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
