"""Substring deduplication over a log-structured fingerprint index.

A window is ``window`` consecutive words of one text.  Its anchor is the least of
its 8-word fingerprints (leftmost on ties), so equal windows have equal anchors.
Consecutive windows with one anchor are a *stretch* with a 128-bit signature of all
its windows.  The stretches of a batch form an immutable run of the index, bucketed and sorted
by anchor; a new batch is merge-joined with every earlier run, bucket by bucket and without a
shuffle of history, and runs are compacted into one when there are many.  An index may be kept and
opened again, so that a later batch is held against all that came before.

Only stretches whose anchor occurs again are looked at further: stretches with equal
signatures repeat as a whole and form one class; where an anchor has several classes,
one representative of each is expanded to 128-bit window hashes, which verify
window by window.  Work thus follows the number of stretches, and a passage that a third
of all texts share is one class.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svspark.llm.store import BROADCAST_ROWS, Workspace, small
from svspark.llm.words import _powers, blocks, mix

ANCHOR = 8
_STEP = 0x9E3779B97F4A7C15


#: Stretches of an anchor that a batch holds so often go into a run as one row for each class, and a class of so many is
#: joined by broadcast: else all its rows would meet in one task.  There are at most the stretches divided by HOT of either.
HOT = 4096
_STRETCH = "doc_id long, k2 long, at int, c int, a long, s1 long, s2 long"
_RUN = _STRETCH + ", n long, seq int, hot boolean"


class FingerprintIndex:
    """Sorted immutable runs of stretches in a folder; ``open`` finds what an earlier session left there.

    ``add`` writes a batch as a new run and merge-joins it with itself and all earlier runs; ``compact`` merges the runs into one, which
    happens by itself before a batch when there are ``fan_in`` runs.  A manifest names the live runs; it is replaced after a run is
    complete, so what a lost driver leaves half-written is not part of the index.
    A row of a run is a stretch (n = 1), or, of an anchor that its batch holds ``HOT`` times, a class of n stretches and its first one.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fan_in: int = 4):
        self.spark, self.path, self.fan_in = spark, path.rstrip("/"), fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.batches = 0
        self._tables: dict[str, str] = {}
        self._version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> FingerprintIndex:
        """The index in ``path``; an empty one where there is none."""
        index = cls(spark, path, **options)
        jpath, fs = index._fs()
        if fs.exists(jpath):
            found = [f.getPath().getName() for f in fs.listStatus(jpath)]
            versions = sorted(int(n.split("-")[1]) for n in found if n.startswith("manifest-"))
            if versions:
                told = json.loads(spark.sparkContext.wholeTextFiles(f"{index.path}/manifest-{versions[-1]}").first()[1])
                index.runs, index.buckets, index.batches, index._version = told["runs"], told["buckets"], told["batches"], versions[-1]
        return index

    def _fs(self, name: str = ""):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return jpath, jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commit(self, runs: list[str]) -> None:
        self.runs, self._version = runs, self._version + 1
        target, fs = self._fs(f"manifest-{self._version}")
        draft, _ = self._fs(f"draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps({"runs": runs, "buckets": self.buckets, "batches": self.batches}).encode()))
        out.close()
        fs.rename(draft, target)

    def _write(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        table = f"svspark_{name.replace('-', '_')}"
        rows.repartition(self.buckets, "a").write.format("parquet").bucketBy(self.buckets, "a").sortBy("a").option("path", f"{self.path}/{name}").option("compression", "zstd").saveAsTable(table)
        self._tables[name] = table
        return name

    def read(self, name: str) -> DataFrame:
        """A run as a bucketed and sorted table."""
        if name not in self._tables:
            table = f"svspark_{name.replace('-', '_')}_{uuid.uuid4().hex[:8]}"
            self.spark.sql(f"create table {table} ({_RUN}) using parquet clustered by (a) sorted by (a) into {self.buckets} buckets location '{self.path}/{name}'")
            self._tables[name] = table
        return self.spark.table(self._tables[name])

    def add(self, stretches: DataFrame, work: Workspace, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Add a batch: (rows, hot), both written.

        ``rows`` are those of runs whose anchor occurs more than once, if the batch made it so: all such rows of the batch, and those of
        earlier runs whose anchor (a) is not in ``known``.  ``hot`` are the batch's own stretches of anchors that it holds ``HOT`` times.
        """
        if len(self.runs) >= self.fan_in:
            self.compact()
        self.batches += 1
        held = work.save(stretches, "stretches")
        often = work.save(held.groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") >= HOT).select("a"), "often")
        few = often.count()
        flagged = held.join(small(often.withColumn("_often", F.lit(True)), few), "a", "left") if few else held.withColumn("_often", F.lit(None).cast("boolean"))
        hot = work.save(flagged.where("_often").select(held.columns), "hot")
        first = F.min(F.struct("doc_id", "k2", "at", "c")).alias("f")
        classes = hot.groupBy("a", "s1", "s2").agg(first, F.count("*").alias("n")).select("f.*", "a", "s1", "s2", "n").withColumn("hot", F.lit(True))
        cold = flagged.where("_often is null").select(*held.columns, F.lit(1).cast("long").alias("n"), F.lit(False).alias("hot"))
        name = self._write(cold.unionByName(classes).withColumn("seq", F.lit(self.batches)))
        work.drop(held)
        work.drop(often)
        new = self.read(name)
        found = new.join(new.groupBy("a").agg(F.sum("n").alias("_m")).where("_m > 1").select("a", F.lit(True).alias("_0")), "a", "left")
        hits = []
        for i, old in enumerate(self.runs, 1):
            found = found.join(self.read(old).groupBy("a").agg(F.lit(True).alias(f"_{i}")), "a", "left")
            earlier = self.read(old).join(new.select("a"), "a", "left_semi")
            hits.append(earlier.join(known.select("a").distinct(), "a", "left_anti") if known is not None else earlier)
        out = found.where(" or ".join(f"_{i} is not null" for i in range(len(self.runs) + 1))).select(*new.columns)
        for more in hits:
            out = out.unionByName(more)
        out = work.save(out, "hits")
        self._commit([*self.runs, name])
        return out, hot

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) > 1:
            every = self.read(self.runs[0])
            for more in self.runs[1:]:
                every = every.unionByName(self.read(more))
            old = self.runs
            self._commit([self._write(every)])
            for name in old:
                self._forget(name)

    def _forget(self, name: str) -> None:
        table = self._tables.pop(name, None)
        if table:
            self.spark.sql(f"drop table if exists {table}")
        jpath, fs = self._fs(name)
        fs.delete(jpath, True)

    def close(self, delete: bool = False) -> None:
        """Take the runs out of the session's catalog; with ``delete`` also remove the folder."""
        for table in self._tables.values():
            self.spark.sql(f"drop table if exists {table}")
        self._tables = {}
        if delete:
            jpath, fs = self._fs()
            fs.delete(jpath, True)


def _window_hashes(block, window: int):
    h = block.hashes()
    k = min(ANCHOR, window)
    grams, at_gram = block.ngrams(h, k)
    w1, first = block.ngrams(h, window, 1)
    w2, _ = block.ngrams(h, window, 2)
    return grams, at_gram, w1, w2, first, k


def _runs(docs: DataFrame, window: int) -> DataFrame:
    """One row for each stretch: (doc_id, k2, at, c, a, s1, s2), at the first window and c the number of windows."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("k2")
            for row, _, block in blocks(batch.column("text")):
                grams, at_gram, w1, w2, first, k = _window_hashes(block, window)
                if not len(w1):
                    continue
                counts = np.diff(first)
                doc = np.repeat(np.arange(len(counts)), counts)
                at = np.arange(len(w1)) - first[doc]
                gram = at + at_gram[doc]
                anchor = gram + np.argmin(np.lib.stride_tricks.sliding_window_view(grams, window - k + 1), axis=1)[gram]
                new = np.empty(len(w1), dtype=bool)
                new[0] = True
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                heads = np.flatnonzero(new)
                sizes = np.diff(np.append(heads, len(w1)))
                power = _powers(_STEP, int(sizes.max()))[np.arange(len(w1)) - np.repeat(heads, sizes)]
                signed = [mix(np.add.reduceat(w * power, heads) + sizes.astype(np.uint64)).astype(np.int64) for w in (w1, w2)]
                owner = pa.array(doc[heads] + row)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(owner), keys.take(owner), pa.array(at[heads].astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(grams[anchor[heads]].astype(np.int64)), *map(pa.array, signed)],
                    ["doc_id", "k2", "at", "c", "a", "s1", "s2"],
                )

    return docs.select("doc_id", "k2", "text").mapInArrow(run, _STRETCH)


def _expanded(texts: DataFrame, window: int) -> DataFrame:
    """The windows of representative stretches: (a, s1, s2, n, off, w1, w2, age, doc_id, k2, pos)."""

    def run(batches):
        for batch in batches:
            lists = batch.column("runs")
            for row, end, block in blocks(batch.column("text")):
                _, _, w1, w2, first, _ = _window_hashes(block, window)
                parts = lists.slice(row, end - row)
                flat = parts.flatten()
                doc = np.repeat(np.arange(end - row), pa.compute.list_value_length(parts).to_numpy())
                c = flat.field("c").to_numpy()
                total = int(c.sum())
                owner = np.repeat(np.arange(len(c)), c)
                off = np.arange(total) - np.repeat(np.cumsum(c) - c, c)
                pos = flat.field("at").to_numpy()[owner] + off
                where = first[:-1][doc[owner]] + pos
                take, docs = pa.array(owner), pa.array(doc[owner] + row)
                yield pa.RecordBatch.from_arrays(
                    [*(flat.field(x).take(take) for x in ("a", "s1", "s2", "n")), pa.array(off.astype(np.int32)), pa.array(w1[where].astype(np.int64)), pa.array(w2[where].astype(np.int64)), *(batch.column(x).take(docs) for x in ("age", "doc_id", "k2")), pa.array(pos.astype(np.int32))],
                    ["a", "s1", "s2", "n", "off", "w1", "w2", "age", "doc_id", "k2", "pos"],
                )

    return texts.select("age", "doc_id", "k2", "text", "runs").mapInArrow(run, "a long, s1 long, s2 long, n long, off int, w1 long, w2 long, age int, doc_id long, k2 long, pos int")


def _cut(joined: DataFrame, window: int, original: bool) -> DataFrame:
    """Remove the words under the listed windows."""
    schema = joined.schema["text"].dataType

    def run(batches):
        for batch in batches:
            spans = batch.column("spans")
            texts, n_words, n_removed = [], [], []
            for row, end, block in blocks(batch.column("text")):
                buffer = block.data.tobytes()
                counts = block.counts
                for i in range(end - row):
                    n = int(counts[i])
                    raw = buffer[block.offsets[i] : block.offsets[i + 1]]
                    n_words.append(n)
                    listed = spans[row + i].values if spans[row + i].is_valid else None
                    if listed is None or not len(listed):
                        n_removed.append(0)
                        texts.append(raw if original else b" ".join(raw.split()))
                        continue
                    step = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(step, listed.field("s").to_numpy(), 1)
                    np.add.at(step, listed.field("e").to_numpy() + window, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    n_removed.append(int(gone.sum()))
                    if original:
                        at = block.first[i]
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                        base, out, last = block.offsets[i], [], 0
                        for a, b in zip(edge[::2], edge[1::2], strict=True):
                            out.append(raw[last : block.starts[at + a] - base])
                            last = int(block.ends[at + b - 1] - base)
                        texts.append(b"".join([*out, raw[last:]]))
                    else:
                        texts.append(b" ".join([w for w, g in zip(raw.split(), gone.tolist(), strict=True) if not g]))
            made = pa.array(texts, pa.binary()).cast(pa.string())
            old = [batch.column(c) for c in batch.schema.names if c not in ("text", "spans")]
            names = [c for c in batch.schema.names if c not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays([*old, made, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [*names, "text", "n_words", "n_removed"])

    keep = [f for f in joined.schema.fields if f.name not in ("text", "spans")]
    out = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep) + f"text {schema.simpleString()}, n_words long, n_removed long"
    return joined.mapInArrow(run, out)


def _texts(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)
    return out.withColumn("k2", F.xxhash64("text"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, keep_first: bool = False, original: bool = False, batches: int = 3, carry: list[str] | None = None,
    index: FingerprintIndex | None = None, history: DataFrame | None = None,
) -> DataFrame:
    """Remove every word covered by a window that also occurs elsewhere: (doc_id, *carry, text, n_words, n_removed).

    With ``keep_first`` the first occurrence (by doc_id, then position) stays.  With ``original`` the
    white space between kept words stays as it was; else kept words are joined by one space.
    The documents go through the index in ``batches`` batches; results do not depend on how many.
    With an ``index`` of earlier documents, made with the same window, and their rows as ``history``, windows that history holds are repeats too (and
    earlier than all of ``docs``); the documents are added to it.  Without, a temporary index serves this call.

    Defined cases: a null text counts as empty and gives an empty text; texts shorter than a window
    keep all words; repeated rows count as two occurrences; with ``keep_first`` rows equal in id and text
    are one document and both stay; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "repeats")
    carry = carry or []
    kept = [f"_carry{i}" for i in range(len(carry))]
    full = _texts(docs, id_col, text_col, *(F.col(c).alias(k) for c, k in zip(carry, kept, strict=True)))
    docs = full.select("doc_id", "text", "k2")
    own = index is None
    index = index or FingerprintIndex(spark, work.path("index"), fan_in=2)
    if index.runs and history is None:
        raise ValueError("the index holds earlier documents; their rows are needed to verify repeats")
    past = index.batches
    rows = hot = None
    for i in range(batches):
        batch = docs.where(F.pmod(F.xxhash64("k2"), F.lit(batches)) == i)
        more, more_hot = index.add(_runs(batch, window), work, rows)
        rows, hot = (more, more_hot) if rows is None else (rows.unionByName(more), hot.unionByName(more_hot))
    index.close(delete=own)
    rows = rows.withColumn("age", (F.col("seq") > past).cast("int"))

    name = ["a", "s1", "s2"]
    kinds = work.save(rows.groupBy(*name).agg(F.sum("n").alias("n"), F.min(F.struct("age", "doc_id", "k2", "at", "c")).alias("rep")), "classes")
    mixed = kinds.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1").select("a")
    reps = kinds.join(mixed, "a").groupBy("rep.age", "rep.doc_id", "rep.k2").agg(F.collect_list(F.struct(*name, "n", "rep.at", "rep.c")).alias("runs"))
    reps = work.save(reps, "reps")
    texts = docs.withColumn("age", F.lit(1))
    if history is not None:
        texts = texts.unionByName(_texts(history, id_col, text_col).withColumn("age", F.lit(0)))
    if reps.count() <= BROADCAST_ROWS:  # then texts without a representative need not be shuffled
        texts = texts.join(F.broadcast(reps.select("k2").distinct()), "k2", "left_semi")
    texts = texts.distinct().alias("d").join(reps.alias("r"), F.expr("d.age = r.age and d.doc_id <=> r.doc_id and d.k2 = r.k2")).select("d.age", "d.doc_id", "d.k2", "text", "runs")
    windows = work.save(_expanded(texts, window), "windows")
    totals = windows.groupBy("w1", "w2").agg(F.sum("n").alias("total"), F.min(F.struct("age", "doc_id", "k2", "pos")).alias("first"))
    judged = windows.join(totals.where("total > 1"), ["w1", "w2"])
    later = F.struct("age", "doc_id", "k2", "pos") != F.col("first")
    offs = judged.groupBy(*name).agg(F.collect_list("off").alias("offs"), F.collect_list(F.when(later, F.col("off"))).alias("later"))
    verdict = work.save(kinds.join(offs, name, "left").where("n > 1 or offs is not null"), "verdict")

    again = rows.where("age = 1 and not hot").select("age", *hot.columns).unionByName(hot.withColumn("age", F.lit(1)))
    large = verdict.where(F.col("n") >= HOT)
    if 0 < large.count() <= BROADCAST_ROWS:
        found = again.join(F.broadcast(large), name).unionByName(again.join(F.broadcast(large.select(*name)), name, "left_anti").join(verdict.where(F.col("n") < HOT), name))
    else:
        found = again.join(verdict, name)
    whole = F.array(F.struct(F.col("at").alias("s"), (F.col("at") + F.col("c") - 1).alias("e")))

    def each(offsets):
        return F.transform(F.coalesce(offsets, F.array().cast("array<int>")), lambda o: F.struct((F.col("at") + o).alias("s"), (F.col("at") + o).alias("e")))

    if keep_first:
        is_rep = F.struct("age", "doc_id", "k2", "at", "c").eqNullSafe(F.col("rep"))
        spans = F.when(is_rep, each(F.col("later"))).when(F.col("n") > 1, whole).otherwise(each(F.col("later")))
    else:
        spans = F.when(F.col("n") > 1, whole).otherwise(each(F.col("offs")))
    ranges = found.select("doc_id", "k2", F.explode(spans).alias("x")).groupBy("doc_id", "k2").agg(F.collect_set("x").alias("spans"))
    ranges = work.save(ranges, "spans")
    for part in (windows, verdict, reps, kinds):
        work.drop(part)
    joined = full.alias("d").join(ranges.alias("r"), F.expr("d.doc_id <=> r.doc_id and d.k2 = r.k2"), "left").select("d.doc_id", *kept, "text", "spans")
    return _cut(joined, window, original).select("doc_id", *(F.col(k).alias(c) for c, k in zip(carry, kept, strict=True)), "text", "n_words", "n_removed")
