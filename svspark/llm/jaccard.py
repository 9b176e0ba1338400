"""N-gram Jaccard join by grouped prefixes.

Every text becomes its set of distinct word n-grams.  Equal sets are one class.
Under one total order of n-grams (frequent ones last, then by hash), two sets of
Jaccard similarity t or more share an n-gram among the first n - ceil(t n) + 1 of
each.  Classes with the same size and prefix are one group.

1. The groups that share a prefix n-gram and are near in size are a list.  Each is
   first tied to the least group of its lists, a number of pairs linear in the lists;
   these are verified exactly and give provisional components.
2. Only pairs that lie in different provisional components can still add a link
   that matters.  Groups are expanded to members, long lists are cut into blocks, and
   members of a block, then block against block, are filtered by size and by an exact lower
   bound of the symmetric difference (parity bitmaps); survivors are verified exactly.

A family of near copies is thus joined by stars and never expanded into all
pairs; every link between different components is still found, so components are exact.

The frequency sketch only chooses the order, which affects speed, not results.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svspark.llm.store import Workspace, components, small
from svspark.llm.words import blocks, mix

#: Counters of the frequency sketch; its size is fixed, so it may be broadcast.
SKETCH = 1 << 23
#: The sketch comes to the driver in this many compressed slices, one byte a counter: at most 8 MB at any input size.
SLICES = 64
#: Members of a block of a list; a list of at most SHORT members is paired as it is, without blocks.
BLOCK, SHORT = 256, 32
#: Least and greatest number of bits of a parity bitmap; the least one also goes with each member of a short list.
BITS = (256, 1 << 16)


#: The columns of the smallest bitmap, four 64-bit words.
MINI = ("m0", "m1", "m2", "m3")


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1 if n else 0


def _paired_sets(batch: pa.RecordBatch, ngram: int) -> Iterator[tuple[tuple[int, np.ndarray], tuple[int, np.ndarray]]]:
    """Each row's set twice: sorted distinct hashes, and other hashes of the same n-grams in that order."""
    for at, _, block in blocks(batch.column("text"), lower=True):
        h = block.hashes()
        grams, first = block.ngrams(h, ngram)
        other, _ = block.ngrams(h, ngram, 1)
        counts = block.counts
        for i in range(len(counts)):
            if counts[i] >= ngram:
                s, where = np.unique(grams[first[i] : first[i + 1]], return_index=True)
                yield (at + i, s), (at + i, other[first[i] : first[i + 1]][where])
            else:
                s = _short(h[block.first[i] : block.first[i + 1]])
                yield (at + i, s), (at + i, mix(s))


def _short(h: np.ndarray) -> np.ndarray:
    """The set of a text of fewer words than an n-gram: the whole sequence, or nothing."""
    if not len(h):
        return np.zeros(0, dtype=np.uint64)
    return mix(np.array([np.bitwise_xor.reduce(mix(h + np.arange(len(h), dtype=np.uint64))) + np.uint64(977 * len(h))], dtype=np.uint64))


def _sets(batch: pa.RecordBatch, ngram: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct n-gram hashes; a shorter text is one n-gram, a text without words has none."""
    for at, _, block in blocks(batch.column("text"), lower=True):
        h = block.hashes()
        grams, first = block.ngrams(h, ngram)
        counts = block.counts
        for i in range(len(counts)):
            yield at + i, np.unique(grams[first[i] : first[i + 1]]) if counts[i] >= ngram else _short(h[block.first[i] : block.first[i + 1]])


def _identity(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    n = np.array([len(s)], dtype=np.uint64)
    return mix(np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], dtype=np.uint64) + n).tobytes()


def _parity(s: np.ndarray) -> np.ndarray:
    """A bitmap (64-bit words) whose bits tell the parity of a set's members in each bucket; 0.8 bits a member at least.

    Two bitmaps differ in at most as many bits as the sets in members; halves may be folded by XOR.
    """
    bits = min(BITS[1], max(BITS[0], 1 << (4 * len(s) // 5).bit_length()))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _fold(m: np.ndarray, words: int) -> np.ndarray:
    while m.shape[-1] > words:
        half = m.shape[-1] // 2
        m = m[..., :half] ^ m[..., half:]
    return m


def _sketch(docs: DataFrame, ngram: int) -> np.ndarray:
    """Level of each sketch counter: four times the logarithm of its n-grams, 0 where no task saw more than usual."""

    def count(batches):
        total = np.zeros(SKETCH, dtype=np.int32)
        for batch in batches:
            for _, _, block in blocks(batch.column("text"), lower=True):
                grams, _ = block.ngrams(block.hashes(), ngram)
                np.add.at(total, (grams >> np.uint64(41)).astype(np.int64), 1)
        heavy = np.flatnonzero(total >= 2 * int(total.sum()) / SKETCH + 2)
        for k in range(0, len(heavy), 1 << 16):
            part = heavy[k : k + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"k": pa.array(part, pa.int32()), "n": pa.array(total[part], pa.int64())})

    width = SKETCH // SLICES

    def pack(key, table):
        level = np.zeros(width, dtype=np.uint8)
        level[table.column("k").to_numpy() % width] = 1 + np.minimum(254, 4 * np.log2(table.column("n").to_numpy())).astype(np.uint8)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "level": pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())})

    seen = docs.select("text").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
    sliced = seen.withColumn("slice", F.floor(F.col("k") / width).cast("int")).groupBy("slice").applyInArrow(pack, "slice int, level binary")
    level = np.zeros(SKETCH, dtype=np.uint8)
    for row in sliced.collect():  # SLICES rows at most
        level[row.slice * width : (row.slice + 1) * width] = np.frombuffer(zlib.decompress(bytes(row.level)), dtype=np.uint8)
    return level


def _profile(docs: DataFrame, level, ngram: int, num: int, den: int) -> DataFrame:
    """(doc_id, k2, n, cid, gid, m0..m3, prefix, bound) of each document; m0..m3 are bound folded to 256 bits."""

    def run(batches):
        order = level.value
        for batch in batches:
            rows = {k: [] for k in ("n", "cid", "gid", "mini", "prefix", "bound")}
            for _, s in _sets(batch, ngram):
                rank = order[(s >> np.uint64(41)).astype(np.int64)]
                p = prefix_length(len(s), num, den)
                prefix = s[:p] if not rank.any() else s[np.lexsort((s, rank))[:p]]
                bits = _parity(s)
                rows["n"].append(len(s))
                rows["cid"].append(_identity(s))
                rows["gid"].append(int(mix(np.array([mix(prefix).sum(dtype=np.uint64)], dtype=np.uint64) + np.uint64(len(s))).astype(np.int64)[0]))
                rows["mini"].append(_fold(bits, 4))
                rows["prefix"].append(prefix.astype(np.int64))
                rows["bound"].append(bits.tobytes())
            mini = np.array(rows.pop("mini"), dtype=np.uint64).reshape(-1, 4).astype(np.int64)
            types = {"n": pa.int32(), "cid": pa.binary(), "gid": pa.int64(), "prefix": pa.list_(pa.int64()), "bound": pa.binary()}
            made = {k: pa.array(v, types[k]) for k, v in rows.items()} | {m: pa.array(mini[:, i]) for i, m in enumerate(MINI)}
            names = ["n", "cid", "gid", *MINI, "prefix", "bound"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k2"), *(made[k] for k in names)], ["doc_id", "k2", *names])

    return docs.mapInArrow(run, "doc_id long, k2 long, n int, cid binary, gid long, m0 long, m1 long, m2 long, m3 long, prefix array<long>, bound binary")


def _load_sets(work: Workspace, docs: DataFrame, classes: DataFrame, wanted: DataFrame, ngram: int) -> DataFrame:
    """(cid, s) of the wanted classes, from one document of each; s holds 128 bits of each n-gram."""
    reps = work.save(wanted.join(classes.select("cid", "doc"), "cid"), "wanted")
    rows = reps.count()
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    rep_ids = reps.select(F.coalesce("doc", F.lit(-(2**63))).alias("id")).distinct()
    texts = docs.withColumn("id", key).join(small(rep_ids, rows), "id", "left_semi").select("text")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                found = [(_identity(s), np.stack([s, t], 1).tobytes()) for (_, s), (_, t) in _paired_sets(batch.slice(k, 256), ngram) if len(s)]
                yield pa.RecordBatch.from_pydict({"cid": pa.array([x[0] for x in found], pa.binary()), "s": pa.array([x[1] for x in found], pa.binary())})

    sets = texts.mapInArrow(run, "cid binary, s binary")
    out = work.save(sets.join(small(reps.select("cid"), rows), "cid", "left_semi").dropDuplicates(["cid"]), "sets", "none")
    work.drop(reps)
    return out


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many rows (two 64-bit halves, each side's first halves distinct) two sets have in common."""
    both = np.concatenate([x, y])
    both = both[np.argsort(both[:, 0], kind="stable")]
    return int((both[1:] == both[:-1]).all(1).sum())


def _verified(work: Workspace, docs: DataFrame, classes: DataFrame, pairs: DataFrame, ngram: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    sets = _load_sets(work, docs, classes, wanted, ngram)
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for sa, sb in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64).reshape(-1, 2) for v in (sa, sb))
                common = shared(x, y)
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = work.save(both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary"), "links")
    work.drop(sets)
    return links


def _may_link(differ, na, nb, num, den):
    """Whether sets of these sizes that differ in at least so many members may be similar enough."""
    both = na + nb
    return den * (both - differ) >= num * (both + differ)


def _bounded(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Drop pairs whose bitmaps prove that they can't be similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for xa, xb, na, nb in zip(batch.column("xa"), batch.column("xb"), batch.column("na").to_pylist(), batch.column("nb").to_pylist(), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (xa, xb))
                words = min(len(x), len(y))
                keep.append(_may_link(int(np.bitwise_count(_fold(x, words) ^ _fold(y, words)).sum()), na, nb, num, den))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a binary, b binary")


def _near(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, na, nb and the small bitmaps a0.., b0..) that size and small bitmaps allow."""
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(4)), F.lit(0)).cast("long")
    both = F.col("na").cast("long") + F.col("nb").cast("long")
    fits = (den * F.least("na", "nb").cast("long") >= num * F.greatest("na", "nb").cast("long")) & (den * (both - differ) >= num * (both + differ))
    return pairs.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _surviving(pairs: DataFrame, slim: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that whole bitmaps allow; those of two short texts have been held against theirs before."""
    a, b = (slim.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("bound").alias(f"x{c}")) for c in "ab")
    return _bounded(pairs.join(a, "a").join(b, "b"), num, den)


def _block_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of members (l, r) of two blocks of a list, or of one, that pass the bounds and lie in different components."""

    def pairs_of(m: np.ndarray, at: np.ndarray, m2: np.ndarray, at2: np.ndarray):
        """Index pairs of list i's members with those of list i of the other side, or with later ones where m2 is 0."""
        own = m2 == 0
        heads = np.repeat(np.arange(len(m)), m)
        place = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        many = np.where(own[heads], m[heads] - 1 - place, m2[heads])
        first = np.where(own[heads], at[heads] + place + 1, at2[heads])
        i = np.repeat(at[heads] + place, many)
        return i, np.repeat(first, many) + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)

    def only_once(flat, tokens, of, found):
        """Of pairs in long lists, those for which the list's n-gram is the least that both prefixes share: one list answers for a pair."""
        prefixes = flat.field("prefix")
        held: dict[int, frozenset] = {}

        def prefix(i):
            if i not in held:
                held[i] = frozenset(prefixes[i].as_py() or ())
            return held[i]

        keep = [row for part in found for row in part.tolist() if tokens[of[row[2]]] is None or tokens[of[row[2]]] == min(prefix(row[2]) & prefix(row[3]))]
        return np.array(keep, dtype=np.int64).reshape(-1, 4)

    def run(batches):
        for batch in batches:
            left, right = batch.column("l"), batch.column("r")
            flat = pa.concat_arrays([left.flatten(), right.flatten()])
            m, m2 = (pc.fill_null(pc.list_value_length(x), 0).to_numpy().astype(np.int64) for x in (left, right))
            at, at2 = np.cumsum(m) - m, int(m.sum()) + np.cumsum(m2) - m2
            n = flat.field("n").to_numpy().astype(np.int64)
            comp = flat.field("comp").to_numpy()
            names = flat.field("cid").dictionary_encode()
            cid = names.indices.to_numpy().astype(np.int64)
            if flat.type.get_field_index("m0") >= 0:
                bits = np.stack([flat.field(m).to_numpy() for m in MINI], 1).view(np.uint8).ravel()
                offsets = np.arange(len(flat) + 1) * 8 * len(MINI)
            else:
                bound = flat.field("bound").cast(pa.large_binary())
                offsets = np.frombuffer(bound.buffers()[1], dtype=np.int64)[bound.offset : bound.offset + len(bound) + 1]
                bits = np.frombuffer(bound.buffers()[2], dtype=np.uint8) if len(bound) else np.zeros(0, np.uint8)
            words = np.diff(offsets) // 8
            tokens = batch.column("token").to_pylist()
            long = np.array([t is not None for t in tokens], dtype=bool)
            of = np.concatenate([np.repeat(np.arange(len(m)), m), np.repeat(np.arange(len(m2)), m2)])
            cost = np.where(m2 == 0, m * m // 2, m * m2)
            cuts = np.searchsorted(np.cumsum(cost), np.arange(0, int(cost.sum()) + 1, 1 << 18), side="left")
            found = []
            for lo, hi in zip(cuts, [*cuts[1:], len(m)], strict=True):
                i, j = pairs_of(m[lo:hi], at[lo:hi], m2[lo:hi], at2[lo:hi])
                ok = (comp[i] != comp[j]) & (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j]))
                i, j = i[ok], j[ok]
                x, y = np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])
                key = np.stack([x, y, np.where(long[of[i]], of[i], -1)], 1)  # in long lists a pair is told apart by list
                _, once = np.unique(key, axis=0, return_index=True)
                i, j, x, y = i[once], j[once], x[once], y[once]
                sizes = words[i] * (1 << 20) + words[j]
                for size in np.unique(sizes):
                    pick = np.flatnonzero(sizes == size)
                    wi, wj = int(size) >> 20, int(size) & ((1 << 20) - 1)
                    for k in range(0, len(pick), max(1, (1 << 19) // max(wi, wj))):
                        part = pick[k : k + max(1, (1 << 19) // max(wi, wj))]
                        p, q = (bits[offsets[e[part]][:, None] + np.arange(8 * w)].view(np.uint64) for e, w in ((i, wi), (j, wj)))
                        differ = np.bitwise_count(_fold(p, min(wi, wj)) ^ _fold(q, min(wi, wj))).sum(1).astype(np.int64)
                        good = part[_may_link(differ, n[i[part]], n[j[part]], num, den)]
                        found.append(np.stack([x[good], y[good], i[good], j[good]], 1))
            if long.any():
                found = [only_once(flat, tokens, of, found)]
            both = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
            both = np.unique(both[:, :2], axis=0)
            one, two = (names.dictionary.take(pa.array(both[:, c])).to_pylist() for c in (0, 1))
            yield pa.RecordBatch.from_pydict({"a": pa.array([min(u, v) for u, v in zip(one, two, strict=True)], pa.binary()), "b": pa.array([max(u, v) for u, v in zip(one, two, strict=True)], pa.binary())})

    return lists.mapInArrow(run, "a binary, b binary").distinct()


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: (doc_id, k2, n_shingles, component_id, class_size, is_first), k2 a hash of the text.

    Two documents link when den * |A & B| >= num * |A | B| for their sets of distinct
    word n-grams (A-Z lower-cased); component_id is the least doc_id reachable by links, is_first marks its least row (by doc_id, nulls last, then k2; repeated rows are all marked).

    Defined cases: a null or wordless text has an empty set, links with nothing
    and is its own component; fewer words than ``ngram`` make one shingle; repeated rows
    are equal documents and link; a null doc_id stays null and counts only if no member has an id;
    an empty table gives no rows; other columns are ignored.  Sets are held as 64-bit hashes.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("k2", F.xxhash64("text"))
    level = spark.sparkContext.broadcast(_sketch(docs, ngram))
    profile = work.save(_profile(docs, level, ngram, num, den), "profile")
    payload = ["n", "gid", *MINI, "prefix", "bound"]
    classes = work.save(profile.where("n > 0").groupBy("cid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "k2")).alias("lead"), F.count("*").alias("size"), *(F.first(c).alias(c) for c in payload)), "classes").withColumn("doc", F.col("lead.doc_id"))
    slim = classes.select("cid", "n", "bound")

    # groups of more than one class: their least class is the head, which posts the group's prefix
    crowded = work.save(classes.groupBy("gid").agg(F.min("cid").alias("head"), F.count("*").alias("members")).where("members > 1"), "crowded")
    grouped = classes.join(small(crowded, crowded.count()), "gid", "left").withColumn("many", F.col("head").isNotNull())
    heads = grouped.where("head is null or cid = head")

    # lists: groups with a common prefix n-gram in one of two overlapping size bands
    posted = heads.select("n", "gid", "many", F.explode("prefix").alias("token"))
    often = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num * (1 + 1e-9))).cast("int")
    listed = posted.join(often, "token").withColumn("band", band).select("n", "gid", "many", "token", F.explode(F.array(F.xxhash64("token", "band"), F.xxhash64("token", F.col("band") + 1))).alias("list"))
    listed = work.save(listed, "listed")
    leads = listed.groupBy("list").agg(F.min(F.struct("gid", "n")).alias("to"), F.count("*").alias("df"), F.max("many").alias("any")).where("df > 1")
    met = work.save(listed.join(leads, "list"), "lists")
    work.drop(listed)

    # 1. stars: every group against the least one of its lists, every class against its group's head
    tied = met.where("to.gid <> gid").where(den * F.least("n", "to.n").cast("long") >= num * F.greatest("n", "to.n").cast("long"))
    tied = tied.select(F.least("gid", "to.gid").alias("ga"), F.greatest("gid", "to.gid").alias("gb")).distinct()

    def side(c: str) -> list:
        return [F.col("cid").alias(c), F.col("n").alias(f"n{c}"), *(F.col(m).alias(f"{c}{i}") for i, m in enumerate(MINI))]

    stars = tied.join(heads.select(F.col("gid").alias("ga"), *side("a")), "ga").join(heads.select(F.col("gid").alias("gb"), *side("b")), "gb").drop("ga", "gb")
    full = grouped.where("head is not null")
    inside = full.where("cid = head").select("gid", *side("a")).join(full.where("cid <> head").select("gid", *side("b")), "gid").drop("gid")
    near = work.save(_near(stars.unionByName(inside), num, den), "near")
    links = _verified(work, docs, classes, work.save(_surviving(near, slim, num, den), "stars"), ngram, num, den)
    found = components(work, links)

    # 2. lists that still hold more than one component; a list of groups with one member each has its lead behind it
    labelled = classes.select("cid", "n", "gid", *MINI).join(found.withColumnRenamed("v", "cid"), "cid", "left").withColumn("comp", F.xxhash64(F.coalesce("label", "cid"))).drop("label")  # names only compared within a list
    labelled = work.save(labelled, "labelled")
    left = met.where("any or (df > 2 and to.gid <> gid)").select("list", "token", "gid")
    own = crowded.select(F.xxhash64("gid", "members").alias("list"), F.lit(None).cast("long").alias("token"), "gid", "head").where("members > 2").join(labelled, "gid").where("cid <> head").drop("gid", "head")
    rest = left.join(labelled, "gid").drop("gid").unionByName(own)
    spread = rest.groupBy("list").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("m")).where("c1 <> c2").select("list", "m")
    rest = work.save(rest.join(spread, "list"), "open")
    work.drop(met)
    member = F.struct("cid", "n", "comp", "bound", "prefix").alias("member")
    none = F.lit(None).cast("array<struct<cid:binary,n:int,comp:bigint,bound:binary,prefix:array<bigint>>>")
    light = rest.where(F.col("m") <= SHORT).select("list", F.struct("cid", "n", "comp", *MINI).alias("member"))
    light = light.groupBy("list").agg(F.collect_list("member").alias("l")).select(F.lit(None).cast("long").alias("token"), "l")
    paired = _block_pairs(light.withColumn("r", F.lit(None).cast(light.schema["l"].dataType)), num, den)
    late = _surviving(paired, slim, num, den)

    heavy = work.save(rest.where(F.col("m") > SHORT).drop(*MINI), "heavy")
    if heavy.limit(1).count():
        held = work.save(heavy.groupBy("cid").agg(F.max("m").alias("most")), "held")
        payloads = classes.select("cid", "prefix", "bound").join(small(held, held.count()), "cid")
        payloads = work.save(payloads.withColumn("prefix", F.when(F.col("most") > BLOCK, F.col("prefix"))).drop("most"), "payloads")
        heavy = heavy.join(payloads, "cid")
        short, long = heavy.where(F.col("m") <= BLOCK).drop("prefix").withColumn("prefix", F.lit(None).cast("array<bigint>")), heavy.where(F.col("m") > BLOCK)
        single = short.groupBy("list").agg(F.collect_list(member).alias("l")).select(F.lit(None).cast("long").alias("token"), "l", none.alias("r"))
        # longer lists: a component of more than a block has blocks of its own, which do not meet each other
        of = long.groupBy("list", "comp").agg(F.count("*").alias("mc"), F.first("m").alias("all")).select("list", "comp", F.when(F.col("mc") > BLOCK, F.ceil(F.col("mc") / BLOCK)).otherwise(0).cast("int").alias("cuts"), F.pmod(F.xxhash64("comp"), F.ceil(F.col("all") / BLOCK)).cast("long").alias("pool"))
        big = F.when(F.col("cuts") > 0, F.col("comp"))
        part = F.when(F.col("cuts") > 0, F.pmod(F.xxhash64("cid"), F.col("cuts"))).otherwise(F.col("pool")).cast("long")
        cut = work.save(long.join(of, ["list", "comp"]).groupBy("list", big.alias("big"), part.alias("part")).agg(F.first("token").alias("token"), F.collect_list(member).alias("members")), "blocks")
        one = cut.select("list", "token", F.col("big").alias("b1"), F.col("part").alias("p1"), F.col("members").alias("l"))
        two = cut.select("list", F.col("big").alias("b2"), F.col("part").alias("p2"), F.col("members").alias("r"))
        faced = one.join(two, "list").where("(b1 is null and b2 is not null) or b1 < b2 or (b1 is null and b2 is null and p1 < p2)").select("token", "l", "r")
        alone = cut.where("big is null").select("token", F.col("members").alias("l"), none.alias("r"))
        late = late.unionByName(_block_pairs(single.unionByName(alone).unionByName(faced), num, den))
    links2 = _verified(work, docs, classes, work.save(late.distinct(), "late"), ngram, num, den)
    found = components(work, links.unionByName(links2))

    named = classes.select("cid", "lead", "size").join(found.withColumnRenamed("v", "cid"), "cid", "left").withColumn("comp", F.coalesce("label", "cid"))
    least = named.groupBy("comp").agg(F.min("lead").alias("first"))
    named = named.join(least, "comp").select("cid", "first", F.col("size").alias("class_size"))
    out = profile.select("doc_id", "k2", "n", "cid").join(named, "cid", "left")
    linked = F.col("n") > 0
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("k2") == F.col("first.k2"))
    return out.select(
        "doc_id",
        "k2",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(linked, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.when(linked, is_first).otherwise(True).alias("is_first"),
    )
