"""Toxicity by a linear-chain conditional random field over words.

Labels mark documents; words of toxic training documents are labelled toxic if a
feature of theirs (the word or its first letters) is far more frequent in toxic
than in clean training documents.  A two-state chain is trained on those word labels,
forward-backward gives every word's marginal, and a document's score is a
logistic function of its largest marginal and the sum of high ones.

The forward-backward pass is exact and runs over all documents of a block at once:
products over short segments, a scan over segments, then the segments again.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svspark.llm.store import bound_batches
from svspark.llm.words import _BASES, _BYTE, _LOWER, Block, blocks, mix

#: The classifier is fitted on at most so many labelled toxic and clean training documents (least hashes of doc_id).
MAX_TOXIC, MAX_CLEAN = 800, 1600
#: And on at most so many bytes of their texts.
MAX_BYTES = 32 << 20
TABLE = 1 << 18
PREFIXES = (4, 5, 6)
SEGMENT = 32
#: Texts are scored in blocks of whole rows of about so many bytes; a longer text is a block of its own.
PART_BYTES = 1 << 18


_OUTER = np.zeros(256, dtype=bool)
_OUTER[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def bare_words(block: Block) -> Block:
    """The same words in lower case without ASCII signs around them; a word of signs alone stays."""
    out = copy.copy(block)
    out.data = _LOWER[block.data]
    if not len(block.starts):
        return out
    plain = np.concatenate([[0], np.cumsum(~_OUTER[out.data])])
    some = plain[block.ends] > plain[block.starts]
    following = np.flatnonzero(~_OUTER[out.data])  # every place that is not a sign
    first = following[np.minimum(np.searchsorted(following, block.starts), len(following) - 1)] if len(following) else block.starts
    last = following[np.maximum(np.searchsorted(following, block.ends) - 1, 0)] + 1 if len(following) else block.ends
    out.starts, out.ends = np.where(some, first, block.starts), np.where(some, last, block.ends)
    return out


def features(block) -> list[np.ndarray]:
    """For each kind of feature, the table slot of each word."""
    bare = bare_words(block)
    whole = bare.hashes()
    out = [whole]
    lengths = bare.ends - bare.starts
    h, factor = np.zeros(len(whole), dtype=np.uint64), 1
    for k in range(max(PREFIXES)):
        at = np.minimum(bare.starts + k, len(bare.data) - 1) if len(bare.data) else bare.starts
        if len(whole):
            h = h + np.where(k < lengths, _BYTE[bare.data[at]] * np.uint64(factor), np.uint64(0))
        factor = factor * _BASES[3] & ((1 << 64) - 1)
        if k + 1 in PREFIXES:
            out.append(mix(h + np.uint64(k + 1)))
    return [(x >> np.uint64(46)).astype(np.int64) for x in out]


class Chain:
    """Two states; emit is a word's score for state 1, trans a 2x2 table, start the scores of the first word's state."""

    def __init__(self, weights, bias, trans, start):
        self.weights, self.bias, self.trans, self.start = weights, bias, trans, start

    def emissions(self, slots: list[np.ndarray]) -> np.ndarray:
        e = np.full(len(slots[0]), self.bias)
        for w, s in zip(self.weights, slots, strict=True):
            e += w[s]
        return np.clip(e, -30, 30)

    def marginals(self, e: np.ndarray, counts: np.ndarray, pairs: bool = False):
        """P(state 1) of each word; with pairs also the expected number of each transition and start, summed."""
        n, seg = len(e), SEGMENT
        if not n:
            return (e, np.zeros((2, 2)), np.zeros(2)) if pairs else e
        counts = counts[counts > 0]
        segs = -(-counts // seg)
        s_total = int(segs.sum())
        first_seg = np.cumsum(segs) - segs
        doc = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(n) - (np.cumsum(counts) - counts)[doc]
        row, col = first_seg[doc] + within // seg, within % seg
        ratio = np.ones((seg, s_total, 2))
        used = np.zeros((seg, s_total), dtype=bool)
        used[col, row] = True
        top = np.maximum(e, 0)
        ratio[col, row, 0], ratio[col, row, 1] = np.exp(-top), np.exp(e - top)
        t = np.exp(self.trans)
        t = t / t.max()
        begin = np.exp(self.start)
        begin = begin / begin.sum()
        opens = np.zeros(s_total, dtype=bool)
        opens[first_seg] = True
        eye = np.eye(2)

        def step(k):  # (segments, 2, 2): from the state before word k to its state
            m = t[None] * ratio[k][:, None, :]
            if k == 0:
                m[opens] = eye[None] * ratio[0][opens][:, None, :]  # the incoming vector is then the start
            m[~used[k]] = eye
            return m

        steps = [step(k) for k in range(seg)]
        whole = np.broadcast_to(eye, (s_total, 2, 2)).copy()
        for m in steps:
            whole = whole @ m
            whole /= whole.sum((1, 2), keepdims=True)
        into = np.empty((s_total, 2))
        out_of = np.empty((s_total, 2))
        order = np.argsort(-segs, kind="stable")
        live, vec = order, np.broadcast_to(begin, (len(counts), 2)).copy()
        for k in range(int(segs.max())):
            live = live[segs[live] > k]
            at = first_seg[live] + k
            into[at] = vec[live]
            v = np.einsum("ij,ijk->ik", vec[live], whole[at])
            vec[live] = v / v.sum(1, keepdims=True)
        live, vec = order, np.ones((len(counts), 2)) / 2
        for k in range(int(segs.max())):
            live = live[segs[live] > k]
            at = first_seg[live] + segs[live] - 1 - k
            out_of[at] = vec[live]
            v = np.einsum("ijk,ik->ij", whole[at], vec[live])
            vec[live] = v / v.sum(1, keepdims=True)
        fore = np.empty((seg, s_total, 2))
        v = into
        for k, m in enumerate(steps):
            v = np.einsum("ij,ijk->ik", v, m)
            v = v / v.sum(1, keepdims=True)
            fore[k] = v
        back = np.empty((seg, s_total, 2))
        v = out_of
        for k in range(seg - 1, -1, -1):
            back[k] = v
            v = np.einsum("ijk,ik->ij", steps[k], v)
            v = v / v.sum(1, keepdims=True)
        both = fore * back
        p = (both[..., 1] / both.sum(-1))[col, row]
        if not pairs:
            return p
        expected = np.zeros((2, 2))
        before = into
        for k, m in enumerate(steps):
            joint = before[:, :, None] * m * back[k][:, None, :]
            live = used[k] & ~(opens & (k == 0))
            joint = joint[live]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            before = fore[k]
        heads = np.cumsum(counts) - counts
        return p, expected, np.array([(1 - p[heads]).sum(), p[heads].sum()])


def _word_labels(slots, counts, toxic):
    """Weak labels: words of toxic documents with a feature that clean documents lack."""
    doc = np.repeat(np.arange(len(counts)), counts)
    y = np.zeros(len(doc), dtype=bool)
    odds = toxic.sum() / max(1, (~toxic).sum())
    before = np.concatenate([[-1], slots[0][:-1].astype(np.int64)]) + 1
    for s in slots:
        p, c = None, None
        for of in (doc, before):  # the same sentence in many copies is one context
            counted = []
            for mask in (toxic[doc], ~toxic[doc]):
                slot = np.unique(of[mask] * TABLE + s[mask]) % TABLE
                counted.append(np.bincount(slot, minlength=TABLE).astype(float))
            p = counted[0] if p is None else np.minimum(p, counted[0])
            c = counted[1] * odds if c is None else np.maximum(c, counted[1] * odds)
        kinds = max(1, int(((p + c) >= 3).sum()))
        strong = (p - 8 * c) * np.log(len(toxic) / toxic.sum()) >= np.log(kinds) + 1  # few enough by chance among so many features
        y |= strong[s]
    return y & toxic[doc]


def _in_parts(chain: Chain, slots, counts, limit: int = 20_000):
    """Marginals, transitions and starts of many documents, in parts of bounded memory."""
    ends = np.cumsum(counts)
    out, pairs, begin, lo = [np.zeros(0)], np.zeros((2, 2)), np.zeros(2), 0
    while lo < len(counts):
        before = ends[lo] - counts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        p, t, b = chain.marginals(chain.emissions([s[before : ends[hi - 1]] for s in slots]), counts[lo:hi], True)
        out.append(p)
        pairs, begin, lo = pairs + t, begin + b, hi
    return np.concatenate(out), pairs, begin


def train(texts: list[str], toxic: np.ndarray, rounds: int = 16, prior: float | None = None) -> dict:
    """Fit the chain and the calibration; plain arrays of a fixed size.  ``prior`` are the odds of toxic among all labelled documents, where the sample has others."""
    parts = [([s.astype(np.int32) for s in features(b)], b.counts) for _, _, b in blocks(pa.array(texts, pa.string()), limit=PART_BYTES)]
    if not parts or not toxic.any() or toxic.all():
        return {"constant": float(bool(len(toxic)) and bool(toxic.all()))}
    slots = [np.concatenate([p[0][k] for p in parts]).astype(np.int32) for k in range(len(PREFIXES) + 1)]
    counts = np.concatenate([p[1] for p in parts])
    y = _word_labels(slots, counts, toxic)
    some = counts > 0
    heads = (np.cumsum(counts) - counts)[some]
    follows = np.ones(len(y), dtype=bool)
    follows[heads] = False
    at = np.flatnonzero(follows)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    began = np.array([(~y[heads]).sum(), y[heads].sum()], dtype=float)
    chain = Chain([np.zeros(TABLE) for _ in slots], np.log((y.sum() + 0.5) / (len(y) + 1)), np.zeros((2, 2)), np.zeros(2))
    sums = [np.full(TABLE, 1e-2) for _ in slots]
    other = {"bias": 1e-2, "trans": np.full((2, 2), 1e-2), "start": np.full(2, 1e-2)}
    for _ in range(rounds):
        p, pairs, begin = _in_parts(chain, slots, counts)
        left = y - p
        for w, s, g2 in zip(chain.weights, slots, sums, strict=True):
            g = np.bincount(s, left, TABLE) - 0.02 * w
            g2 += g * g
            w += 0.8 * g / np.sqrt(g2)
        for name, g in (("bias", left.sum()), ("trans", seen - pairs - 0.02 * chain.trans), ("start", began - begin)):
            other[name] = other[name] + g * g
            setattr(chain, name, getattr(chain, name) + 0.3 * g / np.sqrt(other[name]))
    x = _summary(_in_parts(chain, slots, counts)[0], counts)
    a = np.zeros(3)
    x1 = np.column_stack([np.ones(len(x)), x])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x1 @ a, -30, 30)))
        h = x1.T @ (x1 * (q * (1 - q))[:, None]) + np.diag([0.01, 0.1, 0.1])
        a = a + np.linalg.solve(h, x1.T @ (toxic - q) - np.array([0.01, 0.1, 0.1]) * a)
    if prior:
        a[0] += np.log(prior) - np.log(toxic.sum() / (~toxic).sum())
    return {"weights": [w.astype(np.float32) for w in chain.weights], "bias": float(chain.bias), "trans": chain.trans, "start": chain.start, "calibration": a}


def _summary(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each document: the logit of the largest marginal, the log of the sum of marginals of 0.1 and more."""
    out = np.zeros((len(counts), 2))
    out[:, 0] = np.log(1e-6)
    some = counts > 0
    if len(p):
        heads = (np.cumsum(counts) - counts)[some]
        most = np.clip(np.maximum.reduceat(p, heads), 1e-6, 1 - 1e-6)
        out[some, 0] = np.log(most / (1 - most))
        out[some, 1] = np.log1p(np.add.reduceat(np.where(p >= 0.1, p, 0), heads))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> dict:
    """Train on a bounded sample of the labelled documents whose crc32(id as text) mod 5 is not 0.

    Of rows with one id that with the least hash of its text counts; documents are taken in the order of the hash of their id, whole,
    up to ``max_bytes`` of text in all.  Scores are corrected to the odds of the labels among all labelled documents.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    ids = ids.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    rank = [F.xxhash64("doc_id"), "doc_id"]
    many = {r.y: r.n for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = ids.where("y = 1").orderBy(*rank).limit(max_toxic).unionByName(ids.where("y = 0").orderBy(*rank).limit(max_clean))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    so_far = Window.orderBy(*rank).rowsBetween(Window.unboundedPreceding, 0)  # over at most max_toxic + max_clean rows
    rows = rows.withColumn("bytes", F.sum(F.octet_length("text")).over(so_far)).where(F.col("bytes") <= max_bytes).select("doc_id", "y", "text").collect()
    rows.sort(key=lambda r: r.doc_id)
    return train([r.text for r in rows], np.array([r.y == 1 for r in rows], dtype=bool), prior=many[1] / many[0] if many.get(0) and many.get(1) else None)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, score, predicted, spans), spans the words with a marginal of 0.5 or more
    as (begin, end, p), offsets in characters.

    Defined cases: null and empty texts have no words and get the calibrated score of none; null ids stay;
    repeated rows score alike; a model fitted without both labels gives a constant score; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        chain = None if "constant" in m else Chain(m["weights"], m["bias"], m["trans"], m["start"])
        for batch in batches:
            scores, spans = [], []
            for _, _, block in blocks(batch.column("text"), limit=PART_BYTES):
                counts = block.counts
                if chain is None:
                    scores.append(np.full(len(counts), m["constant"]))
                    spans += [[]] * len(counts)
                    continue
                p = chain.marginals(chain.emissions(features(block)), counts)
                z = np.column_stack([np.ones(len(counts)), _summary(p, counts)]) @ m["calibration"]
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                own = [[] for _ in counts]
                at = np.flatnonzero(p >= 0.5)
                if len(at):
                    chars = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
                    doc = np.searchsorted(block.first, at, side="right") - 1
                    base = chars[block.offsets[doc]]
                    for d, b, e, q in zip(doc.tolist(), (chars[block.starts[at]] - base).tolist(), (chars[block.ends[at]] - base).tolist(), p[at].tolist(), strict=True):
                        own[d].append({"begin": b, "end": e, "p": q})
                spans += own
            s = np.concatenate(scores) if scores else np.zeros(0)
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans, kind)], ["doc_id", "score", "predicted", "spans"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<begin:int,end:int,p:double>>")


def keep_clean(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below 0.5.

    Defined cases: those of ``score``; a null text is judged as an empty one and stays null; columns of any name are carried.
    """
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs if docs.schema[text_col].dataType.simpleString() == "string" else docs.withColumn(text_col, F.col(text_col).cast("string"))
    at = docs.columns.index(text_col)

    def run(batches):
        m = held.value
        chain = None if "constant" in m else Chain(m["weights"], m["bias"], m["trans"], m["start"])
        for batch in batches:
            for row, end, block in blocks(batch.column(at), limit=PART_BYTES):
                yield batch.slice(row, end - row).filter(pa.array(_logits(chain, m, block) < 0))

    return texts.mapInArrow(run, texts.schema)


def _logits(chain, m, block) -> np.ndarray:
    counts = block.counts
    if chain is None:
        return np.full(len(counts), m["constant"] * 2 - 1)
    p = chain.marginals(chain.emissions(features(block)), counts)
    return np.column_stack([np.ones(len(counts)), _summary(p, counts)]) @ m["calibration"]
