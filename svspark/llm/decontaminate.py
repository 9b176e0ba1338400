"""Benchmark decontamination by template windows.

Words are canonicalised to a template: numbers, names and units become typed
placeholders, other words lose case and outer punctuation.  Windows of 8 template
words of benchmark items are hash-joined with those of all documents.  Matches on one
alignment of a document and an item, or on nearby ones, must fill the item's slots
consistently (equal values stay equal), which also catches questions asked again with
other numbers or names, and words put in or left out.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svspark.llm.store import Workspace, small
from svspark.llm.words import Block, _BASES, _LOWER, blocks, mix

WINDOW = 8
#: Template words of a window that must not be placeholders.
LITERALS = 4
#: Bits of the filter of benchmark windows that documents are held against before the join; a fixed size.
FILTER_BITS = 1 << 22
#: Shifts of one item in one document are nearby within this part of its words.
NEARBY = 4

# Units that follow a number.
UNITS = "% km m cm mm mi miles mile kg g mg lb lbs pounds s sec seconds second min minutes minute h hours hour days day weeks week months month years year $ dollars dollar euros euro cents cent l ml litres liters degrees percent meters metres mph km/h kw w v hz".split()

_TAIL = np.zeros(256, dtype=bool)
_TAIL[list(b".,;:!?)]}\"'")] = True
_HEAD = np.zeros(256, dtype=bool)
_HEAD[list(b"([{\"'")] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?:")] = True
_NUM, _NAME, _UNIT = (np.uint64(x) for x in (0xA5A5A5A5A5A5A501, 0xA5A5A5A5A5A5A502, 0xA5A5A5A5A5A5A503))


def stripped(block: Block) -> Block:
    """The same words in lower case without outer punctuation; a word of punctuation alone stays."""
    out = copy.copy(block)
    starts, ends = block.starts.copy(), block.ends.copy()
    for _ in range(3):
        ends -= _TAIL[block.data[ends - 1]] & (ends - starts > 1)
    for _ in range(2):
        starts += _HEAD[block.data[starts]] & (ends - starts > 1)
    out.data, out.starts, out.ends = _LOWER[block.data], starts, ends
    return out


def _unit_hashes() -> np.ndarray:
    column = pa.array([" ".join(UNITS)])
    return np.concatenate([b.hashes() for _, _, b in blocks(column)])


def templates(block: Block, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, their template words, and those to use where a window begins (no name before which nothing is known)."""
    if not len(block.starts):
        none = np.zeros(0, dtype=np.uint64)
        return none, none, none
    bare = stripped(block)
    plain = bare.hashes()
    digits = np.concatenate([[0], np.cumsum((block.data >= 48) & (block.data <= 57))])
    number = digits[bare.ends] > digits[bare.starts]
    lead = block.data[bare.starts]
    more = block.data[np.minimum(bare.starts + 1, len(block.data) - 1)]
    capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (more >= 0x80) & (more <= 0x9E))
    first = np.zeros(len(plain), dtype=bool)
    first[block.first[:-1][block.counts > 0]] = True
    stop = np.empty(len(plain), dtype=bool)
    stop[0] = True
    stop[1:] = _STOP[block.data[block.ends[:-1] - 1]]
    after_number = np.zeros(len(plain), dtype=bool)
    after_number[1:] = number[:-1]
    name = capital & ~first & ~stop & ~number
    unit = np.isin(plain, units) & after_number & ~first & ~number
    opening = np.where(number, _NUM, plain)
    body = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, plain)))
    return plain, body, opening


def width_of(words: int, window: int = WINDOW) -> int:
    """Words of an item's windows: fewer for short items, so that some remain on both sides of one changed word."""
    return words if words < window else window if words >= 2 * window else min(window, max(words // 2 - 1, 5))


def _windows(block: Block, words, width: int, exact: bool):
    """(document, position, first word, hash, enough literal words) of each window; below ``LITERALS`` words only texts that are one window."""
    plain, body, opening = words
    counts = block.counts
    many = np.maximum(counts - width + 1, 0) if width >= LITERALS else (counts == width).astype(np.int64)
    doc = np.repeat(np.arange(len(counts)), many)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    at = block.first[:-1][doc] + pos
    base, factor = _BASES[1], 1
    opening, body = (plain, plain) if exact else (opening, body)
    slot = np.isin(body, [_NUM, _NAME, _UNIT])
    h = opening[at]
    literal = (h != _NUM).astype(np.int64)
    for k in range(1, width):
        factor = factor * base & ((1 << 64) - 1)
        h = h + body[at + k] * np.uint64(factor)
        literal += ~slot[at + k]
    return doc, pos, at, mix(h + np.uint64(width + 1000 * exact)), literal >= min(LITERALS, width)


def _slots(at, width, plain, body, opening):
    """Hashes of the words in a window's slots."""
    out = [int(np.int64(plain[at].view(np.int64)))] if opening[at] == _NUM else []
    part = slice(at + 1, at + width)
    held = np.isin(body[part], [_NUM, _NAME, _UNIT])
    return out + plain[part][held].view(np.int64).tolist()


def _rows(batch, ids, row, block, words, width, exact, chosen, extra):
    doc, pos, at, h, _ = chosen
    owner = pa.array(doc + row)
    slots = [[] if exact else _slots(i, width, *words) for i in at]
    more = [pa.array(np.asarray(x, dtype=np.int64)[doc]) for x in extra.values()]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c).take(owner) for c in ids), pa.array(pos.astype(np.int64)), pa.array(np.full(len(pos), width)), pa.array(np.full(len(pos), int(exact))), pa.array(h.view(np.int64)), pa.array(slots, pa.list_(pa.int64())), *more],
        [*ids, "pos", "width", "exact", "h", "slots", *extra],
    )


_SCHEMA = "pos long, width long, exact long, h long, slots array<long>"


def _item_windows(items: DataFrame, window: int, coverage: float) -> DataFrame:
    """(item_id, item_k, windows, words, of) of each usable window, of the words that usable windows cover; windows of exact words where those with enough literals cover too few."""
    ids = ["item_id", "item_k"]

    def run(batches):
        units = _unit_hashes()
        for batch in batches:
            for row, _, block in blocks(batch.column("text")):
                words, counts = templates(block, units), block.counts
                widths = np.array([width_of(int(n), window) for n in counts])
                for width in sorted(set(widths[counts > 0].tolist())):
                    found = []
                    held = np.zeros(len(words[0]), dtype=bool)
                    for exact in (False, True):
                        got = _windows(block, words, width, exact)
                        keep = (widths[got[0]] == width) & (got[4] | exact)
                        if exact:
                            total = np.array([held[a:b].sum() for a, b in zip(block.first[:-1], block.first[1:], strict=True)])
                            keep &= (total < coverage * counts)[got[0]]
                        got = tuple(x[keep] for x in got)
                        for k in range(width):
                            held[got[2] + k] = True
                        found.append(got)
                    total = [held[a:b].sum() for a, b in zip(block.first[:-1], block.first[1:], strict=True)]
                    for exact, got in enumerate(found):
                        yield _rows(batch, ids, row, block, words, width, bool(exact), got, {"words": counts, "of": total})

    return items.select(*ids, "text").mapInArrow(run, f"item_id long, item_k long, {_SCHEMA}, words long, of long")


def _matching(docs: DataFrame, kinds: list[tuple[int, bool]], flags) -> DataFrame:
    """(doc_id, k2, windows) of each window of the given widths, of template or exact words, that may be in the benchmark."""
    ids = ["doc_id", "k2"]

    def run(batches):
        units = _unit_hashes()
        for batch in batches:
            for row, _, block in blocks(batch.column("text")):
                words = templates(block, units)
                for width, exact in kinds:
                    got = _windows(block, words, width, exact)
                    keep = (got[4] | exact) & flags.value[(got[3] >> np.uint64(42)).astype(np.int64)]
                    yield _rows(batch, ids, row, block, words, width, exact, tuple(x[keep] for x in got), {})

    return docs.select(*ids, "text").mapInArrow(run, f"doc_id long, k2 long, {_SCHEMA}")


def covered(matches: list[dict], words: int, of: int, window: int, coverage: float) -> float:
    """The largest share of an item's words that consistent windows on one alignment, or on nearby ones, cover; 0 below what is required."""
    by: dict[int, list[dict]] = {}
    for m in matches:
        by.setdefault(m["shift"], []).append(m)
    shifts = sorted(by)
    need = max(int(np.ceil(of * coverage)), min(words, window, of))
    best, end = 0.0, 0
    for i, s in enumerate(shifts):
        while end < len(shifts) and shifts[end] <= s + max(1, words // NEARBY):
            end += 1
        for some in (shifts[i : i + 1], shifts[i:end]):
            held: set[int] = set()
            value: dict[int, int] = {}
            whole = True
            for m in (m for x in some for m in by[x]):
                held.update(range(m["at"], m["at"] + m["width"]))
                whole = whole and all(value.setdefault(x, y) == y for x, y in zip(m["held"], m["slots"], strict=True))
            if whole and len(held) >= need:
                best = max(best, len(held) / of)
    return best


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """One row per document: (doc_id, k2, contaminated, item_ids, coverage), k2 a hash of the text.

    A document is contaminated by an item if, on one alignment or on nearby ones, matching windows cover at least ``coverage``
    of the words that the item's usable windows cover, and a window's length at least, and equal slots are filled equally.

    Defined cases: null and empty texts have no windows and match nothing; an item shorter than a window
    is one window of its length, found anywhere if it has at least four words and else only in texts that consist of it; items of
    8 to 10 words are not found with a word changed in their middle; where windows with four literal words cover too little of
    an item, its windows of exact words are used too; other windows with fewer than four
    literal words are not used; rows with equal id and text are judged alike; null ids stay; an empty
    benchmark leaves every document clean; other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "decontaminate")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("k2", F.xxhash64("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).withColumn("item_k", F.xxhash64("text")).distinct()
    theirs = work.save(_item_windows(items, window, coverage), "items")
    flags = np.zeros(FILTER_BITS, dtype=bool)
    for r in theirs.select(F.shiftrightunsigned("h", 42).alias("k")).distinct().toLocalIterator():  # at most FILTER_BITS rows
        flags[r.k] = True
    kinds = sorted((r.width, bool(r.exact)) for r in theirs.select("width", "exact").distinct().collect())  # at most two for each width
    ours = work.save(_matching(docs, kinds, spark.sparkContext.broadcast(flags)), "matches")
    right = theirs.select("h", "width", "exact", "item_id", "item_k", F.col("pos").alias("at"), "words", "of", F.col("slots").alias("held"))
    same = ours.join(small(right, right.count()), ["h", "width", "exact"])
    line = ["doc_id", "k2", "item_id"]
    match = F.struct((F.col("pos") - F.col("at")).alias("shift"), "at", "width", "held", "slots")
    grouped = same.groupBy(*line, "item_k").agg(F.collect_set(match).alias("matches"), F.max("words").alias("words"), F.max("of").alias("of"))

    def judge(batches):
        for batch in batches:
            share = [covered(r["matches"], r["words"], r["of"], window, coverage) for r in batch.select(["matches", "words", "of"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in line), pa.array(share, pa.float64())], [*line, "share"])

    found = grouped.mapInArrow(judge, "doc_id long, k2 long, item_id long, share double").where("share > 0")
    hits = found.groupBy("doc_id", "k2").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("coverage"))
    hits = work.save(hits, "hits")
    out = docs.select("doc_id", "k2").alias("d").join(hits.alias("h"), F.expr("d.doc_id <=> h.doc_id and d.k2 = h.k2"), "left")
    return out.select("d.doc_id", "d.k2", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
