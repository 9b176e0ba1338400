"""Alignment kernels: batches of pairs are scored together, one dynamic-programming row at a time.

Gaps along the reference are resolved in one step: with b the best of match and read gap,
cur[i] = max over k <= i of b[k] + (i - k) gap = gap i + running max of (b[k] - gap k).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BAD = -(10**6)


def _letters(texts, width: int, fill: int) -> np.ndarray:
    out = np.full((len(texts), width), fill, dtype=np.int16)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("latin-1", "replace"), dtype=np.uint8)
    return out


def prefix_scores(refs: list[str], reads: list[str], band: int | None = 7, match: int = 2, mismatch: int = -3, gap: int = -4) -> list[tuple[list[int], list[int]]]:
    """For each pair, the best score of every read prefix (from length 0) over the reference's prefixes, and the reference length of the first best.

    Both ends start at 0.  With a band, prefix j meets reference lengths j - band to j + band only.
    """
    if not refs:
        return []
    wr, ws = max(map(len, refs)), max(map(len, reads))
    band = max(wr, ws) if band is None else band
    refs = [x[: ws + band] for x in refs]  # the band reaches no further
    wr = max(map(len, refs))
    r, s = _letters(refs, wr, -1), _letters(reads, ws, -2)
    len_r = np.array([len(x) for x in refs])
    k = np.arange(2 * band + 1)
    n = len(refs)
    prev = np.full((n, 2 * band + 2), _BAD)
    scores, lengths = np.zeros((n, ws + 1), int), np.zeros((n, ws + 1), int)
    for j in range(ws + 1):
        i = j - band + k  # reference length of each band cell
        ok = (i >= 0)[None] & (i[None] <= len_r[:, None])
        if j == 0:
            cur = np.where(ok, i * gap, _BAD)
        else:
            at = np.clip(i - 1, 0, max(0, wr - 1))
            same = (r[:, at] == s[:, j - 1 : j]) if wr else np.zeros((n, len(k)), bool)
            base = np.maximum(np.where((i >= 1)[None], prev[:, : len(k)] + np.where(same, match, mismatch), _BAD), prev[:, 1:] + gap)
            base = np.where(ok, base, _BAD)
            cur = np.where(ok, np.maximum.accumulate(base - gap * k, axis=1) + gap * k, _BAD)
        scores[:, j] = cur.max(1)
        lengths[:, j] = i[cur.argmax(1)]
        prev = np.concatenate([cur, np.full((n, 1), _BAD)], axis=1)
    return [(scores[x, : len(t) + 1].tolist(), np.maximum(lengths[x, : len(t) + 1], 0).tolist()) for x, t in enumerate(reads)]


def end_to_end(ref: str, seed: str, match: int = 2, mismatch: int = -3, gap: int = -4) -> list[int]:
    """Best score of the whole seed ending at each reference position (1 to len(ref)); the reference's ends are free."""
    n = len(ref)
    prev, i = np.zeros(n + 1, int), np.arange(n + 1)
    r = np.frombuffer(ref.encode("latin-1", "replace"), dtype=np.uint8)
    for j, c in enumerate(seed, 1):
        base = prev + gap
        base[1:] = np.maximum(base[1:], prev[:-1] + np.where(r == ord(c), match, mismatch))
        base[0] = j * gap
        prev = np.maximum.accumulate(base - gap * i) + gap * i
    return prev[1:].tolist()


def best_split(forward: list[int], reverse: list[int], insertion: int = -1, anchor: int = 8) -> tuple[int, int, int] | None:
    """(score, first length, second length) of the best cut of a read between two prefix-score vectors.

    A cut may leave bases between both parts at ``insertion`` each.  Among the best cuts the first with both parts
    of at least ``anchor`` wins, taken without its inserted bases where those are needed; None if none has.
    """
    best, source = [forward[0]], [0]
    for i in range(1, len(forward)):
        stay = best[-1] + insertion
        best.append(max(stay, forward[i]))
        source.append(source[-1] if stay >= forward[i] else i)
    totals = [b + reverse[len(reverse) - 1 - i] for i, b in enumerate(best)]
    top = max(totals)
    for i, total in enumerate(totals):
        second = len(reverse) - 1 - i
        if total != top or second < anchor:
            continue
        for first in dict.fromkeys([i] if best[i] == forward[i] else []) | dict.fromkeys([source[i]] if source[i] != i else []):
            if first >= anchor:
                return top, first, second
    return None


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("scores", "ref_lengths")]))
def banded_alignment(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Prefix scores and reference lengths of (reference, read); nulls count as empty."""
    for ref, read in batches:
        got = prefix_scores(ref.fillna("").tolist(), read.fillna("").tolist())
        yield pd.DataFrame({"scores": [g[0] for g in got], "ref_lengths": [g[1] for g in got]})


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def seed_alignment(ref: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series([np.array(end_to_end(a or "", b or ""), dtype=np.int32) for a, b in zip(ref, seed, strict=True)])


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("score", "first", "second")]))
def split_alignment(forward: pd.Series, reverse: pd.Series) -> pd.DataFrame:
    got = [best_split(list(a), list(b)) or (None, None, None) for a, b in zip(forward, reverse, strict=True)]
    return pd.DataFrame(got, columns=["score", "first", "second"]).astype("Int32")


def template_length(align_position: Column, break_pos: Column) -> Column:
    return F.abs(align_position - break_pos) + 1
