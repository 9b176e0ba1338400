"""Best-fit packing into bins of several permitted capacities.

Documents are cut into pieces no longer than the largest capacity.  Each shard of
documents is packed on its own, largest piece first: a piece goes to the open bin that it
leaves the least room in; if none fits, a bin opens at the capacity that costs least for each token it can hold
with the pieces still to come.  A bin of capacity c costs ``overhead + c + c * c / quadratic``, since attention grows with the
square of a sequence; long sequences are therefore opened only where they fill better.  At the end every
bin is downsized to the smallest capacity that holds its contents.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces that are packed together; the number of shards follows the input.
SHARD = 4096


#: Cost of a bin beside its capacity: tokens that any bin costs, and the capacity at which attention doubles the cost of a token.
OVERHEAD, QUADRATIC = 16, 16384
#: Pieces still to come that are looked at to see how full a new bin could get.
AHEAD = 12


def price(capacity: int, overhead: int = OVERHEAD, quadratic: int = QUADRATIC) -> float:
    return overhead + capacity + capacity * capacity / quadratic


def pack(lengths: list[int], capacities: tuple[int, ...], overhead: int = OVERHEAD, quadratic: int = QUADRATIC) -> list[tuple[int, int, int]]:
    """(bin, offset, capacity) of each piece, given in falling order of length."""
    capacities = tuple(sorted(capacities))
    falling = [-n for n in lengths]
    cost = {c: price(c, overhead, quadratic) for c in capacities}
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    fill: list[int] = []
    out = []

    def expected(at: int, c: int) -> float:
        """Cost of each token of a bin opened at c for piece ``at``, filled with the longest later pieces that fit, and downsized."""
        used, k = lengths[at], at + 1
        for _ in range(AHEAD):
            k = bisect.bisect_left(falling, used - c, k)
            if k >= len(falling) or not lengths[k]:
                break
            used += lengths[k]
            k += 1
        return cost[next(x for x in capacities if x >= used)] / max(1, used)

    for i, n in enumerate(lengths):
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b, free = len(fill), min((c for c in capacities if c >= n), key=lambda c: (expected(i, c), c))
            fill.append(0)
        out.append((b, fill[b]))
        fill[b] += n
        if free > n:
            bisect.insort(room, (free - n, b))
    final = [next(c for c in capacities if c >= used) for used in fill]
    return [(b, offset, final[b]) for b, offset in out]


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, shard: int = SHARD, overhead: int = OVERHEAD, quadratic: int = QUADRATIC) -> DataFrame:
    """One row per piece: (doc_id, piece, start, n_tokens, bin, offset, capacity); start and n_tokens count words of the document.

    Bins hold pieces without overlap; every word of every text is in exactly one piece.  A document's words are
    ``[^\\x20\\x09-\\x0D]+``.

    Defined cases: null and wordless texts make one piece of no tokens at the offset where it lands (no space used); repeated rows
    are packed each, in any shard; null ids stay; ties in length keep the order of doc_id; an empty table gives no rows; other columns are ignored.
    """
    top = max(capacities)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # a word starts wherever a non-space follows the start or a space
    # the separators between words are counted: words = separators + 1 in the trimmed text
    trimmed = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    words = F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.cast("long").alias("n"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("salt"))  # the salt deals repeated rows to all shards
    n_docs = docs.select(F.count("*")).first()[0]
    shards = max(1, -(-n_docs // shard))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / top)).cast("int"))))
    start = F.col("piece").cast("long") * top
    pieces = pieces.select("doc_id", "piece", start.alias("start"), F.least(F.lit(top), F.col("n") - start).alias("n_tokens"), F.pmod(F.xxhash64("doc_id", "piece", "h", "salt"), F.lit(shards)).cast("long").alias("shard"))

    def run(key, pdf):
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        placed = pack(pdf["n_tokens"].tolist(), capacities, overhead, quadratic)
        return pdf.assign(bin=[f"{key[0]}-{b}" for b, _, _ in placed], offset=[o for _, o, _ in placed], capacity=[c for _, _, c in placed])[["doc_id", "piece", "start", "n_tokens", "bin", "offset", "capacity"]].astype({"doc_id": "Int64"})

    return pieces.groupBy("shard").applyInPandas(run, "doc_id long, piece int, start long, n_tokens long, bin string, offset long, capacity int")
