"""Sequence and coordinate expressions; positions are 1-based and closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reverse_complement(s: Column) -> Column:
    """Reverse, with A-T and C-G exchanged in either case; other letters stay."""
    return F.translate(F.reverse(s), "ACTGactg", "TGACtgac")


def column_flip(df: DataFrame, cond: Column, a: str, b: str) -> DataFrame:
    """Swap two columns where cond holds; both are read before either changes."""
    return df.withColumns({a: F.when(cond, F.col(b)).otherwise(F.col(a)), b: F.when(cond, F.col(a)).otherwise(F.col(b))})


def align_start(strand: Column, position: Column, length: Column) -> Column:
    return F.when(strand == "+", position).otherwise(position - length + 1)


def align_end(strand: Column, position: Column, length: Column) -> Column:
    return F.when(strand == "+", position + length - 1).otherwise(position)


def break_position(strand: Column, start: Column, end: Column) -> Column:
    return F.when(strand == "+", end).otherwise(start)


def inserted_length(inserted: Column) -> Column:
    """Length of an insertion; ``.`` stands for none."""
    return F.length(F.when(inserted == ".", "").otherwise(inserted))


def strand_sign(strand: Column, position: Column) -> Column:
    return F.when(strand == "+", position).otherwise(-position)


def valid_strand(strand: Column) -> Column:
    """The strand, or an error for anything but + and -."""
    return F.when(strand.isin("+", "-"), strand).otherwise(F.raise_error(F.lit("strand must be + or -")))


def soft_clipped(cigar: Column) -> Column:
    """Sum of the soft-clipped lengths of a CIGAR string."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)S"), 1), F.lit(0), lambda a, x: a + x.cast("int"))


def is_concordant(proper: Column, insert: Column, cigar: Column, max_fragment: int, max_clip: int) -> Column:
    return proper & (F.abs(insert) <= max_fragment) & (soft_clipped(cigar) <= max_clip)


def breakpoint_type(c1: Column, s1: Column, p1: Column, c2: Column, s2: Column, p2: Column) -> Column:
    """translocation, inversion, deletion or duplication; on equal positions + comes first."""
    first = F.when((p1 < p2) | ((p1 == p2) & (s1 <= s2)), s1).otherwise(s2)
    return F.when(c1 != c2, "translocation").when(s1 == s2, "inversion").when(first == "+", "deletion").otherwise("duplication")


def rearrangement_type(kind: Column, size: Column, balanced: Column) -> Column:
    return (
        F.when(balanced, "balanced")
        .when((kind == "deletion") & (size <= 1_000_000), "deletion")
        .when((kind == "inversion") & (size <= 10_000), "foldback")
        .when((kind == "inversion") & (size <= 1_000_000), "inversion")
        .when((kind == "duplication") & (size <= 1_000_000), "duplication")
        .otherwise("unbalanced")
    )


def delaunay_space(x: Column, y: Column, u: Column) -> tuple[Column, Column]:
    """(x + y + u, x - y): the space in which two pairs with one cause lie near each other."""
    return x + y + u, x - y


def annotated_type(kind: Column, distance: Column, group_size: Column, group_kinds: Column, intended: bool = False) -> Column:
    """Rearrangement type of a prediction in a balanced group of ``group_size`` (null outside groups) with the types ``group_kinds``.

    As coded the groups never count (``intended`` false); as intended two inversions are an inversion, two translocations reciprocal, other groups complex.
    """
    pair = lambda k: (group_size == 2) & (F.size(group_kinds) == 1) & (group_kinds[0] == k)
    first = F.when(pair("inversion"), "inversion").when(pair("translocation"), "reciprocal").when(group_size.isNotNull(), "complex").otherwise("") if intended else F.lit("")
    is_complex = first == "complex"
    return (
        F.when((kind == "inversion") & (distance < 1000) & (first != "inversion"), "foldback")
        .when(kind.isin("deletion", "duplication") & ~is_complex, kind)
        .when((kind == "translocation") & ~first.isin("complex", "reciprocal"), "translocation")
        .when((kind == "inversion") & ~first.isin("complex", "inversion"), "unbalanced")
        .otherwise(first)
    )


def _forward_homology(seq1: Column, s1: Column, p1: Column, seq2: Column, s2: Column, p2: Column, max_offset: int) -> Column:
    """Length of the run of equal bases when the break slides along end 1."""
    sign1, sign2 = F.when(s1 == "+", 1).otherwise(-1), F.when(s2 == "+", 1).otherwise(-1)

    def equal(k: Column) -> Column:
        a = F.substring(seq1, (p1 + sign1 * k).cast("int"), F.lit(1))
        b = F.substring(seq2, (p2 + sign2 * (1 - k)).cast("int"), F.lit(1))
        a = F.when(s1 == "+", a).otherwise(reverse_complement(a))
        b = F.when(s2 == "-", b).otherwise(reverse_complement(b))
        return (a == b) & (a != "")

    stops = F.array_position(F.transform(F.sequence(F.lit(1), F.lit(max_offset)), equal), False)
    return F.when(stops == 0, max_offset).otherwise(stops - 1).cast("int")


def microhomology(seq1: Column, s1: Column, p1: Column, seq2: Column, s2: Column, p2: Column, max_offset: int = 10) -> Column:
    """struct(homology, position_1, position_2): total homology and the position normalised so that the lesser breakend is least."""
    a = _forward_homology(seq1, s1, p1, seq2, s2, p2, max_offset)
    b = _forward_homology(seq2, s2, p2, seq1, s1, p1, max_offset)
    d1, d2 = F.when(s1 == "+", 1).otherwise(-1), F.when(s2 == "+", 1).otherwise(-1)
    a1, a2, b1, b2 = p1 + d1 * a, p2 - d2 * a, p1 - d1 * b, p2 + d2 * b
    pick = F.least(a1, a2) < F.least(b1, b2)
    return F.struct((a + b).alias("homology"), F.when(pick, a1).otherwise(b1).alias("position_1"), F.when(pick, a2).otherwise(b2).alias("position_2"))


def break_sequence(left: Column, strand_1: Column, right: Column, strand_2: Column, inserted: Column) -> Column:
    """left[inserted]right, each side turned to read across the break."""
    ins = F.when((inserted == ".") | inserted.isNull(), "").otherwise(inserted)
    one = F.when(strand_1 == "+", left).otherwise(reverse_complement(left))
    two = F.when(strand_2 == "-", right).otherwise(reverse_complement(right))
    return F.concat(one, F.lit("["), ins, F.lit("]"), two)
