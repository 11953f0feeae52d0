"""Strand and direction algebra, junction coordinates and chromosome order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def invert(strand: Column) -> Column:
    """+ and - exchanged; anything else is null."""
    return F.when(strand == "+", "-").when(strand == "-", "+")


def corrected(strand: Column, forward: Column) -> Column:
    """The direction of a pair read forwards, or its inverse."""
    return F.when(forward, strand).otherwise(invert(strand))


def strands_of(dir_a: Column, dir_b: Column) -> Column:
    """Breakpoint strands of a path that leaves in dir_a and goes on in dir_b."""
    return F.concat(dir_a, invert(dir_b))


def dirs_of(strands: Column) -> Column:
    """struct(dir_a, dir_b) of breakpoint strands; null where they aren't two signs."""
    ok = strands.rlike(r"^[+-]{2}$")
    return F.when(ok, F.struct(F.substring(strands, 1, 1).alias("dir_a"), invert(F.substring(strands, 2, 1)).alias("dir_b")))


def canonical_pair(a: Column, b: Column) -> Column:
    """The smaller of (a, b) and its reverse complement (flip b, flip a); a and b are structs of chr, pos, dir."""

    def flip(x: Column) -> Column:
        return F.struct(x["chr"].alias("chr"), x["pos"].alias("pos"), invert(x["dir"]).alias("dir"))

    def pair(x: Column, y: Column) -> Column:
        return F.struct(x.alias("a"), y.alias("b"))

    as_is = pair(F.struct(a["chr"].alias("chr"), a["pos"].alias("pos"), a["dir"].alias("dir")), F.struct(b["chr"].alias("chr"), b["pos"].alias("pos"), b["dir"].alias("dir")))
    return F.least(as_is, pair(flip(b), flip(a)))


def reciprocal(first_a: Column, first_b: Column, second_a: Column, second_b: Column) -> Column:
    """Two mates describe one junction: the second's directions are the first's, reversed and inverted."""
    return (second_a == invert(first_b)) & (second_b == invert(first_a))


def chromosome_rank(chrom: Column, x: int = 24, y: int = 25, m: int | None = None) -> Column:
    """Natural order: chr1..chr22 by number, then X, Y and, if given, M; anything else is null."""
    out = F.when(chrom == "chrX", x).when(chrom == "chrY", y)
    if m is not None:
        out = out.when(chrom == "chrM", m)
    return out.otherwise(F.regexp_extract(chrom, r"^chr([0-9]+)$", 1).try_cast("int"))


def breakend_coord(strand: Column, first: Column, st: Column, nd: Column) -> Column:
    """Position at which a junction leaves (first) or enters an aligned span."""
    return F.when((strand == "+") != first, st).otherwise(nd)


def high_side(strand: Column, first: Column) -> Column:
    """Side of the coordinate on which more depth is expected."""
    return F.when((strand == "+") != first, "right").otherwise("left")


def side_label(chrom: Column, end: Column) -> Column:
    return F.concat(chrom, end)
