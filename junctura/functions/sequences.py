"""Functions of sequences over A, T, G, C and N, with H for a junction and D for a separator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ATGCHD"


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def revcomp(seq: Column | str) -> Column:
    """Reverse complement; N, H and all but ATGC stand for themselves."""
    return F.translate(F.reverse(_column(seq)), "ATGC", "TACG")


def matches(a: Column | str, b: Column | str) -> Column:
    """At how many places, counted from the left, both have the same letter."""
    same = F.zip_with(F.split(_column(a), ""), F.split(_column(b), ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.when((F.length(_column(a)) == 0) | (F.length(_column(b)) == 0), F.lit(0)).otherwise(F.size(F.filter(same, lambda x: x)))


def identity(a: Column | str, b: Column | str) -> Column:
    """matches() as a share of the shorter one; null if one is empty."""
    n = F.least(F.length(_column(a)), F.length(_column(b)))
    return F.when(n > 0, matches(a, b) / n)


def _sides(l1: Column, r1: Column, l2: Column, r2: Column, shift: int) -> tuple[Column, ...]:
    """Left sides turned round, right sides as they are, moved against each other by shift places."""
    a, b = F.reverse(l1), F.reverse(l2)
    cut = lambda s, k: F.substring(s, k + 1, 1 << 30) if k else s
    d = abs(shift)
    return (a, cut(b, d), cut(r1, d), r2) if shift >= 0 else (cut(a, d), b, r1, cut(r2, d))


def similar(l1: Column | str, r1: Column | str, l2: Column | str, r2: Column | str, least: float = 0.9, shift: int = 0) -> Column:
    """Both sides of two junctions agree in more than this share of places; false if a side is empty."""
    a, b, c, d = _sides(*map(_column, (l1, r1, l2, r2)), shift)
    return F.coalesce((identity(a, b) > least) & (identity(c, d) > least), F.lit(False))


def similar_with_middle(l1, r1, m1, l2, r2, m2, least: float = 0.9, longest: int = 3) -> Column:
    """similar(), and the middles agree as well; a middle that only one has may be of ``longest`` letters at most."""
    x, y = F.coalesce(_column(m1), F.lit("")), F.coalesce(_column(m2), F.lit(""))
    both = (F.length(x) > 0) & (F.length(y) > 0)
    middle = F.when(both, identity(x, y) >= least).otherwise(F.greatest(F.length(x), F.length(y)) <= longest)
    return similar(l1, r1, l2, r2, least) & middle


def compatible(l1: Column | str, r1: Column | str, l2: Column | str, r2: Column | str) -> Column:
    """What both have of the left side (to its end) and of the right side (from its start) is equal."""
    l1, r1, l2, r2 = map(_column, (l1, r1, l2, r2))
    left, right = F.least(F.length(l1), F.length(l2)), F.least(F.length(r1), F.length(r2))
    return (F.right(l1, left) == F.right(l2, left)) & (F.left(r1, right) == F.left(r2, right))


def junction(left: Column | str, right: Column | str, flank: int = 100) -> Column:
    """flank letters to either side of an H, padded outward with N."""
    return F.concat(F.lpad(F.right(_column(left), F.lit(flank)), flank, "N"), F.lit("H"), F.rpad(F.left(_column(right), F.lit(flank)), flank, "N"))


def anchor_sides(seq: Column | str, breakpoint: Column | str, kind: Column | str, flank: int = 100) -> Column:
    """struct<left, right> of the anchor around a breakpoint, which counts from 1.

    SM: the right side starts at the breakpoint; MS: the left side ends there.
    """
    s, k = _column(seq), _column(kind)
    first_right = F.when(k == "SM", _column(breakpoint)).otherwise(_column(breakpoint) + 1)
    start = F.greatest(first_right - flank, F.lit(1))
    left = F.substring(s, start, F.greatest(first_right - start, F.lit(0)))
    return F.struct(left.alias("left"), F.substring(s, first_right, F.lit(flank)).alias("right"))


def one_hot(seq: Column | str) -> Column:
    """For each letter an array of six 0s and 1s; all 0 for letters that are not in ALPHABET."""
    return F.transform(F.split(F.upper(_column(seq)), ""), lambda c: F.array(*[(c == x).cast("int") for x in ALPHABET]))


def codes(seq: Column | str) -> Column:
    """For each letter its place in ATGCH, 0 for others."""
    return F.transform(F.split(F.upper(_column(seq)), ""), lambda c: F.greatest(F.instr(F.lit("ATGCH"), c) - 1, F.lit(0)))


def counts(seq: Column | str) -> Column:
    """struct of how often each letter of ALPHABET occurs."""
    return F.struct(*[(F.length(_column(seq)) - F.length(F.replace(_column(seq), F.lit(x), F.lit("")))).cast("long").alias(x) for x in ALPHABET])


def centred(seq: Column | str, size: int) -> Column:
    """The junction's letters nearest to its H: size before, size after, padded outward with N; H itself goes."""
    s = _column(seq)
    at = F.instr(s, F.lit("H"))
    left, right = F.substring(s, F.lit(1), F.greatest(at - 1, F.lit(0))), F.substring(s, at + 1, F.lit(1 << 30))
    return F.concat(F.lpad(F.right(left, F.lit(size)), size, "N"), F.rpad(F.left(right, F.lit(size)), size, "N"))


def lacking(seq: Column | str, size: int) -> Column:
    """How many letters a sequence is short of a size; 0 if it is as long."""
    return F.greatest(F.lit(size) - F.length(_column(seq)), F.lit(0))


def filled(seq: Column | str, size: int) -> Column:
    """The sequence in the middle of N, as long as size; the odd one is on the right."""
    n = lacking(seq, size)
    left = F.floor(n / 2).cast("int")
    return F.concat(F.repeat(F.lit("N"), left), _column(seq), F.repeat(F.lit("N"), n - left))


def masked(seq: Column | str, n: Column | str) -> Column:
    """The sequence with n of its outer letters as N, half on each side, the odd one on the right; all of them if it has fewer."""
    s = _column(seq)
    n = F.least(F.greatest(_column(n), F.lit(0)), F.length(s))
    left = F.floor(n / 2).cast("int")
    return F.concat(F.repeat(F.lit("N"), left), F.substring(s, left + 1, F.length(s) - n), F.repeat(F.lit("N"), n - left))
