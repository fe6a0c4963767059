"""Predicates on the bit flags of alignments, and on their clips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the alignment format.
UNMAPPED, MATE_UNMAPPED, REVERSE, SECONDARY, QC_FAIL = 4, 8, 16, 256, 512


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def has(flag: Column | str, bits: int) -> Column:
    """All of these bits are set."""
    return _column(flag).bitwiseAND(F.lit(bits)) == bits


def lacks(flag: Column | str, bits: int) -> Column:
    """None of these bits is set."""
    return _column(flag).bitwiseAND(F.lit(bits)) == 0


def anchored_mate(flag: Column | str) -> Column:
    """Mapped, primary, its mate unmapped."""
    return has(flag, MATE_UNMAPPED) & lacks(flag, UNMAPPED | SECONDARY)


def unmapped_mate(flag: Column | str) -> Column:
    """Unmapped, primary, its mate mapped."""
    return has(flag, UNMAPPED) & lacks(flag, MATE_UNMAPPED | SECONDARY)


def primary(flag: Column | str) -> Column:
    """Mapped, primary, not failed by the sequencer."""
    return lacks(flag, UNMAPPED | SECONDARY | QC_FAIL)


def is_reverse(flag: Column | str) -> Column:
    return ~lacks(flag, REVERSE)
