"""Index arithmetic: virtual offsets, the binning scheme, binomial coefficients."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First bin number and shift of each level of the binning scheme.
LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
WINDOW_SHIFT = 14


def make_virtual_offset(block: int, within: int) -> int:
    if not 0 <= within < 1 << 16:
        raise ValueError(f"the place within a block is below 65536, not {within}")
    if not 0 <= block < 1 << 48:
        raise ValueError(f"the start of a block is below 2**48, not {block}")
    return block << 16 | within


def split_virtual_offset(offset: int) -> tuple[int, int]:
    return offset >> 16, offset & 0xFFFF


def virtual_offset(block: Column, within: Column) -> Column:
    return F.shiftleft(block.cast("bigint"), 16).bitwiseOR(within.cast("bigint"))


def block_start(offset: Column) -> Column:
    return F.shiftrightunsigned(offset, 16)


def within_block(offset: Column) -> Column:
    return offset.bitwiseAND(F.lit(65535).cast("bigint"))


def region_bins(begin: int, end: int) -> list[int]:
    """Bins that may overlap ``[begin, end)``, finest and last first."""
    return [b for first, shift in reversed(LEVELS) for b in range(first + (end - 1 >> shift), first + (begin >> shift) - 1, -1)]


def region_bins_column(begin: Column, end: Column) -> Column:
    """The same as a column."""
    levels = [F.sequence(F.lit(first) + F.shiftright(begin, shift), F.lit(first) + F.shiftright(end - 1, shift)) for first, shift in LEVELS]
    return F.reverse(F.flatten(F.array(*levels)))


def finest_bin(begin: Column, end: Column) -> Column:
    """The one bin a record is filed under: the finest that holds it whole."""
    out = F.lit(0).cast("bigint")
    for first, shift in LEVELS[1:]:
        out = F.when(F.shiftright(begin, shift) == F.shiftright(end - 1, shift), F.lit(first) + F.shiftright(begin, shift)).otherwise(out)
    return out


def binomial(n: int, k: int) -> int:
    """Ways to choose; 0 for negative numbers."""
    return math.comb(n, k) if n >= 0 and k >= 0 else 0
