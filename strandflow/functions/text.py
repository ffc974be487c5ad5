"""Text column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of Unicode, the zero-width space and the byte order mark included.
SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def strip_space(c: Column) -> Column:
    """``c`` without surrounding white space of any kind."""
    return F.btrim(c, F.lit(SPACES))


def blank(c: Column) -> Column:
    """True for null, empty or white space only."""
    return F.coalesce(F.length(strip_space(c)) == 0, F.lit(True))


def base_name(c: Column) -> Column:
    """The part of a path after its last slash (of either kind), surrounding white space removed."""
    return strip_space(F.substring_index(F.substring_index(strip_space(c), "/", -1), "\\", -1))
