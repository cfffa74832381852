"""Column functions for keys, types and statuses that are spelt unevenly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space.
SPACE = " \t\n\r　"
_WIDE = "".join(chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
_PLAIN = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)
_EDGES = "^[ \\t\\n\\r\\u3000]+|[ \\t\\n\\r\\u3000]+$"


def strip(c: Column) -> Column:
    """``c`` without SPACE at either end."""
    return F.btrim(c, F.lit(SPACE))


def is_blank(c: Column) -> Column:
    """Null, empty or only SPACE."""
    return c.isNull() | (strip(c) == "")


def match_key(c: Column) -> Column:
    """Form in which keys compare: full-width letters and digits as plain ones, no surrounding white space, upper case; null when blank."""
    plain = F.upper(strip(F.translate(c, _WIDE, _PLAIN)))
    return F.when(plain != "", plain)


def match_word(c: Column) -> Column:
    """Form in which types and statuses compare: no surrounding white space, upper case; null when blank."""
    plain = F.upper(strip(c))
    return F.when(plain != "", plain)
