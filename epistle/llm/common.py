"""What the operators share: words, staged tables, size-checked broadcasts, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, shared_dir, staged  # noqa: F401

#: White space is what the regex class [\x20\x09-\x0D] matches, nothing else.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Rows up to which a side with a known count is broadcast (at most some 24 bytes a row).
BROADCAST_ROWS = 500_000


def if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when its counted rows are few; else Spark shuffles it and AQE splits skew."""
    return F.broadcast(df) if rows <= limit else df


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(column: str | Column) -> Column:
    return F.regexp_extract_all(text_of(column), F.lit(WORD), F.lit(0))


#: Bytes of UTF-8 words of letters and digits stay, A-Z in lower case; all others become a blank (bytes from 0x80 belong to words).
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
