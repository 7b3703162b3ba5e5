"""Broadcast only what is known to be small."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_CHARS = 64 * 1024 * 1024


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_chars: int = MAX_BROADCAST_CHARS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_chars`` characters; reads no more than that."""
    chars = F.coalesce(F.length(F.to_json(F.struct("*"))), F.lit(0))
    rows, total = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(chars), F.lit(0))).first()
    return rows <= max_rows and total <= max_chars


def hinted(df: DataFrame, small: bool) -> DataFrame:
    """``df`` with a broadcast hint if it was found small.

    Without the hint a join is a shuffle join, whose hot keys adaptive execution splits.
    """
    return F.broadcast(df) if small else df
