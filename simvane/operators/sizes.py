"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 10_000


def bounded(df: DataFrame, rows: int = MOST_ROWS, must: bool = False) -> DataFrame:
    """df marked for a broadcast if it has at most `rows` rows; else df as it is, for Spark to shuffle, or with `must` an error: such a side pairs with every row of the other."""
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    if must:
        raise ValueError(f"more than {rows} rows on the side that every row is paired with")
    return df
