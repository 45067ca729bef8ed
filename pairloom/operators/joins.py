"""Joins with a table whose keys are unique, that hold up under hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of the table that are broadcast.
MOST_ROWS = 500_000
# A key with so many times the rows of an even share of MOST_ROWS keys is hot; there are MOST_ROWS at most.
_HOT = "__hot"


def lookup(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", most_rows: int = MOST_ROWS,
    *, seen: str | None = None,
) -> DataFrame:
    """``rows`` with the columns of ``table``, which has each key once; ``how`` is inner or left.

    A table of up to ``most_rows`` rows, by a count, is broadcast. Of a larger one, the entries of hot keys
    are broadcast, those that more than one in ``most_rows`` of all rows have; the others are joined by key.
    ``rows`` and ``table`` are read several times, so they should be written tables. ``seen`` names a column
    of ``table`` that is left out of the result: how many rows, about, have each key. Then rows are not
    counted by key.
    """
    keys = list(keys)
    counted, table = table, table.drop(seen) if seen else table
    if table.limit(most_rows + 1).count() <= most_rows:
        return rows.join(F.broadcast(table), keys, how)
    if seen:
        least = max(2, (counted.agg(F.sum(seen)).first()[0] or 0) // max(1, most_rows))
        hot = counted.filter(F.col(seen) > least).select(*keys)
    else:
        least = max(2, rows.count() // max(1, most_rows))
        hot = rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > least).drop("__n")
    marked = rows.join(F.broadcast(hot.withColumn(_HOT, F.lit(True))), keys, "left")
    few = table.join(F.broadcast(hot), keys, "left_semi")
    return (
        marked.filter(_HOT).drop(_HOT).join(F.broadcast(few), keys, how)
        .unionByName(marked.filter(F.col(_HOT).isNull()).drop(_HOT).join(table, keys, how))
    )
