"""Keeping costly expressions from being computed more than once per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, keep: Sequence[str], **columns: Column) -> DataFrame:
    """Select columns so that each is computed once per row.

    Filters on a plain projection are copied below it together with the projection's expressions,
    and JSON would be parsed again for each of them. They are not copied below a generator.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [F.col("`" + name.replace("`", "``") + "`") for name in keep]
    return df.select(*kept, F.inline(F.array(row)))
