"""Filters, projections and row positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators import order


def min_length(df: DataFrame, col: str, n: int) -> DataFrame:
    """Keep rows whose text has at least ``n`` characters; a null text goes."""
    return df.filter(F.length(col) >= n)


def project_text(df: DataFrame, source: str, target: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One column under the common name, with any order keys that later steps need."""
    return df.select(*keep, F.col(source).alias(target))


def head_rows(
    df: DataFrame, n: int, order_by: str | Sequence[str], rows_per_range: int | None = None
) -> DataFrame:
    """The first ``n`` rows of a unique key, or all when there are fewer.

    The key at position ``n`` is found on the key columns alone; the rows are then a plain filter,
    which reaches the scan. Nothing wide is sorted or shuffled.
    """
    return row_range(df, 0, n, order_by, rows_per_range)


def counted_head(
    df: DataFrame,
    n: int,
    order_by: str | Sequence[str],
    rows_per_range: int | None = None,
    n_rows: int | None = None,
) -> tuple[DataFrame, int]:
    """``head_rows`` and how many rows that is. ``n_rows`` is the row count of ``df`` where known."""
    if n <= 0:
        return df.limit(0), 0
    total, keys = order.nth_keys(
        df, order_by, lambda total: [n] if n < total else [], rows_per_range, n_rows
    )
    return (df.filter(order.up_to(df, order_by, keys[n])) if n < total else df), min(n, total)


def row_range(
    df: DataFrame,
    start: int,
    stop: int,
    order_by: str | Sequence[str],
    rows_per_range: int | None = None,
) -> DataFrame:
    """Rows ``start`` (from 0) up to, not including, ``stop`` in key order."""
    if start < 0:
        raise ValueError("start must not be negative")
    if stop <= start:
        return df.limit(0)
    total, keys = order.nth_keys(df, order_by, lambda total: [start, stop], rows_per_range)
    if start >= total:
        return df.limit(0)
    if stop in keys and stop < total:
        df = df.filter(order.up_to(df, order_by, keys[stop]))
    if start > 0:
        df = df.filter(order.after(df, order_by, keys[start]))
    return df


def full_batches(
    df: DataFrame, size: int, order_by: str | Sequence[str], rows_per_range: int | None = None
) -> DataFrame:
    """Leave off the last rows so that the count is a multiple of ``size``."""
    total, keys = order.nth_keys(
        df, order_by, lambda total: [total - total % size] if total % size else [], rows_per_range
    )
    if total % size == 0:
        return df
    if total < size:
        return df.limit(0)
    return df.filter(order.up_to(df, order_by, keys[total - total % size]))


def max_examples(df: DataFrame, n: int | None, order_by: str | Sequence[str]) -> DataFrame:
    """Optional cap on a training set; no cap when ``n`` is None or 0. Use it before a split."""
    return head_rows(df, n, order_by) if n else df


def profile(corpora: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row count, columns, null count and text lengths of each corpus (name -> frame, text column)."""
    if not corpora:
        raise ValueError("no corpus to profile")
    rows = None
    for name, (df, col) in corpora.items():
        row = df.agg(
            F.lit(name).alias("corpus"),
            F.count("*").alias("n_rows"),
            F.lit(",".join(df.columns)).alias("columns"),
            F.count_if(F.col(col).isNull()).alias("n_null"),
            F.min(F.length(col)).cast("bigint").alias("min_len"),
            F.max(F.length(col)).cast("bigint").alias("max_len"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


def preview(df: DataFrame, n: int, order_by: str | Sequence[str]) -> DataFrame:
    """The first few rows, for looking at."""
    return head_rows(df, n, order_by)
