"""Exact seeded samples and splits.

Rows are ranked by the md5 of seed and key. The key at the cut position is found on the key columns
alone, and sample, train and test set are then plain filters against that one literal: no join, no
shuffle of wide rows, and the same rows for the same seed whatever the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators import order
from pairloom.session import remove_dir, scratch_dir

_RANK = "_rank"


def rank_key(seed: int, key: str | Sequence[str], types: dict | None = None) -> Column:
    """Pseudo-random rank of a row: md5 over seed and unique key.

    Of several key columns, texts go in as their own md5, so that no text can look like two columns.
    """
    keys = [key] if isinstance(key, str) else list(key)
    parts = []
    for name in keys:
        part = F.col(name).cast("string")
        if len(keys) > 1 and (types or {}).get(name) == "string":
            part = F.md5(part)
        parts.append(F.coalesce(part, F.lit("")) if len(keys) > 1 else part)
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def _cut(
    df: DataFrame,
    seed: int,
    key: str | Sequence[str],
    size_of: Callable[[int], int],
    rows_per_range: int | None = None,
    n_rows: int | None = None,
) -> tuple[DataFrame, int, int, Column | None]:
    """Ranked frame, row count, sample size, and the condition that picks the sample."""
    types = dict(df.dtypes)
    ranked = df.withColumn(_RANK, rank_key(seed, key, types))
    ranks, path = ranked.select(_RANK), None
    if any(types[k] == "string" for k in ([key] if isinstance(key, str) else key)):
        # The ranks are read several times; texts, often the bulk of the data, only once for them.
        path = scratch_dir(df.sparkSession, "ranks")
        ranks = order.written(ranks, path=path)

    total, keys = order.nth_keys(ranks, _RANK, lambda total: [size_of(total)], rows_per_range, n_rows)
    if path is not None:
        remove_dir(df.sparkSession, path)  # the cut stands in the plan as a literal
    size = size_of(total)
    condition = order.up_to(ranked, _RANK, keys[size]) if size in keys else None
    return ranked, total, size, condition


def sample_n(
    df: DataFrame,
    n: int,
    seed: int,
    key: str | Sequence[str],
    on_short: str = "error",
    rows_per_range: int | None = None,
) -> DataFrame:
    """Exactly ``n`` rows without replacement.

    When there are fewer rows, ``on_short='error'`` raises and ``'all'`` gives every row.
    """
    return _sampled(df, n, seed, key, on_short, rows_per_range)[0].drop(_RANK)


def _sampled(df, n, seed, key, on_short, rows_per_range, n_rows=None) -> tuple[DataFrame, int]:
    if on_short not in ("error", "all"):
        raise ValueError("on_short must be 'error' or 'all'")
    if n < 0:
        raise ValueError("the sample size must not be negative")
    ranked, total, _, condition = _cut(df, seed, key, lambda total: n, rows_per_range, n_rows)
    if n > total and on_short == "error":
        raise ValueError(f"sample of {n} is larger than the population of {total}")
    if n == 0:
        return ranked.limit(0), 0
    return (ranked, total) if n >= total else (ranked.filter(condition), n)


def shuffle_head(
    df: DataFrame,
    n: int,
    seed: int,
    key: str | Sequence[str],
    rank_name: str = "shuffle_rank",
    rows_per_range: int | None = None,
) -> DataFrame:
    """First ``n`` rows of a seeded shuffle, with their place in it."""
    return counted_shuffle_head(df, n, seed, key, rank_name, rows_per_range)[0]


def counted_shuffle_head(
    df: DataFrame,
    n: int,
    seed: int,
    key: str | Sequence[str],
    rank_name: str = "shuffle_rank",
    rows_per_range: int | None = None,
    numbered: bool = True,
    n_rows: int | None = None,
) -> tuple[DataFrame, int]:
    """``shuffle_head`` and how many rows that is; unnumbered, the rank is a text that sorts alike.

    ``n_rows`` is the row count of ``df`` where known.
    """
    chosen, n_rows = _sampled(df, n, seed, key, "all", rows_per_range, n_rows)
    if not numbered:
        return chosen.withColumnRenamed(_RANK, rank_name), n_rows
    placed, _ = order.indexed(chosen, _RANK, rank_name, rows_per_range, n_rows=n_rows)
    return placed.drop(_RANK), n_rows


def _split(df, seed, key, size_of, rows_per_range, n_rows=None) -> tuple[DataFrame, DataFrame]:
    ranked, total, size, condition = _cut(df, seed, key, size_of, rows_per_range, n_rows)
    if size > total:
        raise ValueError(f"test set of {size} is larger than the data set of {total}")
    if size == 0:
        return df, df.limit(0)
    if size == total:
        return df.limit(0), df
    return ranked.filter(~condition).drop(_RANK), ranked.filter(condition).drop(_RANK)


def split_fraction(
    df: DataFrame,
    fraction: float,
    seed: int,
    key: str | Sequence[str],
    rows_per_range: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train and test set; the test set has ``ceil(fraction * rows)`` rows."""
    if not 0 <= fraction <= 1:
        raise ValueError("the fraction must lie between 0 and 1")
    return _split(df, seed, key, lambda total: math.ceil(fraction * total), rows_per_range)


def split_count(
    df: DataFrame,
    n_validation: int,
    seed: int,
    key: str | Sequence[str],
    rows_per_range: int | None = None,
    n_rows: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Train and validation set of an absolute size; size 0 means no validation set.

    ``n_rows`` is the row count of ``df`` where known.
    """
    if n_validation <= 0:
        return df, None
    return _split(df, seed, key, lambda total: n_validation, rows_per_range, n_rows)
