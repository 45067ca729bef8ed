"""Putting corpora together: alignment by position, unions, exact duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators import order, sample, select


def align_lines(
    left: DataFrame,
    right: DataFrame,
    names: tuple[str, str] = ("en", "ko"),
    index: str = "line_no",
    text: str = "line",
) -> DataFrame:
    """Pair two numbered line sets by position; the shorter one ends the result."""
    a = left.select(index, F.col(text).alias(names[0]))
    b = right.select(index, F.col(text).alias(names[1]))
    return a.join(b, index, "inner")


def concat_corpora(
    corpora: Sequence[tuple], name: str = "english"
) -> DataFrame:
    """Union in the given order with a fresh row number over all.

    Each corpus is (frame, text column, unique order key), and its row count as a fourth where known. ``pos`` numbers the rows of one corpus;
    ``rn`` goes on over the corpora, as each one's row count is known from its numbering.
    """
    result, before = None, 0
    for source_ord, (df, col, order_by, *known) in enumerate(corpora):
        keys = [order_by] if isinstance(order_by, str) else list(order_by)
        narrow = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(col).alias(name))
        part, n_rows = order.indexed(narrow, [f"_k{i}" for i in range(len(keys))], "pos", n_rows=known[0] if known else None)
        part = part.select(
            (F.col("pos") + before).alias("rn"),
            F.lit(source_ord).alias("source_ord"),
            "pos",
            name,
        )
        before += n_rows
        result = part if result is None else result.unionByName(part)
    if result is None:
        raise ValueError("no corpus to concatenate")
    return result


@dataclass(frozen=True)
class Source:
    """One part of a mix: its text column, unique order key, and how many rows go in.

    ``mode`` is 'head' (first rows), 'shuffle' (first rows of a seeded shuffle) or 'all'.
    """

    df: DataFrame
    column: str
    order_by: str | Sequence[str]
    mode: str = "all"
    cap: int | None = None


def _row_counts(frames: Sequence[DataFrame]) -> list[int]:
    """Rows of several frames, in one query."""
    rows = None
    for i, df in enumerate(frames):
        part = df.select(F.lit(i).alias("i"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return []
    found = {row.i: row.n for row in rows.groupBy("i").agg(F.count("*").alias("n")).collect()}
    return [found.get(i, 0) for i in range(len(frames))]


def mix_corpora(sources: Sequence[Source], seed: int, name: str = "text") -> DataFrame:
    """Union of several corpora, each with its own cap, under one column name."""
    parts = []
    counts = _row_counts([source.df for source in sources])
    for source, n_source in zip(sources, counts):
        keys = [source.order_by] if isinstance(source.order_by, str) else list(source.order_by)
        df = source.df.select(*dict.fromkeys([*keys, source.column]))
        if source.mode not in ("head", "shuffle", "all"):
            raise ValueError(f"unknown mode: {source.mode}")
        if source.mode != "all" and source.cap is None:
            raise ValueError(f"mode {source.mode} needs a cap")
        n_rows = n_source
        if source.mode == "head":
            df, n_rows = select.counted_head(df, source.cap, keys, n_rows=n_source)
        elif source.mode == "shuffle":
            df, n_rows = sample.counted_shuffle_head(
                df, source.cap, seed, keys, "_rank_of_mix", numbered=False, n_rows=n_source
            )
            keys = ["_rank_of_mix"]
        parts.append((df, source.column, keys, n_rows))
    return concat_corpora(parts, name)


def dedup_pairs(df: DataFrame, keys: Sequence[str], order_by: str) -> DataFrame:
    """Distinct keys with the lowest order value of each, that is their first occurrence.

    Copies are folded together before the shuffle, so a pair that makes up a large share of the
    rows reaches its reducer once per map task. Nulls count as equal.
    """
    return df.groupBy(*keys).agg(F.min(order_by).alias(order_by))
