"""Profiles of large corpora from sketches: one pass each, and profiles of parts can be merged.

A sketch row holds exact counts and three summaries of bounded size: of how many different texts there are
(HyperLogLog), of how long they are (KLL quantiles), and of the texts that occur most (frequent items).
Rows of parts, days or tasks are merged by ``merge`` without looking at the texts again.

Bounds, for the default sizes: the number of different texts is off by 1.04 / sqrt(2 ** HLL_BITS), 0.8%, in
standard deviations; a quantile's rank by about 1.65% of the rows at KLL_SIZE 200; every text with more than
``3.5 / TOP_ITEMS`` of the rows is among the most frequent, with a count too high by at most that share.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HLL_BITS = 14
KLL_SIZE = 200
TOP_ITEMS = 8192
QUANTILES = (0.01, 0.25, 0.5, 0.75, 0.99)


def sketch(df: DataFrame, text: str, name: str = "corpus") -> DataFrame:
    """One row: corpus, n_rows, n_null, n_chars, min_len, max_len and the three sketches. Nulls are counted only."""
    length = F.length(text).cast("bigint")
    digest = F.md5(F.col(text).cast("binary"))
    return df.select(length.alias("length"), digest.alias("digest")).agg(
        F.lit(name).alias("corpus"),
        F.count("*").alias("n_rows"),
        F.count_if(F.col("digest").isNull()).alias("n_null"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("n_chars"),
        F.min("length").alias("min_len"),
        F.max("length").alias("max_len"),
        F.hll_sketch_agg("digest", HLL_BITS).alias("different"),
        F.kll_sketch_agg_bigint("length", KLL_SIZE).alias("lengths"),
        F.expr(f"approx_top_k_accumulate(digest, {TOP_ITEMS}) FILTER (WHERE digest IS NOT NULL)").alias("frequent"),
    )


def merge(sketches: DataFrame) -> DataFrame:
    """One row per corpus from rows of its parts."""
    return sketches.groupBy("corpus").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_null").alias("n_null"),
        F.sum("n_chars").alias("n_chars"),
        F.min("min_len").alias("min_len"),
        F.max("max_len").alias("max_len"),
        F.hll_union_agg("different").alias("different"),
        F.kll_merge_agg_bigint("lengths").alias("lengths"),
        F.expr(f"approx_top_k_combine(frequent, {TOP_ITEMS})").alias("frequent"),
    )


def estimates(sketches: DataFrame, quantiles: Sequence[float] = QUANTILES, k: int = 10) -> DataFrame:
    """(corpus, n_rows, n_null, n_chars, min_len, max_len, n_different, length_quantiles, most_frequent).

    ``most_frequent`` lists (digest, n) of up to ``k`` texts, the most frequent first. Quantiles are null
    where a corpus has no text.
    """
    some = F.col("n_rows") > F.col("n_null")
    ranks = F.array(*[F.lit(float(q)) for q in quantiles])
    top = F.expr(f"approx_top_k_estimate(frequent, {int(k)})")
    return sketches.select(
        "corpus", "n_rows", "n_null", "n_chars", "min_len", "max_len",
        F.hll_sketch_estimate("different").alias("n_different"),
        F.when(some, F.kll_sketch_get_quantile_bigint("lengths", ranks)).alias("length_quantiles"),
        F.transform(top, lambda item: F.struct(item["item"].alias("digest"), item["count"].alias("n"))).alias("most_frequent"),
    )


def profile_sketches(corpora: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Sketch rows of several corpora (name -> frame, text column)."""
    if not corpora:
        raise ValueError("no corpus to profile")
    return reduce(DataFrame.unionByName, [sketch(df, text, name) for name, (df, text) in corpora.items()])
