"""A simple quality score for sentence pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_quality(
    df: DataFrame, source: str = "en", target: str = "ko", script: str = "[가-힣]"
) -> DataFrame:
    """Add length ratio, flags for empty and copied targets, the share of target-script letters,
    and a score: 0 for empty or copied pairs, else the mean of length balance and script share."""
    a, b = F.length(source), F.length(target)
    empty = F.coalesce((a == 0) | (b == 0), F.lit(True))
    copied = F.coalesce(F.col(source) == F.col(target), F.lit(False))
    return (
        df.withColumn("len_ratio", F.when(a > 0, b / a))
        .withColumn("is_empty", empty)
        .withColumn("is_copy", copied)
        .withColumn(
            "target_script_share",
            F.when(b > 0, F.regexp_count(target, F.lit(script)) / b).otherwise(F.lit(0.0)),
        )
        .withColumn(
            "score",
            F.when(F.col("is_empty") | F.col("is_copy"), F.lit(0.0)).otherwise(
                (F.least(a, b) / F.greatest(a, b) + F.col("target_script_share")) / 2
            ),
        )
    )


def filter_pairs(
    df: DataFrame,
    min_score: float = 0.5,
    min_chars: int = 1,
    max_ratio: float = 3.0,
    source: str = "en",
    target: str = "ko",
    script: str = "[가-힣]",
) -> tuple[DataFrame, DataFrame]:
    """Pairs worth keeping, and the others with the first ``reason`` that applies.

    Reasons: empty, copy, too_short, length_ratio, low_score. The measures of ``pair_quality`` stay.
    """
    scored = pair_quality(df, source, target, script)
    ratio = F.col("len_ratio")
    reason = (
        F.when(F.col("is_empty"), "empty")
        .when(F.col("is_copy"), "copy")
        .when(F.least(F.length(source), F.length(target)) < min_chars, "too_short")
        .when((ratio > max_ratio) | (ratio * max_ratio < 1), "length_ratio")
        .when(F.col("score") < min_score, "low_score")
    )
    return scored.filter(reason.isNull()), scored.withColumn("reason", reason).filter(reason.isNotNull())
