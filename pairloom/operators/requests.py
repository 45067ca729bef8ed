"""Grouping texts into translation requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import constants
from pairloom.operators import order


def batch_rows(
    df: DataFrame,
    col: str,
    size: int = constants.BATCH_SIZE,
    order_by: str | Sequence[str] | None = None,
    index: str | None = None,
    newline: str = "keep",
    rows_per_range: int | None = None,
) -> DataFrame:
    """Join each run of ``size`` consecutive rows with line breaks; the last run may be short.

    Give either a unique sort key (``order_by``) or the name of a column that already numbers the
    rows from 0 (``index``). With a sort key the ranges are aligned to ``size``, so grouping needs
    no shuffle beyond the one that numbers the rows. ``newline='space'`` replaces line breaks
    inside a text, which would otherwise look like extra rows. A null text is an empty line.
    """
    if (order_by is None) == (index is None):
        raise ValueError("give either order_by or index")
    if newline not in ("keep", "space"):
        raise ValueError("newline must be 'keep' or 'space'")
    text = F.col(col) if newline == "keep" else F.regexp_replace(col, r"\r\n|\r|\n", " ")
    if index is not None:
        numbered = df.select(F.col(index).alias("_rn"), text.alias("_text"))
        groups = []
    else:
        keys = [order_by] if isinstance(order_by, str) else list(order_by)
        narrow = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], text.alias("_text"))
        keys = [f"_k{i}" for i in range(len(keys))]
        ranges = order.plan_ranges(narrow, keys, align=size, rows_per_range=rows_per_range)
        numbered = order.number_rows(narrow, ranges, "_rn")
        groups = [order.RANGE]
    rows = F.sort_array(F.collect_list(F.struct("_rn", "_text")))
    return (
        numbered.groupBy(*groups, F.expr(f"_rn div {int(size)}").alias("batch_id"))
        .agg(F.count("*").alias("n"), rows.alias("_rows"))
        .select(
            "batch_id",
            "n",
            F.array_join(F.transform("_rows", lambda row: row["_text"]), "\n", "").alias("content"),
        )
    )


def task_id(batch_id: Column | str = "batch_id") -> Column:
    """Request id of a batch."""
    return F.concat(F.lit("task-"), (F.col(batch_id) if isinstance(batch_id, str) else batch_id).cast("string"))


def build_requests(
    batches: DataFrame,
    system_prompt: str = constants.TRANSLATION_SYSTEM_PROMPT_KO,
    model: str = constants.REQUEST_MODEL,
    temperature: float = constants.REQUEST_TEMPERATURE,
    url: str = constants.REQUEST_URL,
) -> DataFrame:
    """Wrap each batch in the request object of the batch interface."""
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("content").alias("content")),
    )
    body = F.struct(
        F.lit(model).alias("model"),
        F.lit(float(temperature)).alias("temperature"),
        F.struct(F.lit("json_object").alias("type")).alias("response_format"),
        messages.alias("messages"),
    )
    request = F.struct(
        F.col("custom_id"),
        F.lit("POST").alias("method"),
        F.lit(url).alias("url"),
        body.alias("body"),
    )
    return batches.select(task_id().alias("custom_id"), "content").select(
        "custom_id", request.alias("request")
    )
