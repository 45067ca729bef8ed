"""Batches of a token budget: padded to its longest row, a batch has no more tokens than the budget.

Rows are taken in order, greedily: a batch takes the next row as long as its rows times its longest row
stay within the budget. Where a batch ends depends on where it began, and so on all rows before. The cuts
are found in parallel all the same:

1. rows are numbered and dealt into blocks. For each of the first places of a block, where a batch may
   begin that the block before has left open, one pass finds the place at which the next block would be
   entered;
2. these jumps from block to block are composed by pointer doubling, which leaves the one place where each
   block is really entered: as many joins as the number of blocks has binary digits, over few rows;
3. each block is cut from there.

Results equal those of the sequential cut for any partitioning and block size.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators import joins, order
from pairloom.operators.features import padding

# Rows of a block, in multiples of the most rows of a batch.
BLOCKS = 16


def next_starts(lengths: np.ndarray, budget: int, most_rows: int) -> np.ndarray:
    """For each row, where the batch after the one that begins there begins."""
    n = len(lengths)
    out = np.empty(n, np.int64)
    stop, longest = 0, deque()  # rows that may be the longest of the batch, by falling length
    for start in range(n):
        stop = max(stop, start)
        while longest and longest[0] < start:
            longest.popleft()
        while stop < n and stop - start < most_rows:
            top = max(int(lengths[longest[0]]) if longest else 0, int(lengths[stop]))
            if stop > start and (stop - start + 1) * top > budget:
                break
            while longest and lengths[longest[-1]] <= lengths[stop]:
                longest.pop()
            longest.append(stop)
            stop += 1
        out[start] = stop
    return out


def _entered(jumps: DataFrame) -> DataFrame:
    """(entry) of the places on the way from place 0. ``jumps`` has (entry, exit); the last exit is no entry."""
    places = jumps.select("entry")
    reached = jumps.filter("entry = 0").select("entry")
    reached = order.written(reached, "entries")
    while not jumps.isEmpty():
        ahead = joins.lookup(reached, jumps, ["entry"]).select(F.col("exit").alias("entry"))
        more = order.written(reached.unionByName(ahead).distinct(), "entries")
        further = jumps.select(F.col("entry").alias("exit"), F.col("exit").alias("beyond"))
        jumps = order.written(joins.lookup(jumps, further, ["exit"]).select("entry", F.col("beyond").alias("exit")), "jumps")
        reached = more
    return joins.lookup(reached, places, ["entry"])


def token_batches(
    df: DataFrame,
    budget: int,
    order_by: str | Sequence[str],
    length: str,
    most_rows: int = 1024,
    blocks: int = BLOCKS,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Rows with rn, batch_id and batch_len, the batch's longest ``length`` (null counts as 0).

    A batch has at most ``most_rows`` rows; a row longer than the budget is a batch of its own.
    """
    if budget < 1 or most_rows < 1:
        raise ValueError("budget and most_rows must be positive")
    size = blocks * most_rows
    numbered = order.written(order.dense_index(df, order_by, "rn", rows_per_range), "numbered")
    narrow = numbered.select("rn", F.coalesce(F.col(length), F.lit(0)).cast("bigint").alias("n"), F.expr(f"rn div {size}").alias("block"))
    # A block sees as many rows of the next one as a batch may have.
    seen = narrow.withColumn(
        "block", F.explode(F.when((F.col("rn") % size < most_rows) & (F.col("block") > 0), F.array("block", F.col("block") - 1)).otherwise(F.array("block")))
    )

    def jumps_of(block: pd.DataFrame) -> pd.DataFrame:
        rows = block.sort_values("rn")
        first, number = int(rows["rn"].iloc[0]), int(block["block"].iloc[0])
        ahead = next_starts(rows["n"].to_numpy(), budget, most_rows)
        end = min(size, len(rows))
        exits = ahead.copy()
        for place in range(end - 1, -1, -1):
            if ahead[place] < end:
                exits[place] = exits[ahead[place]]
        entries = np.arange(1 if number == 0 else min(most_rows, end))
        # Where a block has no row after it, its exits are no places.
        return pd.DataFrame({"entry": first + entries, "exit": first + exits[entries]})

    jumps = order.written(seen.groupBy("block").applyInPandas(jumps_of, "entry long, exit long"), "jumps")
    entries = _entered(jumps).select("entry", F.expr(f"entry div {size}").alias("block"))
    entered = order.written(seen.join(entries, "block", "left"), "blocks")

    def cut(block: pd.DataFrame) -> pd.DataFrame:
        rows = block.sort_values("rn")
        first = int(rows["rn"].iloc[0])
        lengths = rows["n"].to_numpy()
        starts, stops, tops = [], [], []
        if not np.isnan(block["entry"].iloc[0]):
            ahead = next_starts(lengths, budget, most_rows)
            place, end = int(block["entry"].iloc[0]) - first, min(size, len(rows))
            while place < end:
                starts.append(first + place)
                stops.append(first + int(ahead[place]))
                tops.append(int(lengths[place : ahead[place]].max()))
                place = int(ahead[place])
        return pd.DataFrame({"start": starts, "stop": stops, "batch_len": tops}, dtype="int64")

    cuts = order.written(entered.groupBy("block").applyInPandas(cut, "start long, stop long, batch_len long"), "cuts")
    batches = order.dense_index(cuts, "start", "batch_id")
    each = order.written(batches.select("batch_id", "batch_len", F.explode(F.sequence("start", F.col("stop") - 1)).alias("rn")), "batches")
    return joins.lookup(numbered, each, ["rn"])


def pad_to_token_budget(
    df: DataFrame,
    budget: int,
    order_by: str | Sequence[str],
    pad_id: int,
    ids: str = "input_ids",
    labels: str | None = "labels",
    most_rows: int = 1024,
) -> DataFrame:
    """Pad each row to the longest of its batch; labels are padded with the index that losses ignore.

    Adds rn, batch_id and the attention mask.
    """
    rows = df.withColumn("__length", F.array_size(ids))
    rows = token_batches(rows, budget, order_by, "__length", most_rows)
    return padding(rows, F.col("batch_len") - F.col("__length"), pad_id, ids, labels).drop("batch_len", "__length")
