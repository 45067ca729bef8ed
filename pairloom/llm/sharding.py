"""Sharding: a Feistel permutation of global row numbers, with cycle walking.

Rows are numbered by content (hash bucket, then id, size and checksum), so the numbering depends on
the rows alone and not on files, splits or partitions. A keyed Feistel network permutes 0..n-1, and
the permuted number gives the shard (remainder) and the place in it (quotient): shard sizes differ
by one row at most, and either side can be computed from the other without a table.

The network works on a rectangle of a x b numbers with a near the square root of n. Its area passes n
by fewer than a, so a walk ends after a*b - n + 1 steps at most, and at most a*b - n rows walk at all.

Only DataFrame functions are used. The text is read once, for its size and checksum; all else works
on four narrow columns in the shared folder. Rows equal in all of these are counted before the
shuffle and numbered as a run, so a hot row costs one row until the end.

Nulls: a null text has no bytes (size 1, checksum 0); a null id sorts first. Empty table: no rows.
Other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import one_per_copy, saved, text_or_empty

ROUNDS = 6


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of 0..n-1 as column expressions."""

    n: int
    seed: int

    @property
    def sides(self) -> tuple[int, int]:
        a = max(1, math.isqrt(max(self.n, 1) - 1) + 1)
        return a, -(-max(self.n, 1) // a)

    def _mix(self, half: Column, key: Column, side: int) -> Column:
        return F.pmod(F.xxhash64(half, key, F.lit(self.seed)), F.lit(side).cast("bigint"))

    def _network(self, x: Column, inverse: bool) -> Column:
        a, b = (F.lit(side).cast("bigint") for side in self.sides)
        size_a, size_b = self.sides
        start = F.struct((x % a).alias("l"), F.call_function("div", x, a).alias("r"))
        keys = [F.lit(2 * i).cast("bigint") for i in range(ROUNDS)]

        def forward(half: Column, key: Column) -> Column:
            left = F.pmod(half["l"] + self._mix(half["r"], key, size_a), a)
            right = F.pmod(half["r"] + self._mix(left, key + 1, size_b), b)
            return F.struct(left.alias("l"), right.alias("r"))

        def back(half: Column, key: Column) -> Column:
            right = F.pmod(half["r"] - self._mix(half["l"], key + 1, size_b), b)
            left = F.pmod(half["l"] - self._mix(right, key, size_a), a)
            return F.struct(left.alias("l"), right.alias("r"))

        order = F.array(*(reversed(keys) if inverse else keys))
        return F.aggregate(order, start, back if inverse else forward, lambda h: h["r"] * a + h["l"])

    def _walk(self, x: Column, inverse: bool) -> Column:
        first = self._network(x, inverse)
        outside = self.sides[0] * self.sides[1] - self.n
        if not outside:
            return first
        n = F.lit(self.n).cast("bigint")
        steps = F.sequence(F.lit(1), F.lit(outside))
        walked = F.aggregate(
            steps, first, lambda y, _: F.when(y < n, y).otherwise(self._network(y, inverse))
        )
        return F.when(first < n, first).otherwise(walked)

    def apply(self, x: Column) -> Column:
        """Where row number ``x`` goes."""
        return self._walk(x.cast("bigint"), inverse=False)

    def invert(self, y: Column) -> Column:
        """Which row number went to ``y``."""
        return self._walk(y.cast("bigint"), inverse=True)


def number_rows(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, size, text_crc32, row_number) with row numbers from 0, and how many rows there are."""
    text = text_or_empty(text_col)
    keys = [id_col, "size", "text_crc32"]
    rows = df.select(
        F.col(id_col),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = saved(rows.groupBy(*keys).agg(F.count("*").alias("copies")), "shard-rows")
    n = rows.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n
    # About sqrt(n) buckets of sqrt(n) rows each.
    n_buckets = 1 << max(0, math.ceil(math.log2(max(n, 1)) / 2))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(n_buckets)))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("bucket")
        .agg(F.sum("copies").alias("in_bucket"))
        .select("bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        rows.withColumn("within", F.coalesce(F.sum("copies").over(within), F.lit(0)))
        .join(F.broadcast(offsets), "bucket")  # one row per bucket: the square root of n
        .select(*keys, "copies", (F.col("offset") + F.col("within")).alias("first"))
    )
    expanded = one_per_copy(numbered, "copies", "copy")
    return expanded.select(*keys, (F.col("first") + F.col("copy")).alias("row_number")), n


def shard_rows(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, seed: int = 2024
) -> DataFrame:
    """(id, size, text_crc32, row_number, shard, slot): each row's shard and its place in it."""
    numbered, n = number_rows(df, id_col, text_col)
    place = numbered.withColumn("place", Permutation(n, seed).apply(F.col("row_number")))
    return place.select(
        id_col,
        "size",
        "text_crc32",
        "row_number",
        (F.col("place") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("place"), F.lit(shards).cast("bigint")).alias("slot"),
    )


def row_at(shard: Column, slot: Column, n: int, shards: int = 8, seed: int = 2024) -> Column:
    """The row number at a place: the inverse of ``shard_rows``."""
    return Permutation(n, seed).invert(slot * F.lit(shards) + shard)
