"""Global row order without a one-task sort.

A DataFrame has no row order, so everything that depends on position (numbering, running totals,
the first n rows, runs of ten rows) works on a unique sort key. The key space is cut into ranges:

1. one aggregation over the key columns counts the rows, which decides how many ranges are needed, and of a
   key that is a number or a point in time gives the cut keys too, by a quantile sketch;
2. other keys, and very many ranges, take their cuts from a sample of keys;
3. one aggregation over the key columns gives the rows and the total of each range, as rows are
   assigned to it, and so each range's start.

There is this one way for every size. Cut keys and starts then stand in the plan as literals, so a
row's range never depends on how Spark happened to partition the data or on a task being run again.
Results do not depend on where the cuts fall. Cuts hold keys without loss: points in time as
microseconds, whatever the session's time zone. Only the key columns are read for 1-3; wide rows are
shuffled once, by range.

Two rows of one key have no order: numbering raises when it meets a key twice, at any size. It also
raises when a range holds more rows than were counted, as an input does that changes between runs.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.rows import once
from pairloom.session import scratch_dir

# Rows and bytes that one window task should hold.
ROWS_PER_RANGE = 50_000
BYTES_PER_RANGE = 128 << 20
# Ranges that a plan may carry as literals; enough for 128 TB. Beyond, ranges grow evenly.
MAX_RANGES = 1 << 20
# Characters of all cut keys together. Longer sort keys are refused.
MAX_CUT_CHARS = 64 << 20
# Inputs that fit one task are still cut for the sake of the cores, into ranges of this many rows.
MIN_ROWS_PER_RANGE = 1_000
# Keys sampled per range; with 20 a range rarely grows past twice its share.
SAMPLE_PER_RANGE = 20
# Cuts that a quantile sketch gives at once, and its error as a share of a range: one in SKETCH_STEPS.
SKETCH_CUTS = 512
SKETCH_STEPS = 20
# Rows that the width of a row is estimated from. It decides sizes of partitions, never results.
WIDTH_ROWS = 200
RANGE = "__range"
_OWN = (RANGE, "__key", "__i", "__amount")


def _as_list(order_by: str | Sequence[str]) -> list[str]:
    return [order_by] if isinstance(order_by, str) else list(order_by)


def _plain(name: str, data_type: T.DataType) -> Column:
    """A key column as a value that sorts alike and goes through JSON without loss."""
    column = F.col(name)
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(data_type, T.TimestampNTZType):
        seconds = F.hour(column) * 3600 + F.minute(column) * 60
        micros = (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("bigint")
        days = F.unix_date(column.cast("date")).cast("bigint")
        return (days * 86_400 + seconds) * 1_000_000 + micros
    if isinstance(data_type, T.DateType):
        return F.unix_date(column)
    return column


def _key(df: DataFrame, order_by: Sequence[str]) -> Column:
    plain = [_plain(name, df.schema[name].dataType).alias(name) for name in order_by]
    return plain[0] if len(plain) == 1 else F.struct(*plain)


def _literal(text: str, data_type: T.DataType) -> Column:
    # from_json over a literal is folded to a constant, and is far quicker to build than one
    # literal expression per element.
    return F.from_json(F.lit(text), data_type)


@dataclass(frozen=True)
class KeyRanges:
    """Ranges of a sort key: range i holds the keys from cut i-1 up to, not including, cut i."""

    order_by: list[str]
    key_type: T.DataType
    cuts: list[str]  # each as {"k": key} JSON, ascending
    starts: list[int]  # running total before each range; one more than cuts
    total: int
    n_rows: int
    rows: list[int] = field(default_factory=list)  # rows of each range

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the number of the range that the row's key falls into."""
        taken = [name for name in _OWN if name in df.columns]
        if taken:
            raise ValueError(f"columns {taken} have names that are needed here; rename them")
        if not self.cuts:
            return df.withColumn(RANGE, F.lit(0))
        cut_type = T.StructType([T.StructField("k", self.key_type)])
        cuts = _literal(f"[{','.join(self.cuts)}]", T.ArrayType(cut_type))
        # Binary search for the number of cuts at or below the key, by halving steps.
        steps = F.array(
            *[F.lit(1 << bit) for bit in reversed(range(len(self.cuts).bit_length()))]
        )

        def advance(found: Column, step: Column) -> Column:
            cut = F.get(cuts, found + step - 1)["k"]
            return F.when(cut <= F.col("__key"), found + step).otherwise(found)

        # The key may be an expression such as a hash, and would be computed once per comparison.
        keyed = once(df, df.columns, __key=_key(df, self.order_by))
        return keyed.withColumn(RANGE, F.aggregate(steps, F.lit(0), advance)).drop("__key")

    def inside(self, df: DataFrame, number: int) -> Column:
        """Condition: the row's key lies in this range. On one column it reaches the scan."""
        key = _key(df, self.order_by)
        cut_type = T.StructType([T.StructField("k", self.key_type)])
        condition = F.lit(True)
        if number > 0:
            condition = key >= _literal(self.cuts[number - 1], cut_type)["k"]
        if number < len(self.cuts):
            below = key < _literal(self.cuts[number], cut_type)["k"]
            condition = condition & (below if number > 0 else below | key.isNull())
        return condition

    def start(self) -> Column:
        """Running total before the row's range."""
        return self.value(self.starts)

    def value(self, per_range: Sequence[int | None]) -> Column:
        """The row's entry in a list that holds one number per range."""
        if len(per_range) == 1:
            return F.lit(per_range[0]).cast("bigint")
        return F.get(_literal(json.dumps(per_range), T.ArrayType(T.LongType())), F.col(RANGE))

    def sizes(self) -> list[int]:
        return [b - a for a, b in zip(self.starts, self.starts[1:] + [self.total])]


def _row_bytes(df: DataFrame) -> float:
    """Bytes of an average row, from a few; 0 for rows of numbers and times only."""
    wide = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)
    if not any(isinstance(f.dataType, wide) for f in df.schema.fields):
        return 0.0
    few = df.limit(WIDTH_ROWS).select(F.octet_length(F.to_json(F.struct(*df.columns))).alias("n"))
    return few.agg(F.coalesce(F.avg("n"), F.lit(0.0))).first()[0]


def plan_ranges(
    df: DataFrame,
    order_by: str | Sequence[str],
    value: Column | None = None,
    align: int = 1,
    rows_per_range: int | None = None,
    spread: bool = True,
    n_rows: int | None = None,
) -> KeyRanges:
    """Cut the sort key into ranges of about ``rows_per_range`` rows, or ``BYTES_PER_RANGE``.

    ``value`` is summed for the starts (rows are counted by default) and should be cheap, as it is
    computed twice. With ``align`` above one, every range starts at a row number that is a multiple of
    it, so that a run of ``align`` rows never crosses two ranges. ``spread`` makes at least as many
    ranges as there are cores when there are rows enough. ``n_rows`` saves the count where it is known.
    The key must be unique: equal keys always share a range.
    """
    order_by = _as_list(order_by)
    key_type = df.select(_key(df, order_by).alias("k")).schema["k"].dataType
    amount = F.lit(1) if value is None else value
    narrow = df.select(*order_by, amount.cast("bigint").alias("__amount"))
    total, quantiles = n_rows, []
    sketched = isinstance(key_type, T.IntegralType) and (n_rows is None or n_rows > MIN_ROWS_PER_RANGE)
    if n_rows is None or value is not None or sketched:
        sums = [F.count("*").alias("n"), F.coalesce(F.sum("__amount"), F.lit(0)).alias("total")]
        if sketched:
            shares = F.lit([i / SKETCH_CUTS for i in range(1, SKETCH_CUTS)])
            sums.append(F.percentile_approx(_key(df, order_by).cast("bigint"), shares, SKETCH_CUTS * SKETCH_STEPS).alias("q"))
        counted = narrow.agg(*sums).first()
        n_rows, quantiles = counted.n, (counted.q or []) if sketched else []
        total = counted.total if value is not None else n_rows
    if rows_per_range is None:
        most = ROWS_PER_RANGE
        if n_rows > MIN_ROWS_PER_RANGE:
            most = max(1, min(most, int(BYTES_PER_RANGE / max(1.0, _row_bytes(df)))))
        n_ranges = math.ceil(n_rows / most)
        if spread:
            cores = df.sparkSession.sparkContext.defaultParallelism
            n_ranges = max(n_ranges, min(cores, n_rows // MIN_ROWS_PER_RANGE))
    else:
        n_ranges = math.ceil(n_rows / rows_per_range)
    n_ranges = min(MAX_RANGES, n_ranges)
    whole = KeyRanges(order_by, key_type, [], [0], total, n_rows, [n_rows])
    if n_ranges <= 1:
        return whole
    if quantiles and n_ranges <= SKETCH_CUTS:
        chosen = [quantiles[round(i * SKETCH_CUTS / n_ranges) - 1] for i in range(1, n_ranges)]
        cuts = _short([json.dumps({"k": k}) for k in chosen], order_by)
    else:
        cuts = _sample_cuts(narrow.select(*order_by), order_by, n_ranges, n_rows)
    ranges = _started(narrow, replace(whole, cuts=cuts, starts=[0] * (len(cuts) + 1)))
    return _align(narrow, ranges, align) if align > 1 else ranges


def _started(narrow: DataFrame, ranges: KeyRanges) -> KeyRanges:
    """With the rows and the running total of each range, from the rows as they are assigned."""
    sums = {
        row[RANGE]: (row.n, row.s)
        for row in ranges.assign(narrow.withColumnRenamed("__amount", "amount"))
        .groupBy(RANGE)
        .agg(F.count("*").alias("n"), F.sum("amount").alias("s"))
        .collect()
    }
    starts, rows, running = [], [], 0
    for i in range(len(ranges.cuts) + 1):
        n, s = sums.get(i, (0, 0))
        starts.append(running)
        rows.append(n)
        running += s or 0
    return replace(ranges, starts=starts, rows=rows)


def written(df: DataFrame, label: str = "keys", path: str | None = None) -> DataFrame:
    """Write rows to the shared folder, well compressed, and read them from there."""
    spark = df.sparkSession
    path = path or scratch_dir(spark, label)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def _cut_json(df: DataFrame, order_by: Sequence[str]) -> Column:
    return F.to_json(F.struct(_key(df, order_by).alias("k"))).alias("cut")


def _short(cuts: list[str], order_by: list[str]) -> list[str]:
    """Sorted cuts without the equal ones, which a key shared by many rows gives."""
    if sum(map(len, cuts)) > MAX_CUT_CHARS:
        raise ValueError(f"the sort key {order_by} is too long; order by a number or a digest")
    return list(dict.fromkeys(cuts))


def _sample_cuts(keys: DataFrame, order_by: list[str], n_ranges: int, n_rows: int) -> list[str]:
    wanted = SAMPLE_PER_RANGE * n_ranges
    # A null cannot be compared with, so it is no cut; null keys sort into the first range.
    sample = keys.sample(min(1.0, wanted / n_rows), seed=7).filter(_key(keys, order_by).isNotNull())
    # One task sorts this sample, which grows with the number of ranges and not with that of rows.
    window = Window.orderBy(*order_by)
    place = (F.row_number().over(window) - 1).cast("bigint") * n_ranges
    every = F.count("*").over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # The first sampled key of each of n_ranges equal parts, but for the first part.
    part = F.call_function("div", place, every)
    rows = (
        sample.withColumn("__part", part)
        .withColumn("__before", F.lag("__part").over(window))
        .filter(F.col("__part") > F.coalesce("__before", F.lit(0)))
        .orderBy("__part")
        .select(_cut_json(keys, order_by))
        .collect()
    )
    return _short([row.cut for row in rows], order_by)


def _align(narrow: DataFrame, ranges: KeyRanges, size: int) -> KeyRanges:
    """Move each cut up to the first key whose row number is a multiple of ``size``."""
    skip = [-start % size for start in ranges.starts]
    keys = narrow.drop("__amount")
    window = Window.partitionBy(RANGE).orderBy(*ranges.order_by)
    # The bound on the row number lets Spark keep only the first rows of each range map-side.
    firsts = (
        ranges.assign(keys)
        .withColumn("__i", F.row_number().over(window))
        .filter(F.col("__i") <= size)
        .filter((F.col("__i") - 1 == ranges.value(skip)) & (F.col(RANGE) > 0))
        .select(RANGE, _cut_json(keys, ranges.order_by))
        .collect()
    )
    cuts, starts = [], [0]
    for row in sorted(firsts, key=lambda r: r[RANGE]):
        cuts.append(row.cut)
        starts.append(ranges.starts[row[RANGE]] + skip[row[RANGE]])
    rows = [b - a for a, b in zip(starts, [*starts[1:], ranges.n_rows])]
    return replace(ranges, cuts=cuts, starts=starts, rows=rows)


def _window(ranges: KeyRanges):
    return Window.partitionBy(RANGE).orderBy(*ranges.order_by)


def _by_range(df: DataFrame, ranges: KeyRanges) -> DataFrame:
    """Rows with their range, one shuffle partition per range.

    The number of ranges follows the number of rows, so partitions keep their size as data grows.
    The range is the partition number itself: hashed, some partitions would get several ranges.
    """
    df = ranges.assign(df)
    return df.repartitionById(len(ranges.starts), F.col(RANGE)) if ranges.cuts else df


def _checked(df: DataFrame, ranges: KeyRanges, result: Column) -> Column:
    """The result, or an error for a repeated key or a range with more rows than were counted."""
    window = _window(ranges)
    key = _key(df, ranges.order_by)
    place = F.row_number().over(window)
    repeated = (place > 1) & F.lag(key).over(window).eqNullSafe(key)
    return (
        F.when(repeated, F.raise_error(F.lit(f"the sort key {ranges.order_by} is not unique")).cast("bigint"))
        .when(
            place > ranges.value(ranges.rows),
            F.raise_error(F.lit("the input has changed since its rows were counted")).cast("bigint"),
        )
        .otherwise(result)
    )


def number_rows(df: DataFrame, ranges: KeyRanges, name: str) -> DataFrame:
    """Add the 0-based row number; the range column stays for operators that group by it."""
    number = (F.row_number().over(_window(ranges)) - 1).cast("bigint") + ranges.start()
    return _by_range(df, ranges).withColumn(name, _checked(df, ranges, number))


def dense_index(
    df: DataFrame,
    order_by: str | Sequence[str],
    name: str = "rn",
    rows_per_range: int | None = None,
) -> DataFrame:
    """Add consecutive row numbers from 0 in the order of a unique key."""
    return indexed(df, order_by, name, rows_per_range)[0]


def indexed(
    df: DataFrame,
    order_by: str | Sequence[str],
    name: str = "rn",
    rows_per_range: int | None = None,
    spread: bool = True,
    n_rows: int | None = None,
) -> tuple[DataFrame, int]:
    """``dense_index`` and the row count, which it knows anyway."""
    ranges = plan_ranges(df, order_by, rows_per_range=rows_per_range, spread=spread, n_rows=n_rows)
    return number_rows(df, ranges, name).drop(RANGE), ranges.n_rows


def running_total(df: DataFrame, ranges: KeyRanges, value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows; the range column stays."""
    before = _window(ranges).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum(value.cast("bigint")).over(before), F.lit(0).cast("bigint")) + ranges.start()
    return _by_range(df, ranges).withColumn(name, _checked(df, ranges, total))


def prefix_sum(
    df: DataFrame,
    order_by: str | Sequence[str],
    value: Column,
    name: str = "start",
    rows_per_range: int | None = None,
) -> DataFrame:
    """Add the exclusive running sum of ``value`` in the order of a unique key."""
    ranges = plan_ranges(df, order_by, value=value, rows_per_range=rows_per_range)
    return running_total(df, ranges, value, name).drop(RANGE)


def nth_keys(
    df: DataFrame,
    order_by: str | Sequence[str],
    positions: Callable[[int], Sequence[int]],
    rows_per_range: int | None = None,
    n_rows: int | None = None,
) -> tuple[int, dict[int, tuple]]:
    """Row count, and the keys at the given 1-based positions of the key order.

    ``positions`` gets the row count. Positions outside 1..count are left out; the key after a
    position may come along. Only the key columns are read, and only the one range that holds a
    position is sorted. Points in time are given in microseconds, as ``up_to`` takes them. A position
    whose key is also that of the next row raises, as no filter could tell them apart.
    """
    order_by = _as_list(order_by)
    keys = df.select(*order_by)
    ranges = plan_ranges(keys, order_by, rows_per_range=rows_per_range, spread=False, n_rows=n_rows)
    found: dict[int, tuple] = {}
    for position in positions(ranges.n_rows):
        if 1 <= position <= ranges.n_rows and position not in found:
            rows = _from_position(keys, ranges, position)
            if len(rows) > 1 and rows[0] == rows[1]:
                raise ValueError(f"the sort key {order_by} is not unique")
            found.update((position + i, row) for i, row in enumerate(rows))
    return ranges.n_rows, found


def _from_position(keys: DataFrame, ranges: KeyRanges, position: int) -> list[tuple]:
    """The key at the position, and the next one if it lies in the same range."""
    here = max(i for i, start in enumerate(ranges.starts) if start < position)
    local = position - ranges.starts[here]
    if ranges.cuts:
        keys = keys.filter(ranges.inside(keys, here))
    times = [
        F.unix_micros(name).alias(name) if isinstance(keys.schema[name].dataType, T.TimestampType) else F.col(name)
        for name in ranges.order_by
    ]
    rows = keys.orderBy(*ranges.order_by).offset(local - 1).limit(2).select(*times).collect()
    return [tuple(row) for row in rows]


def _bound(df: DataFrame, name: str, value) -> Column:
    """A key value as a literal of the column's type, whatever the session's time zone."""
    kind = df.schema[name].dataType
    if value is not None and isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(value))
    if isinstance(kind, T.TimestampNTZType):
        value = None if value is None else str(value)
    return F.lit(value).cast(kind)


def up_to(df: DataFrame, order_by: str | Sequence[str], key: tuple) -> Column:
    """Condition: the row's key sorts at or before ``key`` (nulls first, as in ``orderBy``).

    Of several columns, the first one's bound stands alone as well, so that it reaches the scan.
    """
    order_by = _as_list(order_by)
    if len(order_by) == 1 and key[0] is None:
        return F.col(order_by[0]).isNull()
    bounds = [_bound(df, name, value) for name, value in zip(order_by, key)]
    first, nullable = F.col(order_by[0]), df.schema[order_by[0]].nullable
    at_most = first <= bounds[0]
    at_most = at_most | first.isNull() if nullable else at_most
    if len(order_by) == 1:
        return at_most
    condition = None
    for i in reversed(range(len(order_by))):
        column, bound = F.col(order_by[i]), bounds[i]
        below, same = _compare(column, bound, key[i] is None, df.schema[order_by[i]].nullable)
        if condition is None:
            condition = below if same is None else below | same
        else:
            condition = below | (same & condition)
    return condition if key[0] is None else at_most & condition


def after(df: DataFrame, order_by: str | Sequence[str], key: tuple) -> Column:
    """Condition: the row's key sorts after ``key``. The first column's bound reaches the scan."""
    order_by = _as_list(order_by)
    beyond = ~up_to(df, order_by, key)
    if key[0] is None or len(order_by) == 1:
        return beyond
    return (F.col(order_by[0]) >= _bound(df, order_by[0], key[0])) & beyond


def _compare(column: Column, bound: Column, null_bound: bool, nullable: bool) -> tuple[Column, Column]:
    """(sorts before, sorts with). Where the second is null, the first is true."""
    if null_bound:
        return F.lit(False), column.isNull()
    return (column.isNull() | (column < bound)) if nullable else column < bound, column == bound
