"""Row numbers, running totals and positions do not depend on partitions or cuts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pairloom.operators import order, requests, select


def shuffled(spark, n, partitions):
    return spark.range(n).select((F.col("id") * 7919 % 1_000_003).alias("k")).repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 4, 17])
@pytest.mark.parametrize("rows_per_range", [3, 40, None])
def test_dense_index(spark, partitions, rows_per_range):
    df = shuffled(spark, 500, partitions)
    rows = order.dense_index(df, "k", rows_per_range=rows_per_range).orderBy("k").collect()
    assert [r.rn for r in rows] == list(range(500))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_dense_index_of_few_rows(spark, n):
    rows = order.dense_index(shuffled(spark, n, 3), "k", rows_per_range=1).collect()
    assert sorted(r.rn for r in rows) == list(range(n))


def test_text_and_several_keys_with_nulls(spark):
    data = [(None if i % 10 == 0 else f"k{i % 7}\"\n", i) for i in range(200)]
    df = spark.createDataFrame(data, "a string, b bigint").repartition(5)
    got = order.dense_index(df, ["a", "b"], rows_per_range=11).collect()
    want = sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.rn)] == want


def test_one_null_key_comes_first(spark):
    df = spark.createDataFrame([(None,), *[(i,) for i in range(1, 90)]], "k bigint").repartition(4)
    for rows_per_range in (1, 2, 20):
        rows = order.dense_index(df, "k", rows_per_range=rows_per_range).collect()
        assert {r.k: r.rn for r in rows} == {None: 0, **{i: i for i in range(1, 90)}}
        for start, stop in ((0, 1), (0, 5), (1, 4)):
            got = {r.k for r in select.row_range(df, start, stop, "k", rows_per_range).collect()}
            assert got == {i or None for i in range(start, stop)}


def test_time_and_float_keys(spark):
    start = dt.datetime(2024, 1, 1)
    data = [(start + dt.timedelta(microseconds=i), i / 3) for i in range(120)]
    df = spark.createDataFrame(data, "t timestamp, x double").repartition(3)
    for key in ("t", "x"):
        rows = order.dense_index(df, key, rows_per_range=7).orderBy(key).collect()
        assert [r.rn for r in rows] == list(range(120))


def test_many_ranges(spark):
    df = shuffled(spark, 1000, 4)
    ranges = order.plan_ranges(df, "k", rows_per_range=2)
    assert len(ranges.cuts) > 64
    rows = order.number_rows(df, ranges, "rn").orderBy("k").collect()
    assert [r.rn for r in rows] == list(range(1000))


def test_aligned_ranges_start_at_multiples(spark):
    ranges = order.plan_ranges(shuffled(spark, 400, 4), "k", align=10, rows_per_range=13)
    assert ranges.cuts and all(start % 10 == 0 for start in ranges.starts)


def test_prefix_sum(spark):
    df = shuffled(spark, 300, 6).withColumn("v", F.col("k") % 5)
    rows = order.prefix_sum(df, "k", F.col("v"), rows_per_range=17).orderBy("k").collect()
    total = 0
    for row in rows:
        assert row.start == total
        total += row.v


def test_hot_sort_prefix_is_still_cut(spark):
    """A first key column with one value for most rows does not make one large range."""
    df = spark.range(900).select(F.when(F.col("id") < 800, 1).otherwise(F.col("id")).alias("a"), "id")
    ranges = order.plan_ranges(df, ["a", "id"], rows_per_range=30)
    assert max(ranges.sizes()) < 200 and sum(ranges.rows) == 900


@pytest.mark.parametrize("rows_per_range", [30, None])
@pytest.mark.parametrize("copies", [2, 300])
def test_repeated_key_is_refused_at_any_size(spark, rows_per_range, copies):
    df = spark.range(900).select(F.when(F.col("id") < copies, 1).otherwise(F.col("id")).alias("k"))
    with pytest.raises(Exception, match="not unique"):
        order.dense_index(df, "k", rows_per_range=rows_per_range).collect()
    with pytest.raises(Exception, match="not unique"):
        order.prefix_sum(df, "k", F.lit(1), rows_per_range=rows_per_range).collect()
    with pytest.raises(Exception, match="not unique"):
        requests.batch_rows(df.withColumn("t", F.lit("x")), "t", 10, "k", rows_per_range=rows_per_range).collect()
    with pytest.raises(ValueError, match="not unique"):
        select.head_rows(df, 1, "k", rows_per_range)


def test_repeated_null_key_is_refused(spark):
    df = spark.createDataFrame([(None,), (None,), (1,)], "k long")
    with pytest.raises(Exception, match="not unique"):
        order.dense_index(df, "k").collect()


def test_input_that_grows_is_refused(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    numbered = order.dense_index(spark.read.parquet(str(tmp_path / "t")), "id", rows_per_range=10)
    spark.range(100, 120).write.mode("append").parquet(str(tmp_path / "t"))
    assert numbered.count() == 100  # files are listed once
    ranges = order.plan_ranges(spark.range(100).toDF("k"), "k", rows_per_range=10)
    with pytest.raises(Exception, match="changed"):
        order.number_rows(spark.range(150).toDF("k"), ranges, "rn").collect()


@pytest.mark.parametrize("rows_per_range", [400, None])
@pytest.mark.parametrize(
    "expression",
    [
        "timestamp_micros(1730600000000000 + id * 2000000)",
        "timestamp_ntz '2024-11-03 00:00:00' + make_dt_interval(0, 0, 0, id * 2.000001)",
        "date_from_unix_date(id - 30000)",
        "cast(id as decimal(38,10)) / 7",
        "unhex(lpad(hex(id), 8, '0'))",
        "cast(id as double) / 3",
        "cast(id - 3000 as int)",
    ],
)
def test_cuts_lose_nothing(spark, expression, rows_per_range):
    """Points in time over the autumn clock change of the session's zone, and other key types."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.range(8000).selectExpr("id", f"{expression} AS k").repartition(5)
        rows = order.dense_index(df, "k", rows_per_range=rows_per_range).collect()
        assert all(r.rn == r.id for r in rows)
        batches = requests.batch_rows(df.withColumn("t", F.lit("x")), "t", 10, "k", rows_per_range=rows_per_range)
        assert sorted(r.batch_id for r in batches.select("batch_id").collect()) == list(range(800))
        ids = sorted(r.id for r in select.row_range(df, 3000, 3500, "k", rows_per_range).collect())
        assert ids == list(range(3000, 3500))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_own_names_are_refused(spark):
    with pytest.raises(ValueError, match="rename"):
        order.dense_index(spark.range(5).withColumn(order.RANGE, F.lit(1)), "id")


def test_ranges_follow_bytes(spark, monkeypatch):
    monkeypatch.setattr(order, "BYTES_PER_RANGE", 100_000)
    df = spark.range(4000).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert 35 <= len(order.plan_ranges(df, "id").starts) <= 50
    assert len(order.plan_ranges(df.select("id"), "id", spread=False).starts) == 1


def test_long_sort_keys_are_refused(spark, monkeypatch):
    monkeypatch.setattr(order, "MAX_CUT_CHARS", 1000)
    df = spark.range(400).select(F.concat(F.repeat(F.lit("x"), 100), F.col("id")).alias("k"))
    with pytest.raises(ValueError, match="too long"):
        order.dense_index(df, "k", rows_per_range=10)


def test_composite_keys_reach_the_scan(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 40).alias("a"), F.col("id").alias("b"))
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    keys = sorted((r.a, r.b) for r in df.collect())
    for frame, want, filters in (
        (select.row_range(df, 300, 420, ["a", "b"]), keys[300:420], ("LessThanOrEqual(a", ">= 11)")),
        (select.full_batches(df, 70, ["a", "b"]), keys[:980], ("LessThanOrEqual(a",)),
    ):
        assert sorted((r.a, r.b) for r in frame.collect()) == want
        plan = frame._jdf.queryExecution().executedPlan().toString()
        # The list in the plan is cut short; its first part is the bound from above.
        assert filters[0] in plan.split("PushedFilters")[1] and all(f in plan for f in filters)


def test_composite_positions_with_nulls(spark):
    data = [(a, b) for a in (None, 1, 2) for b in (None, "x", "y", "z")]
    df = spark.createDataFrame(data, "a int, b string").repartition(3)
    for start, stop in ((0, 1), (0, 6), (2, 9), (4, 12), (11, 12)):
        got = {(r.a, r.b) for r in select.row_range(df, start, stop, ["a", "b"]).collect()}
        assert got == set(data[start:stop]), (start, stop)


@pytest.mark.parametrize("rows_per_range", [5, 60, None])
def test_positions(spark, rows_per_range):
    df = shuffled(spark, 300, 5)
    keys = sorted(r.k for r in df.collect())

    def values(frame):
        return sorted(r.k for r in frame.collect())

    assert values(select.head_rows(df, 17, "k", rows_per_range)) == keys[:17]
    assert values(select.head_rows(df, 0, "k", rows_per_range)) == []
    assert values(select.head_rows(df, 999, "k", rows_per_range)) == keys
    assert values(select.row_range(df, 10, 25, "k", rows_per_range)) == keys[10:25]
    assert values(select.row_range(df, 290, 999, "k", rows_per_range)) == keys[290:]
    assert values(select.row_range(df, 300, 310, "k", rows_per_range)) == []
    assert values(select.full_batches(df, 70, "k", rows_per_range)) == keys[:280]
    assert values(select.full_batches(df, 100, "k", rows_per_range)) == keys
    assert values(select.full_batches(df, 301, "k", rows_per_range)) == []


def test_head_reaches_the_scan(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    df = select.head_rows(spark.read.parquet(str(tmp_path / "t")), 10, "id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(id,9)" in plan and "Exchange" not in plan
