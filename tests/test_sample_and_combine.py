"""Samples, splits, unions and duplicates."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from pairloom import session
from pairloom.operators import combine, sample, select
from pairloom.operators.combine import Source
from pairloom.plans import corpus


def test_scratch_folders_are_removed(spark):
    session.clear_scratch(spark)
    df = spark.createDataFrame([(f"k{i}",) for i in range(20)], "k string")
    assert sample.sample_n(df, 5, 1, "k").count() == 5
    assert session.clear_scratch(spark) == 0  # a sample leaves nothing
    path = session.scratch_dir(spark, "test")
    df.write.parquet(path)
    assert os.path.isdir(path) and session.clear_scratch(spark) == 1 and not os.path.isdir(path)


def keyed(spark, n, partitions=4):
    return spark.range(n).select(F.col("id").alias("k"), F.col("id").cast("string").alias("t")).repartition(partitions)


def ranked(n, seed):
    return sorted(range(n), key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))


@pytest.mark.parametrize("partitions", [1, 4, 17])
@pytest.mark.parametrize("rows_per_range", [7, None])
def test_sample_is_the_same_for_any_partitioning(spark, partitions, rows_per_range):
    got = sample.sample_n(keyed(spark, 200, partitions), 60, 42, "k", rows_per_range=rows_per_range)
    assert sorted(r.k for r in got.collect()) == sorted(ranked(200, 42)[:60])


def test_sample_sizes(spark):
    df = keyed(spark, 20)
    assert sample.sample_n(df, 0, 1, "k").count() == 0
    assert sample.sample_n(df, 20, 1, "k").count() == 20
    assert sample.sample_n(df, 21, 1, "k", on_short="all").count() == 20
    with pytest.raises(ValueError, match="larger than the population"):
        sample.sample_n(df, 21, 1, "k")


def test_sample_needs_no_shuffle_of_the_rows(spark):
    df = sample.sample_n(spark.range(100).withColumnRenamed("id", "k"), 10, 3, "k")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_shuffle_head(spark):
    rows = sample.shuffle_head(keyed(spark, 90), 40, 5, "k", rows_per_range=9).orderBy("shuffle_rank").collect()
    assert [r.k for r in rows] == ranked(90, 5)[:40]
    assert [r.shuffle_rank for r in rows] == list(range(40))
    assert sample.shuffle_head(keyed(spark, 10), 40, 5, "k").count() == 10


def test_splits_are_disjoint_and_whole(spark):
    df = keyed(spark, 101)
    train, test = sample.split_fraction(df, 0.1, 42, "k")
    a, b = {r.k for r in train.collect()}, {r.k for r in test.collect()}
    assert len(b) == 11 and not a & b and a | b == set(range(101))
    assert train.columns == test.columns == df.columns
    train, validation = sample.split_count(df, 30, 42, "k")
    assert (train.count(), validation.count()) == (71, 30)
    assert sample.split_count(df, 0, 42, "k")[1] is None
    train, test = sample.split_fraction(df, 1.0, 42, "k")
    assert (train.count(), test.count()) == (0, 101)
    with pytest.raises(ValueError):
        sample.split_count(df, 102, 42, "k")


def test_cap_before_split(spark):
    capped = select.max_examples(keyed(spark, 50), 20, "k")
    train, validation = sample.split_count(capped, 5, 42, "k")
    assert {r.k for r in train.union(validation).collect()} == set(range(20))
    assert select.max_examples(keyed(spark, 50), None, "k").count() == 50


def test_min_length_counts_code_points_and_drops_null(spark):
    df = spark.createDataFrame([("한국어",), ("ab",), ("😀😀😀",), (None,)], "t string")
    assert sorted(r.t for r in select.min_length(df, "t", 3).collect()) == sorted(["한국어", "😀😀😀"])


def test_dedup_keeps_first_and_treats_nulls_as_equal(spark):
    data = [("a", "1", 3), ("a", "2", 1), ("a", "1", 2), (None, "1", 9), (None, "1", 4), ("b", None, 5), ("b", "", 6)]
    df = spark.createDataFrame(data, "en string, ko string, at bigint").repartition(3)
    once = combine.dedup_pairs(df, ["en", "ko"], "at")
    want = {("a", "1", 2), ("a", "2", 1), (None, "1", 4), ("b", None, 5), ("b", "", 6)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in combine.dedup_pairs(once, ["en", "ko"], "at").collect()} == want


def test_dedup_folds_hot_copies_before_the_shuffle(spark):
    df = spark.range(100).select(F.lit("x").alias("en"), F.lit("y").alias("ko"), F.col("id").alias("at"))
    plan = combine.dedup_pairs(df, ["en", "ko"], "at")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "SortAggregate" not in plan


def test_concat_numbers_on(spark):
    a, b = keyed(spark, 5), keyed(spark, 3)
    rows = combine.concat_corpora([(a, "t", "k"), (b, "t", "k")]).orderBy("rn").collect()
    assert [(r.rn, r.source_ord, r.pos, r.english) for r in rows] == [
        *[(i, 0, i, str(i)) for i in range(5)],
        *[(5 + i, 1, i, str(i)) for i in range(3)],
    ]


def test_mix_caps_each_source(spark):
    rows = combine.mix_corpora(
        [
            Source(keyed(spark, 9), "t", "k", "head", 4),
            Source(keyed(spark, 3), "t", "k", "head", 10),
            Source(keyed(spark, 6), "t", "k"),
            Source(keyed(spark, 20), "t", "k", "shuffle", 7),
        ],
        seed=1,
    ).orderBy("rn").collect()
    assert [r.rn for r in rows] == list(range(20))
    assert [r.text for r in rows if r.source_ord == 0] == ["0", "1", "2", "3"]
    assert [r.text for r in rows if r.source_ord == 3] == [str(k) for k in ranked(20, 1)[:7]]
    with pytest.raises(ValueError):
        combine.mix_corpora([Source(keyed(spark, 2), "t", "k", "head")], seed=1)


def test_combined_english(spark):
    subtitles = spark.range(60).select(F.col("id").alias("line_no"), F.repeat(F.lit("s"), (F.col("id") + 80).cast("int")).alias("line"))
    talks = spark.range(60).select(F.col("id").alias("line_no"), F.repeat(F.lit("t"), F.col("id").cast("int")).alias("en"))
    rows = corpus.combined_english(subtitles, talks, n=15).orderBy("rn").collect()
    assert [r.rn for r in rows] == list(range(30))
    assert all(len(r.english) >= 100 for r in rows[:15]) and all(len(r.english) >= 30 for r in rows[15:])
    assert all(r.english[0] == "t" for r in rows[15:])


def test_profile(spark):
    df = spark.createDataFrame([("abc",), (None,), ("",)], "t string")
    row = select.profile({"c": (df, "t")}).first()
    assert tuple(row) == ("c", 3, "t", 1, 0, 3)


def test_key_that_is_not_unique_is_refused(spark):
    df = spark.range(20).select(F.lit(1).alias("k"))
    with pytest.raises(ValueError, match="not unique"):
        sample.sample_n(df, 5, 42, "k")


def test_text_keys_do_not_run_together(spark):
    data = [("a:b", "c"), ("a", "b:c"), (None, "a"), ("a", None), ("", "a"), ("a", "")]
    df = spark.createDataFrame(data, "x string, y string")
    ranks = df.select(sample.rank_key(1, ["x", "y"], dict(df.dtypes))).distinct().count()
    assert ranks == len(data)
    for n in range(len(data) + 1):
        train, test = sample.split_count(df, n, 1, ["x", "y"])
        assert train.count() == len(data) - n
