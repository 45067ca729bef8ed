"""How much work a plan takes before it runs, and settings that must not matter."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from pairloom.functions.tokens import python_tokenizer, word_tokenizer
from pairloom.operators import features, responses
from tablequeries import queries
from tests.conftest import DATA

LENGTHS = word_tokenizer(F.length, bos_id=2, eos_id=1, pad_id=0)


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield request.param
    spark.conf.unset("spark.sql.ansi.enabled")


def jobs(spark, make) -> int:
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counting jobs")
    try:
        make()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", ["mix_corpora", "causal_datasets", "shuffle_head", "align_lines", "missing_tasks"])
def test_planning_jobs(spark, name):
    assert jobs(spark, lambda: queries.QUERIES[name](spark, DATA)) <= 10


def texts(spark, n=200):
    text = F.when(F.col("id") % 5 != 0, F.concat(F.lit("one two "), F.col("id")))
    return spark.range(n).select("id", text.alias("text")).repartition(3)


def test_null_texts_lose_no_block(spark, ansi):
    ids = features.tokenize(texts(spark), "text", LENGTHS)
    assert features.pack_sequences(ids, 12, "id").count() == 40
    kept = features.pack_sequences(ids, 14, "id", drop_tail=False).collect()
    assert sum(len(r.input_ids) for r in kept) == 480 and len(kept) == 35


def test_features_of_null_texts(spark, ansi):
    ids = features.tokenize(texts(spark, 20), "text", LENGTHS)
    rows = {r.id: r for r in features.pad_truncate(ids, 5, 0).collect()}
    assert rows[0].input_ids is None and rows[0].attention_mask is None
    assert rows[1].input_ids == [3, 3, 1, 0, 0] and rows[1].attention_mask == [1, 1, 1, 0, 0]
    padded = features.pad_to_batch_max(ids, 4, "id", 0, labels=None).collect()
    assert all((r.input_ids is None) == (r.id % 5 == 0) for r in padded)
    masked = features.mask_prompt(ids.withColumn("p", F.array(F.lit(1))), "p").collect()
    assert all((r.labels is None) == (r.id % 5 == 0) for r in masked)
    df = spark.createDataFrame([(1, None, ["x"]), (2, ["a"], ["x", "y"])], "task_idx long, sentences_en array<string>, sentences_ko array<string>")
    assert [(r.en, r.ko) for r in responses.explode_pairs(df).collect()] == [("a", "x")]


def test_packing_tokenises_each_text_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def load():
        def encode(text):
            calls.add(1)
            return [len(word) for word in text.split()]

        return encode

    ids = features.tokenize(texts(spark), "text", python_tokenizer(load, bos_id=2, eos_id=1, pad_id=0))
    assert features.pack_sequences(ids, 12, "id").count() == 40
    assert calls.value == 160


def test_end_id_stays_on_truncation(spark):
    df = spark.createDataFrame([([2, 5, 6, 7, 1],), ([2, 5, 1],), ([],), (None,)], "input_ids array<int>")
    got = [r.input_ids for r in features.pad_truncate(df, 4, 0, keep_end=1).collect()]
    assert got == [[2, 5, 6, 1], [2, 5, 1, 0], [0, 0, 0, 0], None]
    got = [r.input_ids for r in features.pad_truncate(df, 4, 0).collect()]
    assert got == [[2, 5, 6, 7], [2, 5, 1, 0], [0, 0, 0, 0], None]


def test_pairs_are_computed_once_for_a_published_split(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    def count(text):
        calls.add(1)
        return text

    pairs = spark.range(40).select(F.udf(count)(F.concat(F.lit("a"), "id")).alias("en"), F.col("id").cast("string").alias("ko"))
    monkeypatch.setattr(queries.inputs, "pairs", lambda *_: pairs)
    found = queries.split_published(spark, "").collect()
    assert len(found) == 40 and sum(r.split == "test" for r in found) == 4 and calls.value == 40
