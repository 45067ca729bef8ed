"""Batch inference, quality and the response stream."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException

from pairloom import schemas
from pairloom.operators import generate, quality, responses
from pairloom.plans import evaluation
from pairloom.session import scratch_dir
from pairloom.streaming import responses as stream


def echo(params):
    loads = {"n": 0}
    loads["n"] += 1
    return lambda texts: [f"{params.get('model')}|{params['max_new_tokens']}|{len(texts)}|{t}" for t in texts]


def test_generator_runs_in_batches_once_per_task(spark):
    df = spark.range(10).selectExpr("concat('t', id) as t").coalesce(1)
    rows = generate.batch_generate(df, "t", echo, {"max_new_tokens": 7}, batch_size=4).collect()
    assert [r.input for r in rows] == [f"t{i}" for i in range(10)]
    assert [r.result.split("|")[2] for r in rows] == ["4"] * 8 + ["2"] * 2
    assert all(r.result.startswith("None|7|") for r in rows)


def test_generator_must_answer_each_text(spark):
    df = spark.range(3).selectExpr("cast(id as string) t")
    with pytest.raises(PySparkException, match="one result per text"):
        generate.batch_generate(df, "t", lambda p: lambda texts: []).collect()


def test_settings():
    assert generate.settings_from_env({})["max_new_tokens"] == 4096
    got = generate.settings_from_env({"TEMPERATURE": "0.2", "MAX_SEQ_LENGTH": "10"})
    assert got["temperature"] == 0.2 and got["max_seq_length"] == 10 and got["device_map"] == "auto"


def test_each_model_gets_its_template_and_no_shuffle(spark):
    df = spark.createDataFrame([("a",), ("b",)], "input_text string")
    models = [{"model": "Llama-3.2-1B"}, {"model": "Qwen2.5-3B"}, {"model": "deepseek-r1"}]
    out = evaluation.evaluate_models(df, models, lambda p: lambda texts: [t[:12] for t in texts])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = {(r.model, r.input): r.result for r in out.collect()}
    assert len(rows) == 6
    assert rows["Llama-3.2-1B", "a"] == rows["deepseek-r1", "b"] == "<|begin_of_t"
    assert rows["Qwen2.5-3B", "b"] == "<|im_start|>"


def test_map_batches(spark):
    df = spark.range(5)
    rows = generate.map_batches(df, lambda b: b.assign(d=b["id"] * 2), "id bigint, d bigint").collect()
    assert {tuple(r) for r in rows} == {(i, 2 * i) for i in range(5)}


def test_pair_quality(spark):
    df = spark.createDataFrame([("ab", "한국"), ("a", ""), ("x", "x"), (None, "한"), ("abcd", "한a")], schemas.PAIR)
    rows = quality.pair_quality(df).collect()
    assert [r.score for r in rows] == [1.0, 0.0, 0.0, 0.0, 0.5]
    assert rows[1].is_empty and rows[2].is_copy and rows[3].is_empty
    assert rows[4].len_ratio == 0.5 and rows[4].target_script_share == 0.5


def answer(task, pairs):
    content = {"sentences_en": [p[0] for p in pairs], "sentences_ko": [p[1] for p in pairs]}
    body = {"choices": [{"message": {"content": json.dumps(content)}}]}
    return json.dumps({"custom_id": f"task-{task}", "response": {"body": body}})


def test_models_share_one_reading_of_the_input(spark):
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch

    df = spark.range(5).selectExpr("cast(id as string) t").mapInPandas(count, "t string")
    models = [{"model": "a"}, {"model": "b"}, {"model": "c"}]
    assert generate.fan_out_models(df, models, "t", lambda p: lambda texts: texts).count() == 15
    assert calls.value == 5


def drop(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n")


@pytest.mark.parametrize("broadcast", [True, False])
def test_stream_equals_batch(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(stream, "BROADCAST_DIGESTS", 0)
    base = scratch_dir(spark, "test")
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        stream.ingest_responses_stream(
            spark, str(folder), base + "/out", base + "/checkpoint", files_per_trigger=1
        ).awaitTermination()

    drop(folder, "1.jsonl", [answer(0, [("a", "1"), ("b", "2"), ("a", "1")]), "{broken"])
    drop(folder, "2.jsonl", [answer(1, [("a", "1"), ("c", None)])])
    run()
    drop(folder, "3.jsonl", [answer(2, [("c", None), ("c", ""), ("b", "2"), ("d", "4")])])
    run()
    run()
    got = [tuple(r) for r in stream.read_pairs(spark, base + "/out").collect()]
    assert len(got) == len(set(got)) == 5
    lines = spark.read.text(str(folder))
    assert set(got) == {tuple(r) for r in responses.build_pairs(lines).collect()}
    assert [tuple(r) for r in stream.read_quarantine(spark, base + "/out").collect()] == [("{broken", "bad_json")]


def test_new_checkpoint_keeps_earlier_pairs(spark, tmp_path):
    base = scratch_dir(spark, "test")
    folder = tmp_path / "in"
    folder.mkdir()

    def run(checkpoint):
        stream.ingest_responses_stream(spark, str(folder), base + "/out", base + checkpoint).awaitTermination()

    drop(folder, "1.jsonl", [answer(0, [("a", "1"), ("b", "2")])])
    run("/one")
    drop(folder, "2.jsonl", [answer(1, [("b", "2"), ("c", "3")]), "{broken"])
    run("/two")
    pairs = [tuple(r) for r in stream.read_pairs(spark, base + "/out").collect()]
    assert sorted(pairs) == [("a", "1"), ("b", "2"), ("c", "3")]
    run("/one")
    assert stream.read_pairs(spark, base + "/out").count() == 3
