"""Templates, tokens, masks, packing and padding."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairloom import constants
from pairloom.functions import chat, tokens
from pairloom.operators import chats, features
from pairloom.plans import training

LENGTHS = tokens.word_tokenizer(F.length, bos_id=100, eos_id=101, pad_id=0)


def test_template_choice(spark):
    names = ["Org/Llama-3.2-1B", "LLAMA-3.1", "QWEN2.5-7B", "deepseek-r1"]
    df = spark.createDataFrame([(n,) for n in names], "m string")
    want = ["llama-3.1", "llama-3.1", "qwen2.5", "zephyr"]
    assert [r[0] for r in df.select(chat.template_for_model("m")).collect()] == want
    assert [chat.template_name(n) for n in names] == want


def test_unknown_model(spark):
    df = spark.createDataFrame([("gpt",), (None,)], "m string")
    assert [r[0] for r in df.select(chat.template_for_model("m", "llama-3.1")).collect()] == ["llama-3.1"] * 2
    with pytest.raises(PySparkException, match="no chat template"):
        df.select(chat.template_for_model("m")).collect()
    with pytest.raises(ValueError):
        chat.template_name("gpt")


def test_messages_and_rendering(spark):
    df = spark.createDataFrame([("hello", "안녕")], "input_text string, output_text string")
    row = chats.build_messages(df).first()
    assert [(m.role, m.content) for m in row.messages] == [
        ("system", constants.CHAT_SYSTEM_PROMPT),
        ("user", "*** Input Text:\nhello"),
        ("assistant", "*** Translation:\n안녕"),
    ]
    assert "English.your task" in constants.CHAT_SYSTEM_PROMPT
    short = chats.build_messages(df, "S", with_target=False)
    rendered = chats.render_chat(short, "qwen2.5", add_generation_prompt=True).first().text
    assert rendered == (
        "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\n*** Input Text:\nhello<|im_end|>\n<|im_start|>assistant\n"
    )
    assert chats.render_chat(short, "llama-3.1").first().text == (
        "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nS<|eot_id|>"
        "<|start_header_id|>user<|end_header_id|>\n\n*** Input Text:\nhello<|eot_id|>"
    )


def test_null_content_gives_no_text(spark):
    df = spark.createDataFrame([(None, "x")], "input_text string, output_text string")
    assert chats.render_chat(chats.build_messages(df), "qwen2.5").first().text is None


def test_tokenizers(spark):
    df = spark.createDataFrame([(" a bb\n ccc ",), ("",), (None,)], "t string")
    rows = features.tokenize(df, "t", LENGTHS, add_special=True).collect()
    assert [r.input_ids for r in rows] == [[100, 1, 2, 3, 101], [100, 101], None]
    ids = features.tokenize(df, "t").first().input_ids
    assert len(ids) == 3 and all(0 <= i < 32_000 for i in ids)


def test_python_tokenizer_agrees_with_columns(spark):
    def factory():
        return lambda text: [len(w) for w in text.split()]

    python = tokens.python_tokenizer(factory, bos_id=100, eos_id=101, pad_id=0)
    df = spark.createDataFrame([("a bb", "c"), ("", "dd e")], "input_text string, output_text string")
    for col in ("input_text", "output_text"):
        assert features.tokenize(df, col, python, True).collect() == features.tokenize(df, col, LENGTHS, True).collect()
    messages = chats.build_messages(df)
    a = features.mask_responses_only(messages, python, template="llama-3.1").collect()
    assert a == features.mask_responses_only(messages, LENGTHS, template="llama-3.1").collect()


def test_pad_id_falls_back_to_eos():
    assert tokens.hash_tokenizer().pad_id == 32_001
    with pytest.raises(ValueError):
        _ = tokens.word_tokenizer(F.length).pad_id


@pytest.mark.parametrize("n", [0, 1, 4, 5, 9])
def test_pad_and_mask(spark, n):
    ids = list(range(1, n + 1))
    df = spark.createDataFrame([(ids, [1, 2])], "input_ids array<int>, p array<int>")
    padded = features.pad_truncate(df, 5, 0)
    row = features.mask_prompt(padded, "p").first()
    kept = ids[:5]
    assert row.input_ids == kept + [0] * (5 - len(kept))
    assert row.attention_mask == [1] * len(kept) + [0] * (5 - len(kept))
    assert row.labels == [-100, -100] + row.input_ids[2:]
    row = features.mask_prompt(padded, "p", mask_padding=True).first()
    assert row.labels == [-100, -100] + kept[2:] + [-100] * (5 - max(2, len(kept)))
    assert features.mask_prompt(padded, "p", bos_offset=1).first().labels == [-100] * 3 + row.input_ids[3:]


def test_prompt_longer_than_the_limit_masks_everything(spark):
    df = spark.createDataFrame([([1, 2, 3], list(range(50)))], "input_ids array<int>, p array<int>")
    assert features.mask_prompt(features.pad_truncate(df, 3, 0), "p").first().labels == [-100] * 3


def test_causal_features(spark):
    df = spark.createDataFrame([("a bb", "ccc d"), ("x", "")], "en string, ko string")
    head = len((constants.PROMPT_TEMPLATE.replace("{}", "")).split())
    rows = training.causal_features(df, LENGTHS, max_length=80).collect()
    first = rows[0]
    real = head + 4 + 2
    assert first.labels[: head + 2] == [-100] * (head + 2)
    # Counted without the begin id, the mask leaves the prompt's last token in the labels.
    assert first.labels[head + 2 : real] == [len("Translation:"), 3, 1, 101]
    assert sum(first.attention_mask) == real and len(first.input_ids) == 80
    assert first.labels[real:] == [0] * (80 - real)
    fixed = training.causal_features(df, LENGTHS, max_length=80, bos_offset=1, mask_padding=True).first()
    assert [x for x in fixed.labels if x != -100] == [3, 1, 101]
    assert rows[1].labels[head + 2] == 101


def test_causal_datasets(spark):
    df = spark.range(40).select("id", F.lit("a").alias("en"), F.lit("b").alias("ko"))
    train, validation = training.causal_datasets(df, LENGTHS, "id", max_examples=30, n_validation=6, max_length=60)
    assert (train.count(), validation.count()) == (24, 6)
    assert training.causal_datasets(df, LENGTHS, "id", n_validation=0, max_length=60)[1] is None


def test_only_answers_are_trained(spark):
    schema = "messages array<struct<role:string,content:string>>"
    talk = [("system", "s"), ("user", "uu u"), ("assistant", "aaa aa"), ("user", "u"), ("assistant", "a")]
    df = spark.createDataFrame([(talk,)], schema)
    row = features.mask_responses_only(df, LENGTHS).first()
    assert row.input_ids == [1, 2, 1, 3, 2, 1, 1]
    assert row.labels == [-100, -100, -100, 3, 2, -100, 1]
    row = features.mask_responses_only(df, LENGTHS, template="qwen2.5").first()
    assert len(row.labels) == len(row.input_ids)
    assert [x for x in row.labels if x != -100] == [3, 2 + len("<|im_end|>"), 1 + len("<|im_end|>")]


@pytest.mark.parametrize("partitions", [1, 4, 17])
@pytest.mark.parametrize("rows_per_range", [6, None])
@pytest.mark.parametrize("block", [1, 7, 64])
def test_packing(spark, partitions, rows_per_range, block):
    rows = [(i, [i * 100 + j for j in range((i * 13) % 30)]) for i in range(40)]
    rows[7] = (7, list(range(300)))
    rows[8] = (8, None)
    df = spark.createDataFrame(rows, "k int, input_ids array<int>").repartition(partitions)
    packed = features.pack_sequences(df, block, "k", rows_per_range=rows_per_range).orderBy("block").collect()
    stream = [t for _, ids in rows for t in (ids or [])]
    want = [stream[i : i + block] for i in range(0, len(stream) - block + 1, block)]
    assert [r.input_ids for r in packed] == want
    assert [r.block for r in packed] == list(range(len(want)))


def test_packing_with_separator(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, []), (2, [3])], "k int, input_ids array<int>")
    rows = features.pack_sequences(df, 2, "k", eos_id=9).orderBy("block").collect()
    assert [r.input_ids for r in rows] == [[1, 2], [9, 9], [3, 9]]


@pytest.mark.parametrize("rows_per_range", [9, None])
def test_batch_padding(spark, rows_per_range):
    data = [(i, [1] * ((i * 7) % 11)) for i in range(50)]
    df = spark.createDataFrame(data, "k int, input_ids array<int>").withColumn("labels", F.col("input_ids")).repartition(5)
    rows = features.pad_to_batch_max(df, 8, "k", 0, rows_per_range=rows_per_range).orderBy("rn").collect()
    for row, (k, ids) in zip(rows, data):
        width = max(len(d[1]) for d in data[k // 8 * 8 : k // 8 * 8 + 8])
        assert row.k == k and row.batch_id == k // 8
        assert row.input_ids == ids + [0] * (width - len(ids))
        assert row.labels == ids + [-100] * (width - len(ids))
        assert row.attention_mask == [1] * len(ids) + [0] * (width - len(ids))


def test_batch_padding_needs_one_shuffle(spark):
    df = spark.range(300).select(F.col("id").alias("k"), F.array(F.lit(1)).alias("input_ids"))
    rows = features.pad_to_batch_max(df, 8, "k", 0, labels=None, rows_per_range=50)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
