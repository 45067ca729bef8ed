"""Requests out, responses in."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom import constants, schemas
from pairloom.operators import requests, responses
from pairloom.plans import corpus
from pairloom.session import scratch_dir
from pairloom.sources import readers


def texts(spark, n, partitions=3):
    return spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("t")).repartition(partitions)


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 30, 137])
@pytest.mark.parametrize("rows_per_range", [12, None])
def test_batches(spark, n, rows_per_range):
    df = requests.batch_rows(texts(spark, n), "t", order_by="k", rows_per_range=rows_per_range)
    rows = df.orderBy("batch_id").collect()
    want = [[f"t{i}" for i in range(n)][j : j + 10] for j in range(0, n, 10)]
    assert [(r.batch_id, r.n, r.content) for r in rows] == [(i, len(w), "\n".join(w)) for i, w in enumerate(want)]


def test_batches_by_given_index(spark):
    df = texts(spark, 25).withColumnRenamed("k", "rn")
    by_index = requests.batch_rows(df, "t", index="rn").orderBy("batch_id").collect()
    assert by_index == requests.batch_rows(df, "t", order_by="rn").orderBy("batch_id").collect()
    with pytest.raises(ValueError):
        requests.batch_rows(df, "t")


def test_batches_need_one_shuffle(spark):
    df = requests.batch_rows(texts(spark, 300), "t", order_by="k", rows_per_range=50)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # One from the repartition of the input, one by range.
    assert plan.count("Exchange") == 2


def test_line_breaks_in_a_text(spark):
    df = spark.createDataFrame([(0, "a\nb"), (1, "c\r\nd")], "k int, t string")
    assert requests.batch_rows(df, "t", order_by="k").first().content == "a\nb\nc\r\nd"
    assert requests.batch_rows(df, "t", order_by="k", newline="space").first().content == "a b\nc d"


def test_null_text_keeps_its_line(spark):
    df = spark.createDataFrame([(0, "a"), (1, None), (2, "c")], "k int, t string")
    assert requests.batch_rows(df, "t", order_by="k").first().content == "a\n\nc"


def test_request_object(spark):
    df = requests.batch_rows(texts(spark, 12), "t", order_by="k")
    sent = requests.build_requests(df)
    assert [f.name for f in sent.schema["request"].dataType] == [f.name for f in schemas.REQUEST]
    rows = {r[0]: json.loads(r[1]) for r in sent.select("custom_id", F.to_json("request")).collect()}
    assert sorted(rows) == ["task-0", "task-1"]
    assert rows["task-1"] == {
        "custom_id": "task-1",
        "method": "POST",
        "url": "/v1/chat/completions",
        "body": {
            "model": "gpt-4o-mini",
            "temperature": 0.7,
            "response_format": {"type": "json_object"},
            "messages": [
                {"role": "system", "content": constants.TRANSLATION_SYSTEM_PROMPT_KO},
                {"role": "user", "content": "t10\nt11"},
            ],
        },
    }


def line(content, custom_id="task-3"):
    body = {"choices": [{"message": {"content": content}}]}
    return json.dumps({"custom_id": custom_id, "response": {"body": body}, "other": [1, {"x": None}]})


GOOD = json.dumps({"sentences_en": ["a", "b"], "sentences_ko": ["1", "2"]})
CASES = [
    (line(GOOD), None),
    (line(GOOD, "task-7-x"), None),
    ("  " + line(" " + GOOD + "\n") + " ", None),
    (line('{"sentences_en":["x"],"sentences_en":["a"],"sentences_ko":["1"]}'), None),
    (line('{"sentences_en":["a",null,3,{"q":1}],"sentences_ko":["1","2","3","4"]}'), None),
    (line(GOOD)[:-1], "bad_json"),
    (line(GOOD) + " more", "bad_json"),
    (line(GOOD) + "}", "bad_json"),
    (line(GOOD) + "]", "bad_json"),
    (line(GOOD) + "," + line(GOOD), "bad_json"),
    ("", "bad_json"),
    ("null", "bad_json"),
    ("[1]", "bad_json"),
    ("{'custom_id':'task-1'}", "bad_json"),
    (line(GOOD, "task"), "bad_custom_id"),
    (line(GOOD, "task-x"), "bad_custom_id"),
    (json.dumps({"response": {"body": {"choices": []}}}), "bad_custom_id"),
    (json.dumps({"custom_id": "task-1", "response": {"body": {"choices": []}}}), "no_choice"),
    (json.dumps({"custom_id": "task-1", "response": None}), "no_choice"),
    (line(None), "no_choice"),
    (line(GOOD[:-1]), "bad_inner_json"),
    (line(GOOD + " trailing"), "bad_inner_json"),
    (line(GOOD + "}"), "bad_inner_json"),
    (line(GOOD + "]"), "bad_inner_json"),
    (line("{'sentences_en':['a'],'sentences_ko':['1']}"), "bad_inner_json"),
    (line('{"sentences_en":["a\tb"],"sentences_ko":["1"]}'), "bad_inner_json"),
    (line("[1]"), "bad_inner_json"),
    (line(""), "bad_inner_json"),
    (line('{"sentences_en":["a"]}'), "missing_key"),
    (line("{}"), "missing_key"),
    (line('{"sentences_en":"ab","sentences_ko":["1"]}'), "not_array"),
    (line('{"sentences_en":null,"sentences_ko":["1"]}'), "not_array"),
    (line('{"sentences_en":{"a":1},"sentences_ko":["1"]}'), "not_array"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "value string")
    parsed = responses.parse_responses(df)
    got = {r.raw: r.error for r in parsed.collect()}
    assert got == dict(CASES)
    bad = responses.quarantine(parsed).collect()
    assert {(r.raw, r.reason) for r in bad} == {c for c in CASES if c[1]}


def test_counts_and_elements(spark):
    df = spark.createDataFrame([(CASES[4][0],)], "value string")
    row = responses.parse_responses(df).first()
    assert (row.custom_id, row.task_idx, row.n_en, row.n_ko) == ("task-3", 3, 4, 4)
    assert row.sentences_en == ["a", None, "3", '{"q":1}']


def test_each_level_is_parsed_once(spark):
    df = spark.createDataFrame([(line(GOOD),)], "value string")
    plan = responses.build_pairs(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2


STRICT_CASES = [
    ('{"a":1}', True), (' {"a":1} ', True), ('{"a":1} trailing', False), ('{"a":1}}', False), ("{'a':1}", False),
    ('{"a":1}]', False), ('{"a":1}] {"a":2}', False), ('{"a":1},{"a":2}', False), ('{"a":1},{"end":true}]', False),
    ("", False), ("1", False), ("[1]", False), ('{"a":1', False), ('{"a":"x"}', False), ('{}', True), ('{"a":1}}]', False),
]


def test_read_jsonl_is_strict(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(text for text, _ in STRICT_CASES if text))
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    rows = readers.read_jsonl(spark, str(tmp_path), schema).collect()
    got = {r.value: r for r in rows}
    for text, good in STRICT_CASES:
        if text:
            assert (got[text]._corrupt is None) == good, text
            assert got[text].a == (1 if good and "1" in text else None), text
            assert good or got[text]._corrupt == text


@pytest.mark.parametrize(
    "a,b,n", [(["x"] * 10, ["y"] * 10, 10), (["x"] * 10, ["y"] * 9, 9), ([], ["y"] * 3, 0), (None, ["y"], 0), ([None, "x"], ["y", None], 2)]
)
def test_zip_stops_at_the_shorter(spark, a, b, n):
    schema = "task_idx bigint, sentences_en array<string>, sentences_ko array<string>"
    rows = responses.explode_pairs(spark.createDataFrame([(1, a, b)], schema)).orderBy("pos").collect()
    assert [(r.pos, r.en, r.ko) for r in rows] == [(i, a[i], b[i]) for i in range(n)]


def test_requests_to_pairs_and_back(spark):
    """Requests, an answer for each, and the pairs hold every text again, also with quotes."""
    data = [(i, f'text "{i}" \\ 한 \t end') for i in range(45)]
    df = spark.createDataFrame(data, "k int, t string")
    sent = requests.build_requests(requests.batch_rows(df, "t", order_by="k")).collect()
    lines = []
    for row in sent:
        en = row.request.body.messages[1].content.split("\n")
        answer = {"sentences_en": en, "sentences_ko": ["ko " + e for e in en]}
        lines.append((line(json.dumps(answer), row.custom_id),))
    lines.append(lines[0])
    path = scratch_dir(spark, "test")
    spark.createDataFrame(lines, "value string").write.text(path + "/in")
    pairs, bad = corpus.publish_pairs(spark, path + "/in", path, "pairs")
    assert bad.count() == 0
    rows = pairs.orderBy("first_seen").collect()
    assert [(r.en, r.ko) for r in rows] == [(t, "ko " + t) for _, t in data]
    train, test = corpus.split_published(pairs, 42)
    assert (train.count(), test.count()) == (40, 5)


def test_first_seen_order_is_exact(spark):
    df = spark.createDataFrame([(2**62, 2**31 - 1), (2**62, 0), (-5, 3)], "task_idx bigint, pos int")
    values = [r[0] for r in df.select(responses.first_seen()).collect()]
    assert values == [2**62 * 10**10 + 2**31 - 1, 2**62 * 10**10, -5 * 10**10 + 3]


def test_missing_tasks(spark):
    sent = spark.createDataFrame([(f"task-{i}",) for i in range(5)], "custom_id string")
    lines = [(line(GOOD, "task-1"),)] * 3 + [(line("{}", "task-2"),), (line(GOOD, "task-4"),)]
    parsed = responses.parse_responses(spark.createDataFrame(lines, "value string"))
    assert {r[0] for r in responses.missing_tasks(sent, parsed).collect()} == {"task-0", "task-2", "task-3"}


def test_multilingual(spark):
    content = {f"sentences_{lang}": [f"{lang}{i}" for i in range(3)] for lang in constants.MULTI_LANGS}
    content["sentences_ja"] = ["ja0"]
    df = spark.createDataFrame([(line(json.dumps(content)),)], "value string")
    rows = responses.explode_multilingual(responses.parse_responses(df, constants.MULTI_LANGS)).collect()
    assert {tuple(r) for r in rows} == {(3, 0, lang, "en0", f"{lang}0") for lang in ("ko", "sp", "fr", "ja")}


def test_bidirectional(spark):
    df = spark.createDataFrame([("a", "1")], schemas.PAIR)
    rows = {tuple(r) for r in responses.bidirectional_examples(df).collect()}
    assert rows == {("a", "1", "en-ko"), ("1", "a", "ko-en")}
