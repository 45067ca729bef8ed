"""Text columns, readers and writers on awkward inputs."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.functions import text
from pairloom.plans import corpus
from pairloom.session import scratch_dir
from pairloom.sources import readers, writers

SPACES = ["　", " ", "\u0085", " ", "\x1c", "\x1f", "\t", "\n", " \r\n", " "]
KEPT = ["﻿", "​"]


def test_strip_equals_python(spark):
    values = [f"{s}a {s} b{s}" for s in SPACES + KEPT] + ["", " ", None, "plain"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for row in df.select("v", text.strip("v").alias("s")).collect():
        assert row.s == (None if row.v is None else row.v.strip())


def test_prompt_keeps_braces_and_percent(spark):
    df = spark.createDataFrame([("{} %s {en}", "100%")], "en string, ko string")
    row = df.select(text.format_prompt("en", "ko").alias("p"), text.prompt_only("en").alias("o")).first()
    assert row.p.endswith("### English Text:\n{} %s {en}\n\n### Korean Translation:\n100%")
    assert row.p == row.o + "100%"


def test_answer_after_last_marker(spark):
    df = spark.createDataFrame([("a information.\n\nb information.\n\nc",), ("none",)], "t string")
    assert [r[0] for r in df.select(text.extract_answer("t")).collect()] == ["c", "none"]


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b" x \ny\r\n\nz\rw\x0bv\n")
    (tmp_path / "b.txt").write_bytes("　q\nlast".encode())
    rows = readers.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in rows] == list(enumerate(["x", "y", "", "z", "w\x0bv", "q", "last"]))


def test_read_lines_over_many_splits(spark, tmp_path):
    lines = [f"line {i} {'x' * (i % 50)}" for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(lines[:4000]) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(lines[4000:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = readers.read_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 8
        rows = df.orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.line for r in rows] == [line.strip() for line in lines]
    assert [r.line_no for r in rows] == list(range(5000))


@pytest.mark.parametrize("splits_per_table", [1_000_000, 3])
def test_lines_of_many_files(spark, tmp_path, monkeypatch, splits_per_table):
    monkeypatch.setattr(readers, "SPLITS_PER_TABLE", splits_per_table)
    for i in range(8):
        (tmp_path / f"{i}.txt").write_text("".join(f"{i} {j}\n" for j in range(5)))
    rows = readers.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in rows] == [(5 * i + j, f"{i} {j}") for i in range(8) for j in range(5)]


def test_lines_that_would_move_raise(spark, tmp_path):
    """Files packed into tasks otherwise between plan and run."""
    for i in range(40):
        (tmp_path / f"{i:02d}.txt").write_text("x\n" * (1 + i % 3))
    setting = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(setting)
    lines = readers.read_lines(spark, str(tmp_path))
    try:
        spark.conf.set(setting, str(1 << 30))
        with pytest.raises(Exception, match="file splits changed"):
            lines.collect()
    finally:
        spark.conf.set(setting, before)


def test_strip_is_linear(spark):
    df = spark.range(1).select(F.concat(F.lit(" a"), F.repeat(F.lit(" "), 1_000_000), F.lit("b ")).alias("t"))
    start = time.perf_counter()
    assert df.select(F.length(text.strip("t"))).first()[0] == 1_000_002
    assert time.perf_counter() - start < 3


def test_csv_of_plain_cells_can_be_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text("en,ko\n" + "a,b\n" * 10)
    assert readers.read_csv_text(spark, str(tmp_path), schemas.PAIR, multi_line=False).count() == 10


def test_empty_line_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("")
    assert readers.read_lines(spark, str(tmp_path)).collect() == []


def test_aligned_pairs_stop_at_the_shorter(spark, tmp_path):
    (tmp_path / "en").write_text("a\nb\na\nd\n")
    (tmp_path / "ko").write_text("1 \n2\n1\n")
    pairs = corpus.aligned_pairs(spark, str(tmp_path / "en"), str(tmp_path / "ko"))
    assert sorted((r.line_no, r.en, r.ko) for r in pairs.collect()) == [(0, "a", "1"), (1, "b", "2")]


CELLS = ['a "q" b', "x\ny", "a,b", "", "None", "NA", "back\\slash", 'end\\"q', '"', " edge ", None, "한국어"]


def test_csv_round_trip(spark):
    path = scratch_dir(spark, "test")
    df = spark.createDataFrame([(c, f"k{i}") for i, c in enumerate(CELLS)], schemas.PAIR)
    writers.write_csv_text(df, path)
    back = readers.read_csv_text(spark, path, schemas.PAIR)
    # An empty text comes back as null; everything else, spaces included, as it was.
    assert {r.ko: r.en for r in back.collect()} == {r.ko: r.en or None for r in df.collect()}


def test_jsonl_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"en":"a","ko":"b"}\n{"en":\n')
    rows = {r.value: r for r in readers.read_jsonl(spark, str(tmp_path), schemas.PAIR).collect()}
    assert rows['{"en":"a","ko":"b"}'].ko == "b" and rows['{"en":"a","ko":"b"}']._corrupt is None
    assert rows['{"en":'].en is None and rows['{"en":']._corrupt == '{"en":'


def test_jsonl_rows_per_file(spark):
    path = scratch_dir(spark, "test")
    df = spark.range(25).coalesce(1).select(F.struct("id").alias("r"))
    writers.write_jsonl(df, "r", path, rows_per_file=10)
    files = spark.read.text(path).groupBy("_metadata.file_path").count().collect()
    assert sorted(f["count"] for f in files) == [5, 10, 10]


def test_splits_and_results(spark):
    base = scratch_dir(spark, "test")
    writers.save_split(spark.range(5), base, "d", "test")
    assert readers.load_split(spark, base, "d", "test").count() == 5
    results = spark.createDataFrame([("m1", "i", "r"), ("m2", "i", "한")], "model string, input string, result string")
    writers.write_results(results, base + "/r")
    back = spark.read.json(base + "/r").select("model", "input", "result")
    assert sorted(map(tuple, back.collect())) == [("m1", "i", "r"), ("m2", "i", "한")]


def test_read_documents(spark, tmp_path):
    (tmp_path / "one.txt").write_text("Snow fell all night.\nThe road was shut.")
    (tmp_path / "two.txt").write_text("밤새 눈이 내렸다.")
    rows = readers.read_documents(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in rows) == ["Snow fell all night.\nThe road was shut.", "밤새 눈이 내렸다."]
    assert all("/" in r.path for r in rows)


class FakeSession:
    """A session with a master and settings, for looking at paths only."""

    def __init__(self, master, **settings):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = {key.replace("_", "."): value for key, value in settings.items()}


def test_scratch_folder():
    cluster = FakeSession("spark://host:7077", spark_checkpoint_dir="hdfs://n/shared/")
    assert scratch_dir(cluster, "x").startswith("hdfs://n/shared/pairloom-x-")
    assert scratch_dir(cluster, "x") != scratch_dir(cluster, "x")
    assert "pairloom-x-" in scratch_dir(FakeSession("local[2]"), "x")
    with pytest.raises(RuntimeError):
        scratch_dir(FakeSession("spark://host:7077"), "x")
