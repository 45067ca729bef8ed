"""Token-budget batches, CSV in splits, datasets in versions, resumable generation and sketches."""

from __future__ import annotations

import csv
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom import constants
from pairloom.operators import budget, generate, sketches
from pairloom.session import scratch_dir
from pairloom.sources import readers, versions, writers
from pairloom.sources.csv_splits import read_csv_splits
from tablequeries import queries


def plain_batches(lengths, tokens, most_rows):
    out, batch = [], []
    for n in lengths:
        if batch and (len(batch) == most_rows or (len(batch) + 1) * max([*batch, n]) > tokens):
            out.append(batch)
            batch = []
        batch.append(n)
    return out + [batch] if batch else out


@pytest.mark.parametrize("seed", range(6))
def test_next_starts(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 1, 5, 30, 200]) for _ in range(150)]
    for tokens, most in ((1, 3), (60, 4), (200, 50), (10_000, 9)):
        ahead = budget.next_starts(np.array(lengths), tokens, most)
        at, got = 0, []
        while at < len(lengths):
            got.append(lengths[at : ahead[at]])
            at = ahead[at]
        assert got == plain_batches(lengths, tokens, most)


@pytest.mark.parametrize("n, tokens, most_rows, blocks, parts", [(700, 120, 8, 2, 5), (700, 120, 8, 1, 3), (300, 5_000, 100, 16, 1), (1, 5, 2, 1, 1), (0, 5, 2, 1, 1)])
def test_batches_equal_the_sequential_cut(spark, n, tokens, most_rows, blocks, parts):
    rng = random.Random(n + blocks)
    rows = [(i * 3, None if rng.random() < 0.02 else rng.choice([1, 3, 20, 50, 400]), 7) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, n int, start int").repartition(parts)
    got = sorted(budget.token_batches(df, tokens, "id", "n", most_rows, blocks).collect(), key=lambda r: r.rn)
    want = plain_batches([r[1] or 0 for r in rows], tokens, most_rows)
    assert [r.id for r in got] == [r[0] for r in rows] and {"start"} <= set(df.columns)
    assert [r.batch_id for r in got] == [b for b, batch in enumerate(want) for _ in batch]
    assert [r.batch_len for r in got] == [max(batch) for batch in want for _ in batch]


def test_padding_to_a_budget(spark):
    rows = [(i, list(range(1, 2 + i % 5)), list(range(1, 2 + i % 5))) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, input_ids array<int>, labels array<int>")
    got = budget.pad_to_token_budget(df, 12, "id", pad_id=0, most_rows=4).collect()
    assert len(got) == 40
    for batch in {r.batch_id for r in got}:
        own = [r for r in got if r.batch_id == batch]
        longest = max(len(rows[r.id][1]) for r in own)
        assert len(own) * longest <= 12 or len(own) == 1
        for r in own:
            n = len(rows[r.id][1])
            assert r.input_ids == rows[r.id][1] + [0] * (longest - n)
            assert r.attention_mask == [1] * n + [0] * (longest - n)
            assert r.labels == rows[r.id][1] + [constants.IGNORE_INDEX] * (longest - n)
    with pytest.raises(ValueError):
        budget.token_batches(df, 0, "id", "id")


CELLS = ["plain", "", "a,b", 'say "x"', "two\nlines", '"', "\n\n", "None", "tail\r", " space ", '",\n"', "é漢", "x" * 300, "a\nb\nc\nd\ne"]


@pytest.mark.parametrize("size", [40, 97, 1 << 20])
def test_csv_in_splits(spark, tmp_path, size):
    rng = random.Random(size)
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("n", T.IntegerType())])
    folder, want = tmp_path / "csv", Counter()
    folder.mkdir()
    for name in ("1.csv", "2.csv"):
        rows = [(rng.choice(CELLS), rng.choice(CELLS), i) for i in range(60)]
        with open(folder / name, "w", newline="", encoding="utf-8") as file:
            writer = csv.writer(file, lineterminator="\r\n" if name == "2.csv" else "\n")
            writer.writerow(["a", "b", "n"])
            writer.writerows(rows)
        want.update((a or None, b or None, n) for a, b, n in rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        frame = read_csv_splits(spark, str(folder), schema)
        got = Counter(map(tuple, frame.collect()))
        n_splits = spark.read.text(str(folder)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert frame.columns == ["a", "b", "n"] and got == want
    assert n_splits > 20 or size > 1000
    assert got == Counter(map(tuple, readers.read_csv_text(spark, str(folder), schema).collect()))


def test_csv_of_odd_files(spark, tmp_path):
    schema = T.StructType([T.StructField("a b", T.StringType())])
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("a b\n")
    (tmp_path / "blank.csv").write_text('\n\na b\n\nx\n\n"a b"\n')
    assert Counter(r[0] for r in read_csv_splits(spark, str(tmp_path), schema).collect()) == Counter(["x", "a b"])


def test_splits_are_published_together(spark, tmp_path):
    base = str(tmp_path)
    writers.save_splits({"train": spark.range(5), "test": spark.range(2)}, base, "d")
    assert readers.load_split(spark, base, "d").count() == 5

    def broken(batches):
        yield from batches
        raise OSError("lost")

    fails = spark.range(9).mapInPandas(broken, "id long")
    with pytest.raises(Exception):
        writers.save_splits({"train": spark.range(7), "test": fails}, base, "d")
    assert [readers.load_split(spark, base, "d", s).count() for s in ("train", "test")] == [5, 2]
    writers.save_split(spark.range(3), base, "d", "test", mode="append")
    writers.save_split(spark.range(1), base, "d", "train")
    assert [readers.load_split(spark, base, "d", s).count() for s in ("train", "test")] == [1, 5]
    with pytest.raises(ValueError):
        writers.save_split(spark.range(1), base, "d", "train", mode="errorifexists")
    with pytest.raises(ValueError):
        readers.load_split(spark, base, "d", "none")
    assert readers.load_split(spark, base, "d", "train", version=2).count() == 5
    # Folders that only old versions name are gone; those that kept versions share are not.
    writers.save_split(spark.range(4), base, "d", "train")
    assert len([p for p in (tmp_path / "d" / "train").iterdir() if p.is_dir()]) == 2
    assert readers.load_split(spark, base, "d", "test").count() == 5


def test_splits_of_before_versions_are_read(spark, tmp_path):
    spark.range(6).write.parquet(f"{tmp_path}/d/train")
    assert readers.load_split(spark, str(tmp_path), "d").count() == 6


def test_generation_goes_on_where_it_was(spark):
    store = scratch_dir(spark, "store")
    calls = spark.sparkContext.accumulator(0)

    def factory(params):
        def run(texts):
            calls.add(len(texts))
            if params.get("fail") and any(t and "9" in t for t in texts):
                raise OSError("lost")
            return [None if t is None else f"{params['model']}:{t}" for t in texts]

        return run

    rows = [(f"t{i % 30}",) for i in range(50)] + [(None,), ("",), (None,)]
    df = spark.createDataFrame(rows, "text string").repartition(3)

    def results(params, **more):
        found = generate.resume_generate(df, "text", factory, store, params, rows_per_round=5, **more)
        return Counter(map(tuple, found.collect()))

    want = lambda name: Counter((t, None if t is None else f"{name}:{t}") for (t,) in rows)
    assert results({"model": "a"}) == want("a") and calls.value == 32
    assert results({"model": "a"}) == want("a") and calls.value == 32
    assert results({"model": "b"}) == want("b") and calls.value == 64
    more = spark.createDataFrame([("t1",), ("new",)], "text string")
    found = generate.resume_generate(more, "text", factory, store, {"model": "a"}).collect()
    assert sorted(map(tuple, found)) == [("new", "a:new"), ("t1", "a:t1")] and calls.value == 65
    # A round that fails is not stored, those before are.
    with pytest.raises(Exception):
        results({"model": "c", "fail": True})
    _, content = versions.read(spark, store)
    done = spark.read.parquet(*[f"{store}/{f}" for f in content["folders"]]).filter("result LIKE 'c:%'").count()
    assert done < 30
    both = generate.fan_out_models(df, [{"model": "a"}, {"model": "b"}], "text", factory, store=store)
    before = calls.value
    assert Counter((r.input, r.result) for r in both.collect()) == want("a") + want("b") and calls.value == before


def test_sketches_stay_within_their_bounds(spark):
    # 30,000 rows, one text in a fifth of them, 20,000 different others.
    text = F.when(F.col("id") % 5 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") * 7 % 20_000).cast("string"), F.repeat(F.lit("x"), (F.col("id") % 301).cast("int"))))
    df = spark.range(30_000).select(F.when(F.col("id") % 1000 == 1, None).otherwise(text).alias("text")).repartition(7)
    known = df.filter("text IS NOT NULL")
    parts = [known.filter(F.pmod(F.xxhash64("text"), F.lit(3)) == i) for i in range(3)] + [df.filter("text IS NULL")]
    whole = sketches.estimates(sketches.sketch(df, "text", "c")).first()
    merged = sketches.profile_sketches({"c": (parts[0], "text")})
    for part in parts[1:]:
        merged = merged.unionByName(sketches.sketch(part, "text", "c"))
    merged = sketches.estimates(sketches.merge(merged)).first()
    texts = [r.text for r in df.collect()]
    lengths = sorted(len(t) for t in texts if t is not None)
    for found in (whole, merged):
        assert (found.n_rows, found.n_null) == (30_000, texts.count(None)) and found.n_chars == sum(lengths)
        assert (found.min_len, found.max_len) == (lengths[0], lengths[-1])
        assert abs(found.n_different - len(set(texts) - {None})) < 0.03 * len(set(texts))
        for q, value in zip(sketches.QUANTILES, found.length_quantiles):
            low, high = (np.searchsorted(lengths, value, side) / len(lengths) for side in ("left", "right"))
            assert low - 0.02 <= q <= high + 0.02
        hot = found.most_frequent[0]
        digest = df.filter("text = 'hot'").select(F.md5("text").alias("d")).first().d
        assert hot.digest == digest and 0 <= hot.n - texts.count("hot") <= 3.5 / sketches.TOP_ITEMS * 30_000
    none = sketches.estimates(sketches.sketch(df.limit(0), "text")).first()
    assert (none.n_rows, none.n_different, none.length_quantiles, none.most_frequent) == (0, 0, None, [])


def test_large_csv_files_are_written_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("text "), 50).alias("text"))
    docs.repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    written = []
    keep = writers.write_csv_text
    monkeypatch.setattr(queries.writers, "write_csv_text", lambda df, *args, **more: (written.append(df.rdd.getNumPartitions()), keep(df, *args, **more)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for size, least in ((1 << 28, 2), (20_000, 5)):
            monkeypatch.setattr(queries, "CSV_BYTES", size, raising=False)
            assert queries.read_csv_splits(spark, str(tmp_path)).count() == 400
            assert written.pop() == least
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_prompts_are_kept_once_and_in_the_order_of_their_rounds(spark, monkeypatch):
    kept = {}
    keep = generate.written
    monkeypatch.setattr(generate, "written", lambda df, label="keys", path=None: kept.setdefault(label, []).append(found := keep(df, label, path)) or found)
    df = spark.range(40).select(F.concat(F.lit("t"), F.col("id") % 30).alias("text"), F.col("id").cast("string").alias("other"))
    factory = lambda params: lambda texts: [t + "!" for t in texts]
    store = scratch_dir(spark, "store")
    assert generate.resume_generate(df, "text", factory, store, rows_per_round=4).count() == 40
    assert sorted(kept["prompts"][0].columns) == ["digest", "input"]
    rounds = kept["absent"][-1]
    assert rounds.select("turn").distinct().count() > 4
    turns = rounds.groupBy(F.input_file_name()).agg(F.collect_list("turn").alias("t")).collect()
    assert all(r.t == sorted(r.t) for r in turns)
    other = generate.resume_generate(df, "text", factory, store, prompt="other").collect()
    assert Counter((r.input, r.result) for r in other) == Counter((f"t{i % 30}", f"{i}!") for i in range(40))
