"""Digest history in levels, versions of a folder, and the stream on top of them."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from pairloom.session import scratch_dir
from pairloom.sources import versions
from pairloom.streaming import history
from pairloom.streaming import responses as stream
from tests.test_generate_and_stream import answer, drop


def digests(spark, numbers, query="q", batch=0):
    rows = [(hashlib.sha256(str(i).encode()).digest(), query, batch) for i in numbers]
    return spark.createDataFrame(rows, history.SCHEMA)


def size_of(files):
    return sum(os.path.getsize(f.removeprefix("file://")) for f in files)


def test_versions(spark):
    base = scratch_dir(spark, "test")
    assert versions.read(spark, base) == (0, None)
    assert versions.publish(spark, base, {"a": [1, "é"]}, 0) == 1
    assert versions.publish(spark, base, {"a": []}, 1) == 2
    with pytest.raises(RuntimeError):
        versions.publish(spark, base, {"a": [7]}, 1)
    assert versions.read(spark, base) == (2, {"a": []}) and versions.read(spark, base, 1) == (1, {"a": [1, "é"]})
    assert versions.numbers(spark, base) == [1, 2]


def test_bytes_read_stay_flat(spark, monkeypatch):
    """Fifty batches: each finds exactly what was there before, and reads no more than early ones do."""
    monkeypatch.setattr(history, "BUCKET_ROWS", 16)
    base = scratch_dir(spark, "test")
    read = []
    for batch in range(50):
        new = list(range(batch * 200, batch * 200 + 200))
        asked = digests(spark, [*new[:4], batch * 90, batch * 7], batch=batch)
        found = history.candidates(asked, base, "q", batch)
        read.append(size_of(found.inputFiles()))
        known = found.join(asked.select("digest"), "digest", "left_semi").distinct().count()
        assert known == len({x for x in (batch * 90, batch * 7) if x < batch * 200})
        history.add(digests(spark, new, batch=batch), base, f"level0-q-{batch}")
    levels = [run["level"] for run in history.runs(spark, base)]
    assert max(levels) == 2 and len(levels) <= 3 * 3 and sum(run["rows"] for run in history.runs(spark, base)) == 10_000
    assert max(read[30:]) <= 1.6 * max(read[8:20])


def test_failed_addition_leaves_earlier_runs(spark, monkeypatch):
    base = scratch_dir(spark, "test")
    history.add(digests(spark, range(5)), base, "level0-q-0")
    before = history.runs(spark, base)

    def fail(*_):
        raise OSError("no more disk")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(versions, "publish", fail)
        history.add(digests(spark, range(5, 9), batch=1), base, "level0-q-1")
    assert history.runs(spark, base) == before
    assert history.candidates(digests(spark, range(9)), base, "x", 0).count() == 5


def test_own_rows_are_ignored_after_merges(spark, monkeypatch):
    monkeypatch.setattr(history, "FANOUT", 2)
    base = scratch_dir(spark, "test")
    for batch in range(4):
        history.add(digests(spark, range(batch * 10, batch * 10 + 10), batch=batch), base, f"level0-q-{batch}")
    assert [run["level"] for run in history.runs(spark, base)] == [2]
    asked = digests(spark, range(40))
    assert history.candidates(asked, base, "q", 2).count() == 30
    assert history.candidates(asked, base, "other", 2).count() == 40
    assert history.candidates(digests(spark, []), base, "q", 9).count() == 0


def test_stream_over_many_batches_and_a_replay(spark, tmp_path, monkeypatch):
    """Batches merge their histories; one that runs again gives the same pairs."""
    monkeypatch.setattr(history, "FANOUT", 2)
    monkeypatch.setattr(history, "BUCKET_ROWS", 2)
    base = scratch_dir(spark, "test")
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(7):
        drop(folder, f"{i}.jsonl", [answer(i, [(f"a{j}", str(j)) for j in range(i, i + 4)])])

    def run(checkpoint):
        stream.ingest_responses_stream(spark, str(folder), f"{base}/out", checkpoint, files_per_trigger=1).awaitTermination()

    run(str(tmp_path / "one"))
    got = sorted(map(tuple, stream.read_pairs(spark, f"{base}/out").collect()))
    assert got == sorted((f"a{j}", str(j)) for j in range(10))
    # The last commit is lost, as when the job dies before it: the last batch runs again.
    last = max((tmp_path / "one" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run(str(tmp_path / "one"))
    assert sorted(map(tuple, stream.read_pairs(spark, f"{base}/out").collect())) == got
    run(str(tmp_path / "two"))
    assert sorted(map(tuple, stream.read_pairs(spark, f"{base}/out").collect())) == got


def test_pairs_from_before_the_history_count(spark, tmp_path):
    base = scratch_dir(spark, "test")
    old = spark.createDataFrame([("a", "1")], "en string, ko string").withColumn("digest", stream.pair_digest())
    old.write.parquet(f"{base}/out/pairs/query=old/batch_id=0")
    folder = tmp_path / "in"
    folder.mkdir()
    drop(folder, "1.jsonl", [answer(0, [("a", "1"), ("b", "2")])])
    stream.ingest_responses_stream(spark, str(folder), f"{base}/out", str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, stream.read_pairs(spark, f"{base}/out").collect())) == [("a", "1"), ("b", "2")]
    assert stream.read_pairs(spark, f"{base}/out").filter(F.col("en") == "a").count() == 1


def test_texts_are_not_shuffled_to_meet_few_known_pairs(spark, tmp_path, monkeypatch):
    """In a batch of very many pairs the known ones, if few, are broadcast."""
    monkeypatch.setattr(stream, "BROADCAST_DIGESTS", 5)
    base = scratch_dir(spark, "test")
    folder = tmp_path / "in"
    folder.mkdir()
    calls, keep = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: (calls.append(df.columns), keep(df))[1])
    for i, first in enumerate((0, 7)):
        drop(folder, f"{i}.jsonl", [answer(i, [(f"a{j}", str(j)) for j in range(first, first + 10)])])
        calls.clear()
        stream.ingest_responses_stream(spark, str(folder), f"{base}/out", str(tmp_path / "c")).awaitTermination()
        assert ["digest"] in calls
    got = sorted(map(tuple, stream.read_pairs(spark, f"{base}/out").collect()))
    assert got == sorted((f"a{j}", str(j)) for j in range(17))
