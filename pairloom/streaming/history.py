"""Digests of everything that a stream has written, kept so that a batch reads a small part of them.

Each batch adds a run. A run is a table in buckets by the first bits of the digest, with about
``BUCKET_ROWS`` rows each, however large it is. Runs lie in levels: ``FANOUT`` runs of one level are merged
into one of the next, so there are a few runs per level and as many levels as the history has digits. A
batch reads, of each run, the buckets that its own digests fall into.

A digest carries the query and the batch that wrote it. A batch that runs again ignores its own digests,
wherever they have been merged to. Which runs there are stands in a version file that is swapped last;
a merge or an addition that fails leaves the earlier runs in force.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import remove_dir
from pairloom.sources import versions

SCHEMA = "digest binary, query string, batch_id bigint"
# Rows of a bucket, and the most bits that number the buckets of a run.
BUCKET_ROWS = 20_000
PREFIX_BITS = 16
# Runs of a level that are merged.
FANOUT = 4
# From so many folders on, a run of which most is wanted is read as a whole.
MANY_FOLDERS = 256


def _prefix(bits: int):
    first = F.conv(F.hex(F.substring("digest", 1, PREFIX_BITS // 8)), 16, 10).cast("int")
    return F.shiftright(first, PREFIX_BITS - bits)


def _ranges(numbers: list[int]) -> list[list[int]]:
    """Ascending numbers as [first, last] pairs."""
    out: list[list[int]] = []
    for number in numbers:
        if out and out[-1][1] == number - 1:
            out[-1][1] = number
        else:
            out.append([number, number])
    return out


def runs(spark: SparkSession, base: str) -> list[dict]:
    """The runs in force: name, level, rows, bits and the buckets that have rows, as ranges."""
    return (versions.read(spark, base)[1] or {"runs": []})["runs"]


def _write_run(rows: DataFrame, base: str, name: str, level: int) -> dict | None:
    """Write rows as a run; None if there are none. ``rows`` is read twice."""
    counts = {r.p: r.n for r in rows.groupBy(_prefix(PREFIX_BITS).alias("p")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())  # of at most 2**16 prefixes
    if not total:
        return None
    bits = min(PREFIX_BITS, max(0, math.ceil(math.log2(total / BUCKET_ROWS))))
    buckets = sorted({p >> (PREFIX_BITS - bits) for p in counts})
    files = max(1, min(len(buckets), math.ceil(total / BUCKET_ROWS / 8)))
    dealt = rows.withColumn("bucket", _prefix(bits)).repartition(files, "bucket").sortWithinPartitions("bucket", "digest")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/{name}")
    return {"name": name, "level": level, "rows": total, "bits": bits, "buckets": _ranges(buckets)}


def _read_run(spark: SparkSession, base: str, run: dict, prefixes: set[int] | None = None) -> DataFrame | None:
    """A run, or of it the buckets that some prefixes fall into."""
    path = f"{base}/{run['name']}"
    reader = spark.read.schema(SCHEMA)
    if prefixes is None:
        return reader.parquet(path).select("digest", "query", "batch_id")
    wanted = {p >> (PREFIX_BITS - run["bits"]) for p in prefixes}
    own = sorted(b for first, last in run["buckets"] for b in range(first, last + 1) if b in wanted)
    if not own:
        return None
    n_buckets = sum(last - first + 1 for first, last in run["buckets"])
    if len(own) > MANY_FOLDERS and 2 * len(own) > n_buckets:
        return _read_run(spark, base, run)
    return reader.parquet(*[f"{path}/bucket={b}" for b in own])


def candidates(digests: DataFrame, base: str, query: str, batch_id: int) -> DataFrame:
    """The digest column of all buckets that ``digests`` may lie in, without the batch's own rows."""
    spark = digests.sparkSession
    prefixes = {r.p for r in digests.select(_prefix(PREFIX_BITS).alias("p")).distinct().collect()}
    found = [part for run in runs(spark, base) if (part := _read_run(spark, base, run, prefixes)) is not None]
    if not found:
        return spark.createDataFrame([], "digest binary")
    other = (F.col("query") != query) | (F.col("batch_id") != batch_id)
    return reduce(DataFrame.unionByName, found).filter(other).select("digest")


def add(rows: DataFrame, base: str, name: str) -> None:
    """Add a run of (digest, query, batch_id), in place of one of the same name, and merge full levels."""
    spark = rows.sparkSession
    number, _ = versions.read(spark, base)
    kept = [run for run in runs(spark, base) if run["name"] != name]
    new = _write_run(rows, base, name, 0)
    number = versions.publish(spark, base, {"runs": kept + [new] if new else kept}, number)
    _merge(spark, base, number)


def _merge(spark: SparkSession, base: str, number: int) -> None:
    while True:
        levels: dict[int, list[dict]] = {}
        for run in runs(spark, base):
            levels.setdefault(run["level"], []).append(run)
        full = [level for level, found in levels.items() if len(found) >= FANOUT]
        if not full:
            return
        level = min(full)
        rows = reduce(DataFrame.unionByName, [_read_run(spark, base, run) for run in levels[level]])
        merged = _write_run(rows, base, f"level{level + 1}-{uuid.uuid4().hex}", level + 1)
        others = [run for found in levels if found != level for run in levels[found]]
        number = versions.publish(spark, base, {"runs": [*others, merged]}, number)
        for run in levels[level]:
            remove_dir(spark, f"{base}/{run['name']}")


def start(pairs: DataFrame, base: str) -> None:
    """Make the history of pairs that were written before there was one."""
    spark = pairs.sparkSession
    if not versions.numbers(spark, base):
        add(pairs.select("digest", "query", "batch_id"), base, "earlier")
