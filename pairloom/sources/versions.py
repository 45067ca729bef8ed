"""Versions of a folder: each is one small file that lists what belongs to it; the newest one counts.

Data goes to new places first and the version file appears last, by a rename. A writer that fails on the
way leaves the earlier version as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

_FOLDER = "_versions"


def _file(spark: SparkSession, path: str):
    """The store of a path and the path in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def numbers(spark: SparkSession, base: str) -> list[int]:
    """All versions of a folder, ascending."""
    store, folder = _file(spark, f"{base}/{_FOLDER}")
    if not store.exists(folder):
        return []
    names = [status.getPath().getName() for status in store.listStatus(folder)]
    return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json") and not name.startswith("."))


def read(spark: SparkSession, base: str, number: int | None = None) -> tuple[int, dict | None]:
    """A version, the newest by default, and its content; (0, None) if there is none."""
    known = numbers(spark, base)
    number = number if number is not None else (known[-1] if known else 0)
    if number not in known:
        return 0, None
    store, path = _file(spark, f"{base}/{_FOLDER}/{number:012d}.json")
    stream = store.open(path)
    try:
        return number, json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def publish(spark: SparkSession, base: str, content: dict, after: int) -> int:
    """Make ``content`` the version that follows ``after``. Raises if there is one already."""
    number = after + 1
    store, target = _file(spark, f"{base}/{_FOLDER}/{number:012d}.json")
    _, part = _file(spark, f"{base}/{_FOLDER}/.{uuid.uuid4().hex}")
    stream = store.create(part, False)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    if store.exists(target) or not store.rename(part, target):
        store.delete(part, False)
        raise RuntimeError(f"version {number} of {base} has been written by another job")
    return number
