"""Session helpers: a local session for tests and the shared folder for intermediate files."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """Session on this machine, for tests and the bench. On a cluster use the one it gives."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pairloom")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


# Folders that this process has named and not yet removed.
_made: list[str] = []


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the session's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Where it is unset, a local session gets a
    temporary folder; any other master is refused, as its executors do not share this disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "pairloom")
    path = f"{base.rstrip('/')}/pairloom-{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch_dir`` named, in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if path in _made:
        _made.remove(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete all intermediate folders of this process; call it once the results are written."""
    paths = list(_made)
    for path in paths:
        remove_dir(spark, path)
    return len(paths)
