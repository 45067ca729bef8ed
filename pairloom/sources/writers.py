"""Writers. Each writes a folder of part files, one per task, never through the driver."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.session import remove_dir
from pairloom.sources import versions

# Versions of a dataset whose folders are kept, for readers that have begun with an older one.
KEPT_VERSIONS = 2


def write_csv_text(
    df: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int | None = 1_000_000
) -> None:
    """Headed CSV, quoted only where needed. Parts are kept small for readers that cannot split them."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", rows_per_file or 0)
        .csv(path)
    )


def write_jsonl(
    df: DataFrame,
    col: str,
    path: str,
    mode: str = "errorifexists",
    rows_per_file: int | None = None,
) -> None:
    """One JSON object per line from a struct column; ``rows_per_file`` keeps to an upload limit."""
    writer = df.select(F.to_json(col).alias("value")).write.mode(mode)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.text(path)


def save_split(
    df: DataFrame, base: str, name: str, split: str = "train", mode: str = "overwrite"
) -> None:
    """Save one split of a dataset for ``load_split``. See ``save_splits``."""
    save_splits({split: df}, base, name, mode)


def save_splits(splits: Mapping[str, DataFrame], base: str, name: str, mode: str = "overwrite") -> int:
    """Save splits of a dataset together, and give the number of the new version.

    Each split is written to a folder of its own; the version file that names the folders of all splits
    is swapped last. Until then, and if a write fails, readers get what was there before. ``mode`` is
    overwrite (of the splits given; others stay), append, or errorifexists. Folders that only versions
    before the last ``KEPT_VERSIONS`` name are removed.
    """
    if mode not in ("overwrite", "append", "errorifexists"):
        raise ValueError(f"unknown mode: {mode}")
    spark = next(iter(splits.values())).sparkSession
    root = f"{base}/{name}"
    number, before = versions.read(spark, root)
    before = before or {}
    if mode == "errorifexists" and (known := [split for split in splits if split in before]):
        raise ValueError(f"{root} has the splits {known} already")
    content, new = dict(before), []
    try:
        for split, df in splits.items():
            folder = f"{split}/{uuid.uuid4().hex}"
            new.append(folder)
            df.write.parquet(f"{root}/{folder}")
            content[split] = [*(before.get(split, []) if mode == "append" else []), folder]
        number = versions.publish(spark, root, content, number)
    except BaseException:
        for folder in new:
            remove_dir(spark, f"{root}/{folder}")
        raise
    _forget(spark, root, number)
    return number


def _forget(spark, root: str, number: int) -> None:
    """Remove the folders that no kept version names any more."""
    if (old := number - KEPT_VERSIONS) < 1:
        return
    kept = {f for n in range(old + 1, number + 1) for folders in (versions.read(spark, root, n)[1] or {}).values() for f in folders}
    for folders in (versions.read(spark, root, old)[1] or {}).values():
        for folder in set(folders) - kept:
            remove_dir(spark, f"{root}/{folder}")


def write_results(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Evaluation results as JSON lines, one folder per model."""
    df.write.mode(mode).partitionBy("model").json(path)
