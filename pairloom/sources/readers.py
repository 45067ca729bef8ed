"""Readers. Schemas are always given; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.json import STRICT, single_json
from pairloom.functions.rows import once
from pairloom.functions.text import strip
from pairloom.operators import order
from pairloom.operators.order import written
from pairloom.sources import versions

# Rows of one broadcast table of file splits: 32 bytes each. More splits take more such tables.
SPLITS_PER_TABLE = 1_000_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines in file order with a line number from 0, stripped; blank lines stay.

    Several files follow each other by path. Numbering needs no sort and no shuffle of text: a line's
    place inside its file split comes from the scan, and one small aggregation gives the lines before
    each split: a window over the splits of each file, and a running total over files by ranges of their
    paths. The splits are then looked up by a 64-bit hash in broadcast tables of bounded size, as many as
    it takes.

    Lines are numbered as the plan is built, and again when it runs. If the files are cut or packed
    into tasks otherwise by then, as when ``spark.sql.files.*`` settings or the number of cores have
    changed, every line that would get another number raises. Pin ``spark.sql.files.minPartitionNum``
    where executors come and go.
    """
    scan = spark.read.text(path).select(
        F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("_split"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    parts = scan.groupBy("_split", "_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    parts = written(parts, "splits")
    lines_of = written(parts.groupBy("_file").agg(F.sum("_n").alias("_lines")), "files")
    files = order.prefix_sum(lines_of, "_file", F.col("_lines"), "_start").drop("_lines")
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    splits = written(parts.join(files, "_file").select("_split", "_first", "_n", before.alias("_before")), "splits")
    counted = splits.agg(F.count("*").alias("n"), F.count_distinct("_split").alias("different")).first()
    if counted.n != counted.different:
        raise ValueError("two file splits have one hash; read the files in two parts")
    changed = F.raise_error(F.lit("file splits changed between two reads")).cast("bigint")
    shift = F.lit(None).cast("bigint")
    lines = scan.drop("_file", "_block")
    for i in range(tables := max(1, -(-counted.n // SPLITS_PER_TABLE))):
        part = splits.filter(F.pmod("_split", F.lit(tables)) == i).select(
            F.col("_split").alias(f"_s{i}"),
            F.struct("_first", "_n", (F.col("_before") - F.col("_first")).alias("shift")).alias(f"_t{i}"),
        )
        lines = lines.join(F.broadcast(part), F.col("_split") == F.col(f"_s{i}"), "left")
        found = F.col(f"_t{i}")
        # A split's lines have consecutive ids; if they moved, some lie outside the place they had.
        inside = (F.col("_id") >= found["_first"]) & (F.col("_id") < found["_first"] + found["_n"])
        shift = F.coalesce(shift, F.when(inside, found["shift"]))
    return lines.select(
        (F.col("_id") + F.coalesce(shift, changed)).alias("line_no"), strip("value").alias("line")
    )


def read_csv_text(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True
) -> DataFrame:
    """Headed CSV whose cells may hold quotes, commas and line breaks.

    Here one file is one task, which suits small files, as ``write_csv_text`` makes them; large ones are
    read in splits by ``csv_splits.read_csv_splits``. For files that are known to have no line break
    inside a cell, ``multi_line=False`` lets large ones be split too. An empty cell is null, quoted or
    not; any other text, 'None' or 'NA' too, is data.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_jsonl(
    spark: SparkSession, path: str, schema: T.StructType, corrupt: str = "_corrupt"
) -> DataFrame:
    """One JSON object per line. The raw line stays as ``value``; a bad line is kept in ``corrupt``.

    A line is bad if it is not exactly one JSON object, or if a value does not fit the schema. Its
    fields are null.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = F.from_json("value", with_corrupt, {"columnNameOfCorruptRecord": corrupt, **STRICT})
    alone = single_json(F.col("value"), T.StructType([])).isNotNull()
    rows = once(spark.read.text(path), ["value"], _r=parsed, _alone=alone)
    good = F.col("_alone") & F.col(f"_r.`{corrupt}`").isNull()
    return rows.select(
        "value",
        *[F.when(good, F.col(f"_r.`{f.name}`")).alias(f.name) for f in schema.fields],
        F.when(~good, F.col("value")).alias(corrupt),
    )


def load_split(
    spark: SparkSession, base: str, name: str, split: str = "train", version: int | None = None
) -> DataFrame:
    """One split of a saved dataset, of its newest version or of one that is still kept.

    A folder without versions is read as it is.
    """
    root = f"{base}/{name}"
    number, content = versions.read(spark, root, version)
    if content is None and version is None:
        return spark.read.parquet(f"{root}/{split}")
    if not content or split not in content:
        raise ValueError(f"{root} has no split {split} in version {version or number}")
    return spark.read.parquet(*[f"{root}/{folder}" for folder in content[split]])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each whole file as one row of (path, text)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )
