"""Large CSV files with line breaks inside cells, read in many tasks.

A line begins a record if the number of quotes before it in its file is even; an escaped quote is two
quotes and changes nothing. Of each file split only the parity of its quotes matters for what follows, and
parities compose: one aggregation counts the quotes of each split, and a running exclusive or over the
splits of a file says whether a split begins inside a cell. Then each task walks its lines and puts records
together. What a split has of a record that began earlier, or that goes on in the next one, is put together
by a shuffle of these pieces alone. ``from_csv`` parses the records.

Files must be cut into the same splits in both readings; a line that lies in no known split raises.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.rows import once
from pairloom.operators.order import written

_OPTIONS = {
    "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}
_PIECES = "file string, start long, part long, text string, whole boolean, header boolean"
# Rows of one broadcast table of file splits. More splits take more such tables.
SPLITS_PER_TABLE = 500_000


def _scan(spark: SparkSession, path: str) -> DataFrame:
    # A carriage return belongs to a cell or to the line end; only the parser can tell.
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _splits(lines: DataFrame) -> DataFrame:
    """(file, block, inside): whether a file split begins inside a cell. A window holds one file's splits."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("file", "block", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1).alias("inside"))


def _marked(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """Lines with ``inside`` of their split. The tables are broadcast, so lines keep their order."""
    inside = F.lit(None).cast("boolean")
    for i in range(tables := max(1, -(-splits.count() // SPLITS_PER_TABLE))):
        part = splits.filter(F.pmod(F.xxhash64("file", "block"), F.lit(tables)) == i)
        part = part.withColumnRenamed("inside", f"inside{i}")
        lines = lines.join(F.broadcast(part), ["file", "block"], "left")
        inside = F.coalesce(inside, f"inside{i}")
    return lines.select("file", "block", "value", inside.alias("inside"))


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and pieces of those that cross the ends of a split.

    ``start`` is the split that a record began in, ``part`` the one that the text lies in; a piece at a
    split's beginning has no start.
    """
    fields = [
        ("file", pa.string()), ("start", pa.int64()), ("part", pa.int64()), ("text", pa.string()),
        ("whole", pa.bool_()), ("header", pa.bool_()),
    ]
    split, inside, held, first, head = None, False, [], False, False
    out: list[tuple] = []

    def emit() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], names=[n for n, _ in fields])
        out.clear()
        return batch

    for batch in batches:
        for file, block, value, begins_inside in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if (file, block) != split:
                if held:
                    out.append((split[0], None if head else split[1], split[1], "\n".join(held), False, first))
                if begins_inside is None:
                    raise ValueError("file splits changed between two reads")
                split, inside, held, head, first = (file, block), begins_inside, [], begins_inside, block == 0
            held.append(value)
            inside ^= value.count('"') % 2 == 1
            if not inside:
                text = "\n".join(held)
                out.append((file, None if head else block, block, text, not head, first))
                # Blank lines before the header are none.
                held, head, first = [], False, first and not text.strip("\r\ufeff")
        if len(out) >= 1024:
            yield emit()
    if held:
        out.append((split[0], None if head else split[1], split[1], "\n".join(held), False, first))
    if out:
        yield emit()


def read_csv_splits(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headed CSV whose cells may hold quotes, commas and line breaks, in as many tasks as it has splits.

    Cells are read as by ``read_csv_text``: an empty cell is null, any other text is data. The first record
    of each file is its header; blank lines between records are no records. Rows have no order.
    """
    lines = _scan(spark, path)
    pieces = _marked(lines, written(_splits(lines), "csv-splits")).mapInArrow(_records, _PIECES)
    pieces = written(pieces, "csv-records")
    # A piece at a split's beginning belongs to the record that was open before it. Two rows per split at most.
    at = ["part", F.col("start").isNotNull()]
    so_far = Window.partitionBy("file").orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    cut = pieces.filter(~F.col("whole")).withColumn("owner", F.last("start", ignorenulls=True).over(so_far))
    own = F.struct("part", F.col("start").isNotNull().alias("began"), "text")
    joined = cut.groupBy("file", "owner").agg(F.array_sort(F.collect_list(own)).alias("pieces"), F.bool_or("header").alias("header"))
    records = pieces.filter("whole").select("text", "header").unionByName(joined.select(F.array_join("pieces.text", "\n").alias("text"), "header"))
    records = records.filter(~F.col("header")).select(F.regexp_replace("text", r"\r$", "").alias("text")).filter("text <> ''")
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    return once(records, [], _record=F.from_csv("text", columns, _OPTIONS)).select("_record.*")
