"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.session import scratch_dir

# Copies of one row that one task writes out in a row.
COPIES_PER_CHUNK = 4096
# Rows of an Arrow batch that are Python objects at the same time.
ROWS_AT_ONCE = 512
# White space that ends a word: the space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def saved(df: DataFrame, label: str, session: SparkSession | None = None, **options: str | int) -> DataFrame:
    """Write to the shared folder and read from there, if wanted with another session.

    That cuts lineage, and outlives executors.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.options(**options).parquet(path)
    return (session or spark).read.schema(df.schema).parquet(path)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def arrow_bytes(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """While this lasts, jobs that the session begins hand Python fewer bytes at a time."""
    before = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, before)


def small_batches(spark: SparkSession, size: str = "4m") -> SparkSession:
    """A session like the given one that hands Python fewer bytes at a time, for rows of large blobs."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and session.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set(ARROW_BYTES, size)
    return session


def parts_of(text: str, size: int, marks: str = " \n") -> Iterator[str]:
    """A text in parts of about ``size`` characters, so that a very long one takes bounded memory.

    Parts end before one of the marks, which is left out, if there is one; put together with marks
    they are the text again.
    """
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(mark, at, at + size) for mark in marks)
        if end < at:
            later = [found for mark in marks if (found := text.find(mark, at + size)) >= 0]
            if not later:
                break
            end = min(later)
        yield text[at:end]
        at = end + 1
    yield text[at:] if at else text


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(column: str | Column) -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("bigint")


def one_per_copy(df: DataFrame, copies: str, index: str) -> DataFrame:
    """Repeat each row ``copies`` times, numbered from 0 in column ``index``.

    A row with very many copies is first cut into chunks that are dealt over all tasks.
    """
    chunks = df.withColumn(
        index, F.explode(F.expr(f"sequence(0L, (`{copies}` - 1) div {COPIES_PER_CHUNK})"))
    )
    dealt = chunks.repartition(F.xxhash64(*[c for c in chunks.columns]))
    last = F.least(F.col(copies), (F.col(index) + 1) * COPIES_PER_CHUNK) - 1
    return dealt.withColumn(index, F.explode(F.sequence(F.col(index) * COPIES_PER_CHUNK, last)))


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    schema: T.StructType,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Run a function of column lists over each Arrow batch. ``make`` is called once per task.

    ``carry`` names columns that are passed on as they are.
    """
    schema = T.StructType([*[df.schema[name] for name in carry], *schema.fields])
    arrow = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            names = batch.schema.names
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(names) if n not in carry}
            out = function(columns)
            arrays = [
                batch.column(field.name).cast(field.type)
                if field.name in carry
                else pa.array(out[field.name], field.type)
                for field in arrow
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_type(data_type: T.DataType) -> pa.DataType:
    if isinstance(data_type, T.ArrayType):
        return pa.list_(_arrow_type(data_type.elementType))
    simple = {
        "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
        "binary": pa.binary(), "boolean": pa.bool_(), "smallint": pa.int16(), "float": pa.float32(),
    }
    return simple[data_type.simpleString()]


def field(df: DataFrame, column: str, name: str | None = None) -> T.StructField:
    """A field of an output schema with the type that the column has in ``df``."""
    return T.StructField(name or column, df.schema[column].dataType)
