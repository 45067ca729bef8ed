"""Vectors as byte strings, and rows of equal vectors folded."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import saved

# Query vectors that go through the index together.
BLOCK = 4096


def as_bytes(
    df: DataFrame, id_col: str, vec_col: str, change: Callable[[np.ndarray], np.ndarray] | None, zeros: bool
) -> tuple[DataFrame, int]:
    """(id, vec) with the vector as little-endian doubles, and the number of components.

    Rows with a null id, a null vector, or a null or non-finite component are left out, and with
    ``zeros=False`` vectors of zeros. Shorter vectors are filled up with zeros. ``change`` maps the
    components.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull())
    dims = rows.agg(F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("n")).first().n

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = [], []
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = vector.values.to_numpy(zero_copy_only=False).astype("<f8")
                if vector.values.null_count or not np.isfinite(values).all() or not (zeros or values.any()):
                    continue
                if change is not None:
                    values = change(values)
                ids.append(key)
                vecs.append(np.pad(values, (0, dims - len(values))).tobytes())
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "vec": pa.array(vecs, pa.binary())})

    return rows.mapInArrow(run, "id long, vec binary"), dims


def folded(rows: DataFrame, most: int) -> DataFrame:
    """(vec, ids): each different vector with its ``most`` smallest different ids.

    More are never wanted of one vector: equal vectors score alike, and the smaller ids go first. An id
    stands there once per row, up to ``most`` times. Rows fold map-side, and each task keeps that many ids
    before the shuffle, so a hot vector stays small.
    """
    each = rows.groupBy("vec", "id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = each.withColumn("rank", rank).filter(F.col("rank") <= most)
    copies = F.array_repeat("id", F.least("n", F.lit(most)).cast("int"))
    return saved(few.groupBy("vec").agg(F.sort_array(F.flatten(F.collect_list(copies))).alias("ids")), "vectors")


def query_rows(rows: DataFrame, every: int) -> DataFrame:
    """(query_id, vec, n_rows, own, hides, qid) of the different queries; each has ``n_rows`` rows.

    ``qid`` numbers what is searched: the different vectors, and apart from them each vector of an id with
    several rows. Such an id could fill a search with its own rows, so ``hides`` says that rows of the id
    ``own`` take no part in it.
    """
    queries = rows.filter(F.col("id") % every == 0).groupBy(F.col("id").alias("query_id"), "vec")
    queries = saved(queries.agg(F.count("*").alias("n_rows")), "query-rows")
    several = queries.groupBy(F.col("query_id").alias("i")).agg((F.sum("n_rows") > 1).alias("hides"))
    own = F.when(F.col("hides"), F.col("query_id")).otherwise(0).alias("own")
    queries = queries.join(several, F.col("query_id") == F.col("i")).select("query_id", "vec", "n_rows", own, "hides")
    numbers = queries.select(F.col("vec").alias("v"), F.col("own").alias("o"), F.col("hides").alias("h")).distinct()
    numbers = saved(numbers.withColumn("qid", F.monotonically_increasing_id()), "query-numbers")
    same = (F.col("vec") == F.col("v")) & (F.col("own") == F.col("o")) & (F.col("hides") == F.col("h"))
    return saved(queries.join(numbers, same).drop("v", "o", "h"), "queries")


def in_blocks(queries: DataFrame) -> DataFrame:
    """(qid, vec, own, hides) of what is searched, about ``BLOCK`` in a partition."""
    firsts = [F.first(name).alias(name) for name in ("vec", "own", "hides")]
    different = queries.groupBy("qid").agg(*firsts)
    n = queries.select("qid").distinct().count()
    return different.repartition(max(1, -(-n // BLOCK)))


def best_of_each(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of a query the k best that are not of its id.

    ``found`` has (qid, vec_id, score) with the k + 1 best rows of each qid, without those that it hides,
    and perhaps more.
    """
    order = [F.col("score").desc(), F.col("vec_id")]
    top = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    few = found.withColumn("top", top).filter(F.col("top") <= k + 1).drop("top")
    each = queries.select("query_id", F.col("qid").alias("q"), "n_rows").join(few, F.col("q") == F.col("qid"))
    rank = F.row_number().over(Window.partitionBy("query_id", "qid").orderBy(*order))
    return (
        each.filter(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows"))))
        .select("query_id", "rank", "vec_id", "score")
    )


def matrix(blobs, dims: int) -> np.ndarray:
    """Rows of doubles from byte strings, or from one that holds many."""
    data = blobs if isinstance(blobs, bytes) else b"".join(blobs)
    return np.frombuffer(data, "<f8").reshape(-1, dims)
