"""Approximate search for the largest inner products with a forest of hash prefixes.

Each tree gives a vector a string of ``BITS`` signs of random projections, and keeps its strings sorted:
vectors that share a prefix lie together. A query descends each tree to the longest prefix that it shares
with any string, and then ascends all trees at once, level by level, until the ranges that share a prefix
of that length hold ``candidates`` strings over all trees. These are scored on the original vectors.

Inner products become angles as for exact search: each vector gets one more component that brings it to
the largest norm, and queries get 0.

A tree is cut by the first ``b`` signs into about n / ``PAGE`` buckets, at most 2**12, and a bucket with
more than ``PAGE`` strings into pages. A page is one row with a sorted array, its vectors and ids, so that
a task holds one page and one block of queries at a time, however many strings share a prefix. The first
round counts, for each query and level, the strings of its own buckets; above level b counts come from
the bucket sizes, of which there are at most 2**12 per tree. The second round scores what the chosen
level covers, however much that is: no candidate is dropped. Scores of what is kept are summed in one
order for all pairs, so that equal products tie and reruns agree to the last bit.

How many candidates a recall needs depends on the data. Vectors without clusters, as independent random
ones, need ``share`` of all rows whatever the index; in clustered data ``share=0`` with a fixed
``candidates`` gives the usual sublinear search.

Rows with a null id, or with a vector that is null, zero, or has a null or non-finite component, take no
part; shorter vectors are filled up with zeros. Equal vectors are folded to their k + 1 smallest different
ids. Ties go to the smaller id. Empty table: no rows. Repeated ids are rows of their own, as results and
as queries, each of which gets k results; but none is a result for a query of its id.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import saved, small_batches
from pairloom.llm.mtree import lifted
from pairloom.llm.vectors import as_bytes, best_of_each, folded, in_blocks, matrix, query_rows

TREES = 20
BITS = 30
PAGE = 2048
MAX_TOP = 12
SHARE = 1.0
CANDIDATES = 2000
SEED = 20240


def projections(trees: int, dims: int, seed: int = SEED) -> np.ndarray:
    """trees x dims x BITS; the directions of a tree are orthogonal as far as there are dimensions."""
    rng = np.random.default_rng(seed)
    out = np.empty((trees, dims, BITS))
    for tree in range(trees):
        for begin in range(0, BITS, dims):
            square = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
            out[tree, :, begin : begin + dims] = square[:, : BITS - begin]
    return out


def strings(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The hash string of each vector as a number, first sign highest."""
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    return ((vectors @ directions) > 0) @ weights


def shared(page: np.ndarray, strings_: np.ndarray, level: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of a sorted array that shares the first ``level`` signs with each string."""
    low = (strings_ >> (BITS - level)) << (BITS - level)
    high = low + (np.int64(1) << (BITS - level))
    return np.searchsorted(page, low), np.searchsorted(page, high)


def search(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    every: int = 20,
    k: int = 20,
    trees: int = TREES,
    share: float = SHARE,
    candidates: int = CANDIDATES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every`` its k nearest found.

    Ascending ends when the trees' ranges hold ``candidates`` strings, or ``share`` times the number of
    vectors if that is more; a vector counts once for each tree that gives it.
    """
    spark = df.sparkSession
    rows, dims = as_bytes(df, id_col, vec_col, None, zeros=False)
    # From here on in a session of its own, as pages are rows of half a megabyte.
    rows = saved(rows, "forest-rows", small_batches(spark))
    points = folded(rows, k + 1)
    queries = query_rows(rows, every)
    n = points.count()
    wanted = max(candidates, int(share * n))
    top = min(MAX_TOP, max(0, int(math.log2(max(1, n) / PAGE)))) if n > PAGE else 0

    def norms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column(0).to_pylist(), dims)
            if len(vectors):
                yield pa.RecordBatch.from_pydict({"norm": [float(np.einsum("ij,ij->i", vectors, vectors).max())]})

    # Vectors of floats stay floats in the forest, at half the size.
    floats = df.schema[vec_col].dataType.simpleString() == "array<float>"
    stored = "<f4" if floats else "<f8"

    most = points.select("vec").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0] or 0.0

    def planted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector with its string in each tree."""
        directions = projections(trees, dims + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                vectors = matrix(some.column(0).to_pylist(), dims)
                high = lifted(vectors, most)
                vecs = pa.array([row.tobytes() for row in vectors.astype(stored)], pa.binary())
                for tree in range(trees):
                    found = strings(high, directions[tree])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(found), tree, np.int32)),
                            pa.array((found >> (BITS - top)).astype(np.int32)),
                            pa.array(found),
                            vecs,
                            some.column(1),
                        ],
                        names=["tree", "bucket", "string", "vec", "ids"],
                    )

    leaves = points.mapInArrow(planted, "tree int, bucket int, string long, vec binary, ids array<long>")
    sizes = saved(leaves.groupBy("tree", "bucket").agg(F.count("*").alias("n")), "forest-sizes")
    # Tells vectors of one id apart.
    key = F.xxhash64("vec").alias("key")
    paged = leaves.join(
        sizes.select(F.col("tree").alias("t"), F.col("bucket").alias("b"), F.ceil(F.col("n") / PAGE).alias("pages")),
        (F.col("tree") == F.col("t")) & (F.col("bucket") == F.col("b")),
    ).select("tree", "bucket", F.pmod(F.xxhash64("vec"), F.col("pages")).alias("page"), "string", "vec", "ids", key)

    def page(table: pa.Table) -> pa.Table:
        found = table["string"].to_numpy()
        order = np.argsort(found, kind="stable")
        vecs, ids = table["vec"].to_pylist(), table["ids"].to_pylist()
        return pa.table(
            {
                "tree": table["tree"][:1],
                "bucket": table["bucket"][:1],
                "strings": [found[order].tobytes()],
                "vecs": [b"".join(vecs[i] for i in order.tolist())],
                "keys": [table["key"].to_numpy()[order].tobytes()],
                "ids": [np.array([x for i in order.tolist() for x in ids[i]], np.int64).tobytes()],
                "id_counts": [np.array([len(ids[i]) for i in order.tolist()], np.int64).tobytes()],
            }
        )

    pages = paged.groupBy("tree", "bucket", "page").applyInArrow(
        page, "tree int, bucket int, strings binary, vecs binary, keys binary, ids binary, id_counts binary"
    )
    pages = saved(pages, "forest-pages")
    # At most trees x 2**MAX_TOP numbers.
    bucket_sizes = np.zeros((trees, 1 << top), np.int64)
    for row in sizes.collect():
        bucket_sizes[row.tree, row.bucket] = row.n
    shared_sizes = spark.sparkContext.broadcast(bucket_sizes)

    def descend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Deal queries to their own bucket in each tree, in blocks."""
        directions = projections(trees, dims + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            qids = batch.column(0).to_numpy()
            vectors = matrix(batch.column(1).to_pylist(), dims)
            flat = np.hstack([vectors, np.zeros((len(vectors), 1))])
            for tree in range(trees):
                found = strings(flat, directions[tree])
                buckets = found >> (BITS - top)
                for bucket in np.unique(buckets).tolist():
                    who = buckets == bucket
                    yield pa.RecordBatch.from_pydict(
                        {
                            "tree": pa.array([tree], pa.int32()),
                            "bucket": pa.array([bucket], pa.int32()),
                            "qids": [qids[who].tobytes()],
                            "qstrings": [found[who].tobytes()],
                        }
                    )

    levels = list(range(top, BITS + 1))

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many strings of a page share each level with each query of a block."""
        for batch in batches:
            for i in range(batch.num_rows):
                page = np.frombuffer(batch.column("strings")[i].as_py(), np.int64)
                qids = np.frombuffer(batch.column("qids")[i].as_py(), np.int64)
                found = np.frombuffer(batch.column("qstrings")[i].as_py(), np.int64)
                out = {"qid": qids}
                for level in levels:
                    begin, end = shared(page, found, level)
                    out[f"l{level}"] = end - begin
                yield pa.RecordBatch.from_pydict(out)

    different = in_blocks(queries)
    counts_schema = "qid long, " + ", ".join(f"l{level} long" for level in levels)
    counts = (
        different.mapInArrow(descend, "tree int, bucket int, qids binary, qstrings binary")
        .join(pages.select("tree", "bucket", "strings"), ["tree", "bucket"])
        .mapInArrow(counted, counts_schema)
        .groupBy(F.col("qid").alias("q"))
        .agg(*[F.sum(f"l{level}").alias(f"l{level}") for level in levels])
    )
    deepest = F.greatest(*[F.when(F.col(f"l{level}") >= wanted, level).otherwise(-1) for level in levels], F.lit(-1))
    placed = different.join(counts, F.col("qid") == F.col("q"), "left").select(
        "qid", "vec", F.coalesce(deepest, F.lit(-1)).cast("int").alias("level"), "own", "hides"
    )

    def ascend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Deal queries to all buckets that their level covers."""
        directions = projections(trees, dims + 1)
        totals = shared_sizes.value
        for batch in batches:
            if not batch.num_rows:
                continue
            qids = batch.column(0).to_numpy()
            vectors = matrix(batch.column(1).to_pylist(), dims)
            level = batch.column(2).to_numpy().astype(np.int64)
            owns, hides = batch.column("own").to_numpy(), batch.column("hides").to_numpy(zero_copy_only=False)
            flat = np.hstack([vectors, np.zeros((len(vectors), 1))])
            found = np.array([strings(flat, directions[tree]) for tree in range(trees)])
            buckets = found >> (BITS - top)
            # Above the buckets, level by level, until there are enough; at the root there is everything.
            for up in range(top - 1, -1, -1):
                lacking = level < 0
                if not lacking.any():
                    break
                sums = totals.reshape(trees, 1 << up, -1).sum(axis=2)
                have = sums[np.arange(trees)[:, None], buckets >> (top - up)].sum(axis=0)
                level = np.where(lacking & ((have >= wanted) | (up == 0)), up, level)
            level = np.maximum(level, 0)
            for tree in range(trees):
                for bucket in range(1 << top):
                    over = np.maximum(top - level, 0)
                    who = (buckets[tree] >> over) == (bucket >> over)
                    if tree:
                        who &= level > 0  # the root of one tree has everything
                    if who.any() and totals[tree, bucket]:
                        yield pa.RecordBatch.from_pydict(
                            {
                                "tree": pa.array([tree], pa.int32()),
                                "bucket": pa.array([bucket], pa.int32()),
                                "qids": [qids[who].tobytes()],
                                "qstrings": [found[tree][who].tobytes()],
                                "levels": [level[who].tobytes()],
                                "qvecs": [vectors[who].tobytes()],
                                "owns": [owns[who].tobytes()],
                                "hides": [hides[who].tobytes()],
                            }
                        )

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k + 1 best of a page for each query of a block, among those that share its level."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                page = np.frombuffer(row["strings"], np.int64)
                vecs, qvecs = np.frombuffer(row["vecs"], stored).reshape(-1, dims), matrix(row["qvecs"], dims)
                vecs = vecs.astype(np.float64)
                counts = np.frombuffer(row["id_counts"], np.int64)
                ids, point = np.frombuffer(row["ids"], np.int64), np.repeat(np.arange(len(counts)), counts)
                keys = np.frombuffer(row["keys"], np.int64)[point]
                # Rows of one id and vector lie together; the how-maniest each is.
                place = np.arange(len(ids))
                new = np.append(True, (point[1:] != point[:-1]) | (ids[1:] != ids[:-1]))
                copies = place - np.maximum.accumulate(np.where(new, place, 0))
                qids = np.frombuffer(row["qids"], np.int64)
                owns, hides = np.frombuffer(row["owns"], np.int64), np.frombuffer(row["hides"], bool)
                begins, ends = shared(
                    page, np.frombuffer(row["qstrings"], np.int64), np.frombuffer(row["levels"], np.int64)
                )
                first = np.searchsorted(point, begins), np.searchsorted(point, ends)
                out: dict[str, list] = {"qid": [], "vec_id": [], "key": [], "copy": [], "score": []}
                for at in range(0, len(qids), 256):
                    scores = qvecs[at : at + 256] @ vecs.T
                    for j in range(len(scores)):
                        rows_ = np.arange(first[0][at + j], first[1][at + j])
                        if hides[at + j]:
                            rows_ = rows_[ids[rows_] != owns[at + j]]
                        if not len(rows_):
                            continue
                        own = scores[j][point[rows_]]
                        if len(own) > k + 1:
                            # A product over blocks may be off by this much.
                            off = 4 * dims * np.finfo(float).eps * math.sqrt(most * float(qvecs[at + j] @ qvecs[at + j]))
                            least = np.partition(own, len(own) - k - 1)[len(own) - k - 1]
                            rows_ = rows_[own >= least - off]
                        # One order of summation for all, so that equal products tie and reruns agree.
                        own = (vecs[point[rows_]] * qvecs[at + j]).sum(axis=1)
                        order = np.lexsort((ids[rows_], -own))[: k + 1]
                        rows_ = rows_[order]
                        out["qid"].append(np.full(len(order), qids[at + j]))
                        out["vec_id"].append(ids[rows_])
                        out["key"].append(keys[rows_])
                        out["copy"].append(copies[rows_])
                        out["score"].append(own[order])
                if out["qid"]:
                    yield pa.RecordBatch.from_pydict({name: np.concatenate(v) for name, v in out.items()})

    dealt = placed.mapInArrow(
        ascend, "tree int, bucket int, qids binary, qstrings binary, levels binary, qvecs binary, owns binary, hides binary"
    )
    found = dealt.join(pages, ["tree", "bucket"]).mapInArrow(
        scored, "qid long, vec_id long, key long, copy long, score double"
    )
    # A row that several trees give counts once.
    once = found.groupBy("qid", "vec_id", "key", "copy").agg(F.max("score").alias("score"))
    return saved(best_of_each(queries, once, k), "forest-found", spark)
