"""Exact search for the largest inner products with an M-tree.

Inner products become distances: with M the largest norm, each vector x gets one more component
sqrt(M^2 - |x|^2), a query q gets 0, and the squared distance is |q|^2 + M^2 - 2 q.x. The nearest
vectors are those with the largest product.

The tree has three levels. The root holds about sqrt(n) routing vectors. Each vector belongs to the
nearest of them; a routing vector with too many is split into nodes that share it. A node is one row:
it is paged around routing vectors of its own, and keeps covering radii, and each entry's distance to its
parent. Search is best first in two rounds. In the first a query goes to the node with the least lower
bound, and gets a k-th best score. In the second it goes to the nodes that the covering radius cannot
rule out at that score. Within a node, pages are visited in the order of their bounds; a page is ruled out
by distances stored for its parent before its own distance is computed, and entries likewise.

Nodes are put into groups of about ``GROUP_BYTES``. In each round a query travels once to each group that has a
node for it, in blocks, as rows of bytes, and meets the nodes of the group there; neither side is broadcast. The
driver and each task hold the root, which grows with the square root of n, and a task one group and one block
at a time. The routing vectors are the first by hash; tasks send the driver those below a cut, about as many as
are wanted from all of them together. Bounds have slack for rounding; scores are exact: whole-number products in doubles as long as they stay below
2**53, in Python's numbers beyond (then held within the range of a long).

Rows with a null id, a null vector, or a null or non-finite component take no part; shorter vectors are
filled up with zeros. Equal vectors are folded to their k + 1 smallest different ids. Ties go to the
smaller id. Empty table: no rows. Repeated ids are rows of their own, as results and as queries, each of
which gets k results; but none is a result for a query of its id.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import arrow_bytes, saved
from pairloom.llm.vectors import as_bytes, best_of_each, folded, in_blocks, matrix, query_rows

PAGE = 64
SLACK = 1e-7
# Bytes of nodes that a task holds.
GROUP_BYTES = 64 << 20
_LONG = 2**63 - 2


def scaled(values: np.ndarray) -> np.ndarray:
    """Components as whole numbers of 1/256."""
    return np.floor(256.0 * values)


def lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    """With the component that makes distances of inner products; ``most`` is the largest squared norm."""
    rest = np.sqrt(np.maximum(0.0, most - np.einsum("ij,ij->i", vectors, vectors)))
    return np.hstack([vectors, rest[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, squares))


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Whole-number inner products."""
    if not len(vectors):
        return np.zeros(0, np.int64)
    if np.abs(vectors).max() * max(1.0, np.abs(query).max()) * len(query) < 2.0**53:
        return (vectors @ query).astype(np.int64)
    whole = [int(x) for x in query.tolist()]
    sums = (sum(int(a) * b for a, b in zip(row, whole)) for row in vectors.tolist())
    return np.array([max(-_LONG, min(_LONG, s)) for s in sums], np.int64)


_NONE = np.iinfo(np.int64).min + 1


def _reach(floors: np.ndarray, norms: np.ndarray, most: float) -> np.ndarray:
    """The distance at which each query's score falls to its floor; without a floor, any distance."""
    squares = norms + most - 2.0 * floors.astype(np.float64)
    reach = np.sqrt(np.maximum(0.0, squares)) + SLACK * (np.sqrt(norms) + math.sqrt(most))
    return np.where(floors == _NONE, np.inf, reach)


def _node(table: pa.Table, routes: np.ndarray, most: float, dims: int) -> dict:
    """One node: pages of entries that lie together."""
    vectors = lifted(matrix(table["vec"].to_pylist(), dims), most)
    ids = table["ids"].to_pylist()
    centre = lifted(routes[table["route"][0].as_py()][None, :], most)
    to_centre = _distances(vectors, centre)[:, 0]
    # Page routing vectors: the entries at evenly spaced distances from the node's own.
    n_pages = -(-len(vectors) // PAGE)
    chosen = np.argsort(to_centre, kind="stable")[:: max(1, len(vectors) // n_pages)][:n_pages]
    to_pages = _distances(vectors, vectors[chosen])
    page = to_pages.argmin(axis=1)
    order = np.argsort(page, kind="stable")
    distance = to_pages[np.arange(len(vectors)), page]
    sizes = np.bincount(page, minlength=len(chosen))
    radii = np.zeros(len(chosen))
    np.maximum.at(radii, page, distance)
    return {
        "radius": float(to_centre.max()),
        "n": len(vectors),
        "vectors": vectors[order].tobytes(),
        "ids": np.array([i for row in order.tolist() for i in ids[row]], np.int64).tobytes(),
        "id_counts": np.array([len(ids[row]) for row in order.tolist()], np.int64).tobytes(),
        "distance": distance[order].tobytes(),
        "page_sizes": sizes.astype(np.int64).tobytes(),
        "page_radius": radii.tobytes(),
        "page_vector": vectors[chosen].tobytes(),
        "page_distance": to_centre[chosen].tobytes(),
    }


_BLOBS = "vectors ids id_counts distance page_sizes page_radius page_vector page_distance".split()
_NODE = "route int, part long, radius double, n long, " + ", ".join(f"{name} binary" for name in _BLOBS)


def _scores(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Whole-number inner products, queries by vectors."""
    if np.abs(vectors).max() * max(1.0, np.abs(queries).max()) * queries.shape[1] < 2.0**53:
        return (queries @ vectors.T).astype(np.int64)
    return np.stack([products(vectors, query) for query in queries])


def _search(
    node: dict, centre: np.ndarray, queries: np.ndarray, floors: np.ndarray, hidden: np.ndarray, hides: np.ndarray,
    k: int, most: float,
):
    """(scores, ids) of the k best in a node, one row per query of a block; id -1 where there are fewer.

    Scores below a query's floor do not count. Where ``hides`` is true, rows of the query's ``hidden`` id do not count.
    Every query goes through the pages in its own order. In each round, the queries whose next page is
    the same are scored together.
    """
    dims = queries.shape[1]
    vectors = np.frombuffer(node["vectors"]).reshape(-1, dims + 1)
    counts = np.frombuffer(node["id_counts"], np.int64)
    ids, entry_of = np.frombuffer(node["ids"], np.int64), np.repeat(np.arange(len(counts)), counts)
    distance = np.frombuffer(node["distance"])
    page_ends = np.cumsum(np.frombuffer(node["page_sizes"], np.int64))
    page_begins = np.concatenate([[0], page_ends[:-1]])
    page_radius = np.frombuffer(node["page_radius"])
    page_vector = np.frombuffer(node["page_vector"]).reshape(-1, dims + 1)
    page_distance = np.frombuffer(node["page_distance"])
    norms = np.einsum("ij,ij->i", queries, queries)
    floors = floors.copy()
    reach = _reach(floors, norms, most)
    best = np.full((len(queries), k), _NONE)
    best_ids = np.full((len(queries), k), -1, np.int64)
    flat = np.hstack([queries, np.zeros((len(queries), 1))])
    to_centre = _distances(flat, centre[None, :])
    # What the parent's distances leave of the pages, before any of their own is computed.
    open_pages = np.abs(to_centre - page_distance) - page_radius <= reach[:, None]
    who, which = np.flatnonzero(open_pages.any(axis=1)), np.flatnonzero(open_pages.any(axis=0))
    if not len(who):
        return best, best_ids
    to_page = np.full(open_pages.shape, np.inf)
    to_page[np.ix_(who, which)] = _distances(flat[who], page_vector[which])
    bounds = np.where(open_pages, to_page - page_radius, np.inf)
    order = np.argsort(bounds, axis=1, kind="stable")
    for turn in range(bounds.shape[1]):
        page = order[:, turn]
        bound = bounds[np.arange(len(queries)), page]
        waiting = np.isfinite(bound) & (bound <= reach)
        if not waiting.any():
            break  # bounds only grow from turn to turn
        for p in np.unique(page[waiting]).tolist():
            some = np.flatnonzero(waiting & (page == p))
            begin, end = page_begins[p], page_ends[p]
            near = np.abs(to_page[some, p][:, None] - distance[None, begin:end]) <= reach[some][:, None]
            wanted = np.flatnonzero(near.any(axis=0)) + begin
            if not len(wanted):
                continue
            found = _scores(vectors[wanted, :dims], queries[some])
            # One column per id of each entry.
            first, last = np.searchsorted(entry_of, wanted), np.searchsorted(entry_of, wanted, "right")
            column = np.repeat(np.arange(len(wanted)), last - first)
            own = np.concatenate([ids[a:b] for a, b in zip(first.tolist(), last.tolist())])
            found = found[:, column]
            found[hides[some][:, None] & (own[None, :] == hidden[some][:, None])] = _NONE
            wins = (found >= floors[some][:, None]) & (found != _NONE)
            some, found, own = some[wins.any(axis=1)], found[wins.any(axis=1)][:, wins.any(axis=0)], own[wins.any(axis=0)]
            if not len(some):
                continue
            all_scores = np.hstack([best[some], found])
            all_ids = np.hstack([best_ids[some], np.broadcast_to(own, (len(some), len(own)))])
            top = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best[some] = np.take_along_axis(all_scores, top, axis=1)
            best_ids[some] = np.take_along_axis(all_ids, top, axis=1)
            floors[some] = np.maximum(floors[some], best[some, -1])
            reach[some] = _reach(floors[some], norms[some], most)
    return best, best_ids


def _first_by_hash(points: DataFrame, wanted: int, n: int) -> list:
    """The ``wanted`` first of ``n`` different vectors, by hash.

    Each task would send as many as are wanted; so those above a cut, which few of the wanted reach, stay where
    they are.
    """
    most = wanted + 8 * math.isqrt(wanted) + 16
    while True:
        cut = min(2**63 - 1, 2**64 * most // n - 2**63)
        below = points.select("vec").filter(F.xxhash64("vec") <= F.lit(cut))
        chosen = below.orderBy(F.xxhash64("vec"), "vec").limit(wanted).collect()
        if len(chosen) == wanted or cut == 2**63 - 1:
            return chosen
        most *= 2


def search(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every`` its k highest scores.

    The score is the inner product of the components as whole numbers of 1/256.
    """
    spark = df.sparkSession
    rows, dims = as_bytes(df, id_col, vec_col, scaled, zeros=True)
    rows = saved(rows, "mtree-rows")
    points = folded(rows, k + 1)
    queries = query_rows(rows, every)
    n = points.count()
    if not n or not dims:
        return best_of_each(queries, _no_results(queries), k) if dims else _all_equal(rows, queries, k)
    n_routes = math.isqrt(n - 1) + 1

    def norms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column(0).to_pylist(), dims)
            if len(vectors):
                yield pa.RecordBatch.from_pydict({"norm": [float(np.einsum("ij,ij->i", vectors, vectors).max())]})

    most = points.select("vec").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0]
    # About sqrt(n) routing vectors; so many rows come to the driver.
    chosen = _first_by_hash(points, n_routes, n)
    routes = spark.sparkContext.broadcast(matrix([bytes(r.vec) for r in chosen], dims).copy())

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = lifted(routes.value, most)
        for batch in batches:
            if batch.num_rows:
                vectors = lifted(matrix(batch.column(0).to_pylist(), dims), most)
                near = np.concatenate(
                    [_distances(vectors[i : i + 512], around).argmin(axis=1) for i in range(0, len(vectors), 512)]
                )
                yield batch.append_column("route", pa.array(near.astype(np.int32)))

    assigned = saved(points.mapInArrow(assign, "vec binary, ids array<long>, route int"), "mtree-assigned")
    counts = assigned.groupBy(F.col("route").alias("r")).agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / max(1024, 2 * n_routes))
    split = assigned.join(counts, F.col("route") == F.col("r")).select(
        "route", F.pmod(F.xxhash64("vec"), parts).alias("part"), "vec", "ids"
    )

    def build(table: pa.Table) -> pa.Table:
        node = _node(table, routes.value, most, dims)
        head = {"route": [table["route"][0].as_py()], "part": [table["part"][0].as_py()]}
        return pa.table({**{c: pa.array(v, t) for (c, v), t in zip(head.items(), (pa.int32(), pa.int64()))},
                         **{c: [v] for c, v in node.items()}})

    nodes = saved(split.groupBy("route", "part").applyInArrow(build, _NODE), "mtree-nodes")
    # About sqrt(n) rows of four numbers. Nodes are numbered, those of near routing vectors one after another.
    directory = nodes.select("route", "part", "radius", "n").collect()
    around = lifted(routes.value, most)
    outward = _distances(around, around[:1])[:, 0]
    directory.sort(key=lambda r: (outward[r.route], r.route, r.part))
    ends = np.cumsum([r.n for r in directory])
    n_groups = max(spark.sparkContext.defaultParallelism, -(-int(ends[-1]) * 8 * (dims + 4) // GROUP_BYTES))
    # By the vectors before the middle of each node.
    middles = ends - np.array([r.n for r in directory]) / 2
    of_group = np.unique((middles * n_groups / ends[-1]).astype(np.int64), return_inverse=True)[1]
    n_groups, n_nodes = int(of_group.max()) + 1, len(directory)
    root = spark.sparkContext.broadcast(
        (np.array([r.route for r in directory]), np.array([r.radius for r in directory]), of_group)
    )
    numbers = [(r.route, r.part, i, int(of_group[i])) for i, r in enumerate(directory)]
    numbers = spark.createDataFrame(numbers, "route int, part long, number int, to int")
    in_groups = nodes.join(F.broadcast(numbers), ["route", "part"]).select("to", "number", F.array(*_BLOBS).alias("blobs"))

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """With the node that has the least lower bound."""
        route, radius, _ = root.value
        centres = lifted(routes.value, most)[route]
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column(1).to_pylist(), dims)
                flat = np.hstack([vectors, np.zeros((len(vectors), 1))])
                first = [(_distances(flat[i : i + 512], centres) - radius).argmin(axis=1) for i in range(0, len(flat), 512)]
                yield batch.append_column("first", pa.array(np.concatenate(first).astype(np.int32)))

    def deal(first_round: bool):
        """Deal each batch of queries to groups: one row per group, with the queries that go there."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            route, radius, group = root.value
            centres, begins = lifted(routes.value, most)[route], np.searchsorted(group, np.arange(n_groups))
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    some = batch.slice(at, 1024)
                    qids, floors, owns, firsts = (some.column(c).to_numpy() for c in ("qid", "floor", "own", "first"))
                    hides = some.column("hides").to_numpy(zero_copy_only=False)
                    vectors = matrix(some.column("vec").to_pylist(), dims)
                    if first_round:
                        goes = group[firsts][:, None] == np.arange(n_groups)[None, :]
                    else:
                        flat = np.hstack([vectors, np.zeros((len(vectors), 1))])
                        reach = _reach(floors, np.einsum("ij,ij->i", vectors, vectors), most)
                        opens = _distances(flat, centres) - radius <= reach[:, None]
                        opens[np.arange(len(firsts)), firsts] = False
                        goes = np.logical_or.reduceat(opens, begins, axis=1)
                    for to in np.flatnonzero(goes.any(axis=0)).tolist():
                        who = np.flatnonzero(goes[:, to])
                        blobs = [c[who].tobytes() for c in (qids, vectors, floors, owns, hides, firsts)]
                        # After the nodes, whose numbers are smaller.
                        yield pa.RecordBatch.from_pydict(
                            {"to": pa.array([to], pa.int32()), "number": pa.array([n_nodes], pa.int32()),
                             "blobs": pa.array([blobs], pa.list_(pa.binary()))}
                        )

        return run

    def visit(first_round: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            route, radius, _ = root.value
            centres = lifted(routes.value, most)[route]
            at, held = None, {}
            for batch in batches:
                for i in range(batch.num_rows):
                    to, number, blobs = (batch.column(c)[i].as_py() for c in ("to", "number", "blobs"))
                    if to != at:
                        at, held = to, {}
                    if number < n_nodes:
                        held[number] = dict(zip(_BLOBS, blobs))
                        continue
                    qids, floors, owns = (np.frombuffer(blobs[c], np.int64) for c in (0, 2, 3))
                    queries_, hides, firsts = matrix(blobs[1], dims), np.frombuffer(blobs[4], bool), np.frombuffer(blobs[5], np.int32)
                    flat = np.hstack([queries_, np.zeros((len(queries_), 1))])
                    norms, floors = np.einsum("ij,ij->i", queries_, queries_), floors.copy()
                    best, best_ids = np.full((len(qids), k + 1), _NONE), np.full((len(qids), k + 1), -1, np.int64)
                    for number, node in held.items():
                        centre = centres[number]
                        goes = firsts == number
                        if not first_round:
                            goes = ~goes & (_distances(flat, centre[None, :])[:, 0] - radius[number] <= _reach(floors, norms, most))
                        who = np.flatnonzero(goes)
                        if not len(who):
                            continue
                        found = _search(node, centre, queries_[who], floors[who], owns[who], hides[who], k + 1, most)
                        scores, ids = (np.hstack([a[who], b]) for a, b in zip((best, best_ids), found))
                        top = np.lexsort((ids, -scores), axis=1)[:, : k + 1]
                        best[who], best_ids[who] = np.take_along_axis(scores, top, axis=1), np.take_along_axis(ids, top, axis=1)
                        floors = np.maximum(floors, best[:, -1])
                    real = best != _NONE
                    yield pa.RecordBatch.from_pydict(
                        {"qid": np.repeat(qids, real.sum(axis=1)), "vec_id": best_ids[real], "score": best[real]}
                    )

        return run

    def visited(questions: DataFrame, first_round: bool) -> DataFrame:
        dealt = questions.mapInArrow(deal(first_round), "to int, number int, blobs array<binary>")
        met = in_groups.unionByName(dealt).repartitionById(n_groups, F.col("to")).sortWithinPartitions("to", "number")
        found = met.mapInArrow(visit(first_round), "qid long, vec_id long, score long")
        with arrow_bytes(spark):
            return saved(found, "mtree-found")

    different = in_blocks(queries).mapInArrow(nearest, "qid long, vec binary, own long, hides boolean, first int")
    different = saved(different, "mtree-queries")
    asked = different.withColumn("floor", F.lit(int(_NONE)).cast("bigint"))
    first = visited(asked, True)
    floors = first.groupBy(F.col("qid").alias("q")).agg(F.count("*").alias("n"), F.min("score").alias("floor"))
    with_floor = different.join(floors, F.col("qid") == F.col("q"), "left").select(
        *different.columns, F.when(F.col("n") > k, F.col("floor")).otherwise(int(_NONE)).alias("floor")
    )
    return best_of_each(queries, first.unionByName(visited(with_floor, False)), k)


def _no_results(queries: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return queries.limit(0).select("qid", zero.alias("vec_id"), zero.alias("score"))


def _all_equal(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Vectors without components all score 0."""
    few = folded(rows, k + 1).select(F.explode("ids").alias("vec_id"))
    zero = F.lit(0).cast("bigint").alias("score")
    pairs = queries.select("qid", "own", "hides").distinct().join(F.broadcast(few))
    shown = ~(F.col("hides") & (F.col("own") == F.col("vec_id")))
    return best_of_each(queries, pairs.filter(shown).select("qid", "vec_id", zero), k)
