"""SimHash, components, exact and approximate search."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from pairloom.llm import hash_forest, mtree, simhash
from pairloom.llm.components import components
from pairloom.operators import joins


def naive_classes(items: list, linked) -> dict:
    """Item to the smallest item that it can reach."""
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if linked(a, b):
                a_root, b_root = find(a), find(b)
                root[max(a_root, b_root)] = min(a_root, b_root)
    return {x: find(x) for x in items}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (300, 200), (200, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {200: 200, 300: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most_rows", [joins.MOST_ROWS, 50])
def test_components_of_a_star(spark, monkeypatch, most_rows):
    """A hub of 100,000 links, next to chains: its links are looked up where they are."""
    monkeypatch.setattr(joins.lookup, "__defaults__", ("inner", most_rows))
    hub = spark.range(100_000).select(F.lit(5).cast("bigint").alias("a"), (F.col("id") + 10).alias("b"))
    chain = spark.range(20).select((F.col("id") + 200_000).alias("a"), (F.col("id") + 200_001).alias("b"))
    found = components(hub.unionByName(chain))
    assert found.filter("node < 200000").agg(F.count("*"), F.min("root"), F.max("root")).first() == (100_001, 5, 5)
    assert {tuple(r) for r in found.filter("node >= 200000").collect()} == {(200_000 + i, 200_000) for i in range(21)}


def naive_print(text: str | None) -> int:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAbÉé \t\n\x0b\x1c 日", max_size=80))
def test_fingerprints_of_anything(text):
    assert simhash.fingerprint(text) == naive_print(text)


def test_fingerprints_over_blocks(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["one", "two", "three", "x" * 40]) for _ in range(500))
    want = naive_print(text)
    for size in (1, 50, 1000):
        monkeypatch.setattr(simhash, "BLOCK_BYTES", size)
        assert simhash.fingerprint(text) == want


@pytest.mark.parametrize("max_bits,hot_key", [(3, 2048), (3, 3), (3, 0), (2, 2), (4, 1), (1, 5), (0, 5)])
def test_links_find_all_classes(spark, max_bits, hot_key):
    rng = random.Random(max_bits * 10 + hot_key)
    prints = {0, 1, (1 << 64) - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(25):
            other = base
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                other ^= 1 << bit
            prints.add(other)
    dense = rng.getrandbits(64)
    prints |= {dense ^ (i << 13) for i in range(150)}  # many that differ in a few bits only
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(4)
    found = dict(map(tuple, components(simhash.links(df, max_bits, hot_key)).collect()))
    mask = (1 << 64) - 1
    want = naive_classes(signed, lambda a, b: ((a ^ b) & mask).bit_count() <= max_bits)
    assert {p: found.get(p, p) for p in signed} == want


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 500)}" for _ in range(400)]
    rows = [(i, " ".join(base)) for i in (9, 4, 30)] + [(i, " ".join(base[:-1]) + f" z{i}") for i in (50, 2)]
    rows += [(100 + i, f"text {i} of its own") for i in range(20)] + [(7, None), (6, ""), (5, " \n")]
    rows += [(None, "only null ids"), (None, "only null ids"), (None, " ".join(base)), (60, "W60 a"), (61, "w60\tA")]
    rows += [(70, "long " * 50_000), (70, "long " * 50_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, component_id int")
    got = simhash.near_duplicates(df).collect()
    prints = {r[1]: naive_print(r[1]) for r in rows}
    classes = naive_classes(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(list)
    for key, text in rows:
        least[classes[prints[text]]] += [key] if key is not None else []
    want = sorted(
        (str(k), prints[t], str(min(least[classes[prints[t]]], default=None))) for k, t in rows
    )
    assert sorted((str(r.doc_id), r.fp & ((1 << 64) - 1), str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)]  # equal vectors, more than are asked for
    rows += [(2000 + i, (100 * rng.normal(size=8)).tolist()) for i in range(20)]
    rows += [(3000, None), (3050, [1.0, None] + [0.0] * 6), (3100, [NAN] * 8), (3150, [INF] * 8), (None, [9.0] * 8)]
    rows += [(3200, [0.0] * 8), (3250, [1.0, 2.0]), (3251, [1.0, 2.0]), (3300, []), (100, [0.25] * 8)]
    return rows


def usable(rows, zeros):
    out = []
    for key, v in rows:
        if key is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not (zeros or any(v)):
            continue
        out.append((key, np.pad(np.array(v, np.float32).astype(float), (0, 8 - len(v)))))
    return out


def frame(spark, rows):
    clash = [(*r, 0, 0.5) for r in rows]
    return spark.createDataFrame(clash, "vec_id long, embedding array<float>, rank int, score double").repartition(3)


def naive_top(rows, every, k):
    ids, matrix = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        scores = matrix @ matrix[i]
        other = np.flatnonzero(ids != ids[i])
        order = other[np.lexsort((ids[other], -scores[other]))][:k]
        out.setdefault(int(ids[i]), []).append([(int(ids[j]), float(scores[j])) for j in order])
    return out


def by_query(found):
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, float(r.score)))
    return got


@pytest.mark.parametrize("page", [4, 64])
def test_exact_search(spark, vectors, monkeypatch, page):
    monkeypatch.setattr(mtree, "PAGE", page)
    rows = [r for r in vectors if r[0] != 100 or r[1] != [0.25] * 8]
    want = naive_top([(k, np.floor(256 * v)) for k, v in usable(rows, True)], 50, 5)
    assert by_query(mtree.search(frame(spark, rows)).collect()) == {k: v[0] for k, v in want.items()}


def test_exact_search_of_few_and_large(spark):
    assert mtree.search(frame(spark, [])).count() == 0
    few = by_query(mtree.search(frame(spark, [(50, [1.0]), (3, [-2.0]), (100, [0.5])])).collect())
    assert few == {50: [(100, 32768.0), (3, -131072.0)], 100: [(50, 32768.0), (3, -65536.0)]}
    big = [(i, [float(2**20 + i), -float(2**21)]) for i in range(0, 200, 10)]
    found = mtree.search(frame(spark, big)).collect()
    units = {k: [int(256 * np.float32(x)) for x in v] for k, v in big}
    for q, rows in by_query(found).items():
        want = sorted((-sum(a * b for a, b in zip(units[q], units[k])), k) for k in units if k != q)[:5]
        assert [k for k, _ in rows] == [k for _, k in want]


def test_exact_search_of_empty_vectors(spark):
    got = by_query(mtree.search(frame(spark, [(50, []), (1, []), (2, [])])).collect())
    assert got == {50: [(1, 0.0), (2, 0.0)]}


def test_exact_search_of_repeated_ids(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 1.0])]
    got = mtree.search(frame(spark, rows)).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(50, 7)}


def lists(found):
    """The results of each query id, one list per row of it, in an order of their own."""
    ranks = defaultdict(lambda: defaultdict(list))
    for r in found:
        ranks[r.query_id][r.rank].append((float(r.score), r.vec_id))
    return {q: [sorted(at[rank]) for rank in sorted(at)] for q, at in ranks.items()}


def naive_lists(rows, every, k):
    """The same from ``naive_top``."""
    out = {}
    for q, each in naive_top(rows, every, k).items():
        out[q] = [sorted((x[i][1], x[i][0]) for x in each if i < len(x)) for i in range(max(map(len, each)))]
    return {q: [x for x in at if x] for q, at in out.items() if any(at)}


@pytest.mark.parametrize("operator,every,k", [(mtree, 50, 5), (hash_forest, 20, 20)])
def test_queries_that_share_an_id(spark, operator, every, k):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-9, 9, 8).astype(float).tolist()) for i in range(60, 160)]
    rows += [(0, v) for _, v in rows[:1]] + [(0, rng.integers(-9, 9, 8).astype(float).tolist())]
    rows += [(200, rows[0][1]), (400, rows[0][1])]
    whole = operator is mtree
    plain = [(key, np.floor(256 * v) if whole else v) for key, v in usable(rows, whole)]
    more = {} if whole else {"share": 24.0}
    assert lists(operator.search(frame(spark, rows), **more).collect()) == naive_lists(plain, every, k)


@pytest.mark.parametrize("operator,every,k", [(mtree, 50, 5), (hash_forest, 20, 20)])
def test_repeated_rows_leave_others_their_places(spark, operator, every, k):
    rng = np.random.default_rng(9)
    rows = [(i, rng.integers(-9, 9, 8).astype(float).tolist()) for i in range(1, 60)]
    for key, m in ((100, 2), (200, 6), (300, 30)):
        rows += [(key, rng.integers(20, 29, 8).astype(float).tolist())] * m
    rows += [(400, rng.integers(30, 39, 8).astype(float).tolist()) for _ in range(25)]  # one id, many vectors
    rows += [(71, [40.0] * 8)] * 30 + [(72, [40.0] * 8), (500, [40.0] * 8)]  # an equal vector of a later id
    whole = operator is mtree
    plain = [(key, np.floor(256 * v) if whole else v) for key, v in usable(rows, whole)]
    more = {} if whole else {"share": 24.0}
    assert lists(operator.search(frame(spark, rows), **more).collect()) == naive_lists(plain, every, k)
    if whole:
        empty = [(key, []) for key in [50] * 30 + [100, 1, 2, 3]]
        assert {r.vec_id for r in mtree.search(frame(spark, empty)).collect() if r.query_id == 50} == {1, 2, 3, 100}


def broadcast_lines(plan):
    """Lines of a plan that stand below a broadcast exchange."""
    depth, out = None, []
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :+-*("))
        if depth is not None and at <= depth:
            depth = None
        if depth is None and "BroadcastExchange" in line:
            depth = at
        elif depth is not None:
            out.append(line)
    return out


def test_neither_queries_nor_nodes_are_broadcast(spark, vectors, monkeypatch):
    """However large a table Spark may broadcast, blocks of queries and nodes are dealt out."""
    plans, saved = [], mtree.saved

    def noted(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return saved(df, *args)

    monkeypatch.setattr(mtree, "saved", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        found = mtree.search(frame(spark, vectors))
        plans.append(found._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [line for plan in plans for line in broadcast_lines(plan)]
    assert lines and not [line for line in lines if "MapInArrow" in line or "page_vector" in line]


def test_routing_vectors_are_cut_before_the_driver_gets_them(spark, monkeypatch):
    points = spark.range(5000).select(F.encode(F.col("id").cast("string"), "utf-8").alias("vec")).repartition(8)
    want = [r.vec for r in points.orderBy(F.xxhash64("vec"), "vec").limit(70).collect()]
    kept, order_by = [], type(points).orderBy

    def counted(df, *args, **kwargs):
        kept.append(df.count())
        return order_by(df, *args, **kwargs)

    monkeypatch.setattr(type(points), "orderBy", counted)
    assert [r.vec for r in mtree._first_by_hash(points, 70, 5000)] == want and kept[-1] < 250
    assert len(mtree._first_by_hash(points.limit(3), 3, 3)) == 3
    assert len(mtree._first_by_hash(points, 5000, 5000)) == 5000


def test_groups_of_one_node_and_of_all(spark, vectors, monkeypatch):
    rows = [r for r in vectors if r[0] != 100 or r[1] != [0.25] * 8]
    want = {k: v[0] for k, v in naive_top([(k, np.floor(256 * v)) for k, v in usable(rows, True)], 50, 5).items()}
    for size in (1000, 1 << 40):
        monkeypatch.setattr(mtree, "GROUP_BYTES", size)
        assert by_query(mtree.search(frame(spark, rows)).collect()) == want


@pytest.mark.parametrize("page", [64, 4096])
def test_approximate_search(spark, vectors, monkeypatch, page):
    monkeypatch.setattr(hash_forest, "PAGE", page)
    rows = [r for r in vectors if r[0] != 100 or r[1] != [0.25] * 8]
    plain = usable(rows, False)
    want = {k: v[0] for k, v in naive_top(plain, 20, 20).items()}
    got = by_query(hash_forest.search(frame(spark, rows), candidates=100).collect())
    assert set(got) == set(want)
    of = dict(plain)
    hits = 0
    for q, found in got.items():
        assert len(found) == 20 and all(abs(of[q] @ of[k] - s) < 1e-9 * max(1, abs(s)) for k, s in found)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        hits += len({k for k, _ in found} & {k for k, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_forest_that_takes_all_is_exact(spark, vectors, monkeypatch):
    monkeypatch.setattr(hash_forest, "PAGE", 64)
    rows = [r for r in vectors if r[0] != 100 or r[1] != [0.25] * 8]
    want = {k: [x for x, _ in v[0]] for k, v in naive_top(usable(rows, False), 20, 20).items()}
    got = by_query(hash_forest.search(frame(spark, rows), share=24.0).collect())
    assert {k: [x for x, _ in v] for k, v in got.items()} == want
    assert hash_forest.search(frame(spark, [])).count() == 0
    few = by_query(hash_forest.search(frame(spark, [(20, [1.0]), (3, [2.0]), (40, [0.0])])).collect())
    assert few == {20: [(3, 2.0)]}
