"""Sharding, packing and mixing."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.llm import mixing, packing, sharding

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string"


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, DOCS + extra).repartition(3)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 257, 1000])
def test_permutation_and_inverse(spark, n):
    order = sharding.Permutation(n, 5)
    rows = (
        spark.range(n)
        .withColumn("to", order.apply(F.col("id")))
        .withColumn("back", order.invert(F.col("to")))
        .collect()
    )
    assert sorted(r.to for r in rows) == list(range(n))
    assert all(r.back == r.id for r in rows)
    if n >= 100:
        assert sum(r.to == r.id for r in rows) < n / 10


def test_shards(spark):
    rows = [(i, f"text {i}" * (i % 7), "s") for i in range(97)]
    rows += [(None, None, None), (5, "", None), *[(7, "same", "x")] * 40, (None, "é" * 10_000, "y")]
    clash = [(*row, 1, 2) for row in rows]
    found = sharding.shard_rows(docs(spark, clash, ", shard int, slot int")).collect()
    again = sharding.shard_rows(docs(spark, rows)).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))
    want = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == want
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    places = spark.createDataFrame([(r.shard, r.slot, r.row_number) for r in found], "a int, b long, n long")
    back = places.select("n", sharding.row_at(F.col("a"), F.col("b"), len(rows)).alias("m")).collect()
    assert all(r.n == r.m for r in back)


def test_shards_of_nothing(spark):
    assert sharding.shard_rows(docs(spark, [])).count() == 0


def test_hot_row_is_dealt_in_chunks(spark):
    rows = docs(spark, [(1, "a", "s")] * 3).union(
        spark.range(10_000).select(F.lit(2).cast("long"), F.lit("b"), F.lit("s"))
    )
    found = sharding.shard_rows(rows, shards=4).groupBy("shard").agg(F.count("*"), F.max("slot")).collect()
    assert sorted(r[1] for r in found) == [2500, 2501, 2501, 2501]
    assert all(r[1] == r[2] + 1 for r in found)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_level_with_least_squares(sizes):
    levels, counts = packing.Levels(16), [0] * 17
    for size in (s for s in sizes if s <= 16):
        got = levels.best(size)

        def squares(level):
            after = list(counts)
            if level:
                after[level] -= 1
            if level + size < 16:
                after[level + size] += 1
            return sum(n * n for n in after)

        able = [h for h in range(17 - size) if h == 0 or counts[h]]
        assert got in able and squares(got) == min(map(squares, able))
        if got:
            counts[got] -= 1
            levels.add(got, -1)
        if got + size < 16:
            counts[got + size] += 1
            levels.add(got + size, 1)


@pytest.mark.parametrize("max_open", [2, 1000])
def test_pieces_hold_each_id_once(spark, max_open):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    words = "The quick-brown fox, jumps! İstanbul ΑΣ don't <|endoftext|> 12.5 naïve 日本".split(" ")
    texts = [" ".join(words[(i * j) % len(words)] for j in range(i * 3)) for i in range(60)]
    texts += ["", None, "x " * 3000, "\n\n a\tb\x1cc  d　e\n", "same text", "same text"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "no id", None)]
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in rows}
    clash = [(*row, 3) for row in rows]
    pieces = packing.pack(
        docs(spark, clash, ", offset int").coalesce(2), PATH, window=64, max_open=max_open
    ).collect()
    got, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        got[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
        sequences[p.sequence_id].append((p.offset, p.length))
        assert p.length == len(p.ids) // 4 > 0 and p.doc_tokens == len(want[p.doc_id])
    assert {k: [x for _, ids in sorted(v) for x in ids] for k, v in got.items()} == want
    for k, v in got.items():
        starts = np.cumsum([0, *[len(ids) for _, ids in sorted(v)]])
        assert [s for s, _ in sorted(v)] == starts[:-1].tolist()
    short = 0
    for parts in sequences.values():
        ends = np.cumsum([0, *[n for _, n in sorted(parts)]])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 64
        short += ends[-1] < 64
    assert short <= 2  # one for each task


def test_packing_nothing(spark):
    assert packing.pack(docs(spark, []), PATH).count() == 0


def fill(sizes: dict, weights: dict, share=1.0, most=3.0) -> dict:
    total, full = sum(sizes.values()) * share, set()
    while True:
        rest = [s for s in sizes if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        unit = left / sum(weights[s] for s in rest) if rest else 0
        over = {s for s in rest if unit * weights[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else unit * weights[s] for s in sizes}
        full |= over


@pytest.fixture(scope="module")
def mixture(spark):
    rows = [(i, "w " * (1 + (i * 37) % 90), "abcd"[min(i % 9, 3)]) for i in range(900)]
    rows += [(1000 + i, "tiny\x0bone", "e") for i in range(3)] + [(None, "null  source\n", None)]
    rows += [(2000, None, "a"), (2001, "", "a"), (2002, " \t", "f")] + [(3000, "one row many times", "a")] * 50
    return rows


def test_mix_meets_targets(spark, mixture):
    df = docs(spark, [(*r, 1.0) for r in mixture], ", target double")
    found = mixing.mix(df).collect()
    size_of = lambda t: len((t or "").split())
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, size_of(t)) for i, t, _ in mixture)
    sizes = Counter()
    for _, text, source in mixture:
        sizes[source] += size_of(text)
    names = sorted((s for s in sizes if s is not None)) + [None]
    goals = fill(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    taken = Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, goals[r.source], rel_tol=1e-9)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        assert math.floor(r.rate) <= r.copies <= math.ceil(r.rate)
        taken[r.source] += r.taken
    for source, goal in goals.items():
        assert abs(taken[source] - goal) <= max(5, 0.001 * goal), (source, taken[source], goal)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(df).collect()))


def test_rates_are_tilted(spark, mixture):
    """Below the cap, the logarithm of the rate is the size times one number per source."""
    found = mixing.mix(docs(spark, mixture)).filter("size > 0").collect()
    slopes = defaultdict(list)
    for r in found:
        if 0 < r.rate < 3 - 1e-9:
            slopes[r.source].append(math.log(r.rate) / r.size)
    assert slopes and all(max(s) - min(s) < 1e-9 for s in slopes.values())
    for source in slopes:
        own = [r for r in found if r.source == source]
        assert math.isclose(sum(r.rate * r.size for r in own), own[0].target, rel_tol=1e-5)


def test_mixing_nothing(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    found = mixing.mix(docs(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.taken, r.target) for r in found] == [(0, 0, 0.0)] * 2


def test_levels_go_on_when_many_windows_are_open():
    """With 5,000 documents of over half a window, which open a window each, few are cut."""
    rng = np.random.default_rng(4)
    sizes = rng.integers(33, 64, 5_000)
    packer, full = packing.Packer(window=64, max_open=400), []
    most = 0
    for i, size in enumerate(sizes.tolist()):
        full += packer.place(i, np.full(size, i, "<u4").tobytes())
        most = max(most, packer.n_open)
        if packer.n_open < 250 and i > 1_000:
            raise AssertionError("all windows have been closed")
    kept = {level: len(found) for level, found in packer.open.items()}
    assert sum(kept.values()) == packer.n_open and most <= 401
    # The level array says what is open.
    assert all(packer.levels.twice[level] == 2 * n for level, n in kept.items())
    full += packer.close()
    lengths = [sum(len(p[2]) // 4 for p in pieces) for pieces in full]
    assert sum(n < 64 for n in lengths) <= 1 and sum(lengths) == sizes.sum()
    pieces = sorted((p[0], p[1], len(p[2]) // 4) for window in full for p in window)
    at = {}
    for key, start, length in pieces:
        assert start == at.get(key, 0)
        at[key] = start + length
    assert [at[i] for i in range(5_000)] == sizes.tolist()
