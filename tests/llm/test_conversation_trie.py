"""The conversation trie against a trie of Python dictionaries."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairloom.llm import conversation_trie, queries
from tests.conftest import DATA

COLUMNS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
]


def naive(rows):
    """Rows are (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [t[2:] for t in sorted(turns)] for conv, turns in convs.items()}
    built = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        built[conv] = tuple(own.get(conv - conv % 20, [])[:h] + turns[h:])
    under = defaultdict(list)
    for conv, turns in built.items():
        for d in range(len(turns) + 1):
            under[turns[:d]].append(conv)
    children = defaultdict(list)
    for node in under:
        if node:
            children[node[:-1]].append(node)
    totals = {}
    for node in sorted(under, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = [totals[child] for child in children[node]]
        totals[node] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(under[node]) - 1) * words)
    out = []
    for node, convs in under.items():
        ended = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        parent = min(under[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), *totals[node], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(df, rows):
    assert df.columns == COLUMNS
    got = sorted(map(tuple, df.collect()), key=repr)
    want = naive(rows)
    assert len(got) == len(want) and got == want


def frame(spark, rows, parts=3):
    rows = [(*r, 5, "x") for r in rows]
    schema = "conv_id long, turn long, role string, text string, depth int, shard string"
    return spark.createDataFrame(rows, schema).repartition(parts)


def random_rows(n=300, seed=3):
    rng = random.Random(seed)
    texts = ["Hi", "", None, "how are  you", "a b\tc d", "x" * 400, "漢字   é"]
    rows = []
    for i in range(n):
        conv = i * 3 if rng.random() < 0.3 else i
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, rng.choice([None, turn, turn, turn]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    return rows + [(None, 1, "user", "no conversation"), rows[5], rows[5]]


@pytest.mark.parametrize("shard, queue", [(conversation_trie.SHARD, conversation_trie.QUEUE), (60, 100), (25, 1), (25, 0)])
def test_against_dictionaries(spark, shard, queue):
    rows = random_rows()
    check(conversation_trie.trie(frame(spark, rows), shard=shard, queue=queue), rows)


def test_one_long_and_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK", 7)
    monkeypatch.setattr(conversation_trie, "WIDE", 5)
    rows = [(11, i, "user", f"turn {i % 17}") for i in range(3_000)]
    rows += [(i, j, "user", f"same {j}") for i in range(20, 400) for j in range(3)]
    rows += [(i, 0, "user", f"other {i}") for i in range(400, 500)]
    check(conversation_trie.trie(frame(spark, rows, 5), shard=500), rows)


def test_turns_of_one_conversation_lie_in_several_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # too few rows otherwise
    rows = [(3, i, "user", str(i)) for i in range(2_000)]
    turns = conversation_trie.ordered_turns(frame(spark, rows), "conv_id", "turn", "role", "text")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.rank for r in turns.collect()) == list(range(1, 2_001))
    assert turns.select("part").distinct().count() > 1
    words = turns.filter("rank = 1500").first()
    want = spark.range(1).select(F.xxhash64(F.lit("user"), F.lit("1499")).alias("t1")).first()
    assert words.t1 == want.t1


def test_turnless_and_empty(spark):
    # Conversation 1 has h = crc32("1") % 4 turns replaced by those of conversation 0, which is absent.
    absent = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 2][:3]
    rows = [(c, 1, "user", "only") for c in absent]
    check(conversation_trie.trie(frame(spark, rows)), rows)
    check(conversation_trie.trie(frame(spark, [])), [])
    check(conversation_trie.trie(frame(spark, [(None, 1, "user", "x")])), [])


def test_very_long_text(spark):
    rows = [(20, 1, "user", "word " * 200_000), (25, 1, "user", "word " * 200_000), (25, 2, "user", "w" * 1_000_000)]
    check(conversation_trie.trie(frame(spark, rows)), rows)


def test_query(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    check(queries.op13_conversation_trie(spark, DATA), [tuple(r) for r in rows])
