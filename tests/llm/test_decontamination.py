"""The positional index against plain loops over words."""

from __future__ import annotations

import random
import re

import duckdb
import pytest

from pairloom.llm import decontamination as dec
from pairloom.llm import queries
from tests.conftest import DATA


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def naive(docs, items):
    out = []
    for key, text in docs:
        own, hit, found = words(text), set(), set()
        for item, passage in items:
            test = words(passage)
            n = min(10, len(test))
            starts = {tuple(test[s : s + n]) for s in range(len(test) - n + 1)} if n else ()
            for p in range(len(own) - n + 1):
                if n and tuple(own[p : p + n]) in starts:
                    hit.update(range(p, p + n))
                    found |= {str(item)} if item is not None else set()
        out.append((key, len(own), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def naive_near(docs, items, spread):
    found = set()
    for key, text in docs:
        own = words(text)
        for _, passage in items:
            test = words(passage)
            n = min(10, len(test))
            for s in range(len(test) - n + 1):
                wanted = set(test[s : s + n])
                if n and any(wanted <= set(own[p : p + n + spread]) for p in range(len(own))):
                    found.add((key, " ".join(test[s : s + n])))
    return found


COMMON = ["the", "of", "and", "to"]
RARE = [f"w{i}" for i in range(12)] + ["Ünï", "漢字", "É"]


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)

    def text(n, rare=0.3):
        return " ".join(rng.choice(RARE if rng.random() < rare else COMMON) for _ in range(n))

    items = [(1, text(14)), (2, "Rare one"), (10, "the"), (3, ""), (4, None), (5, "!!! ..."), (None, "w0 w1 w2"), (6, "the " * 12)]
    items += [(7, text(10)), (7, text(11)), (8, "the the of"), (9, "absent0 the"), (1, items[0][1])]
    docs = [(i, text(rng.randrange(60))) for i in range(40)]
    docs += [(100, items[0][1].upper() + " ünï É"), (101, text(7) + " " + items[8][1] + "? " + text(5)), (102, "the," * 60)]
    docs += [(103, None), (104, ""), (None, "a rare: ONE b"), (105, "w0-w1.w2 w0 w1 w2"), (100, items[0][1].upper())]
    docs += [(106, " ".join(reversed(words(items[0][1])))), (107, "x".join(items[8][1].split(" ")))]
    return docs, items


def frames(spark, docs, items):
    docs = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, row int, term string").repartition(3)
    return docs, spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, w int")


def found(df):
    assert df.columns == ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("most, block, rows", [(dec.MAX_TERMS, dec.BLOCK, dec.BROADCAST_ROWS), (0, 3, 0)])
def test_against_loops(spark, tables, monkeypatch, most, block, rows):
    monkeypatch.setattr(dec, "BROADCAST_ROWS", rows)
    docs, items = frames(spark, *tables)
    windows, owners = dec.windows(items)
    entries = dec.index(docs, dec.terms_of(windows, most))
    matches = dec.exact(entries, dec.phrases(windows, entries), block)
    got = dec.contamination(entries, matches, owners).withColumnRenamed("id", "doc_id")
    assert found(got) == naive(*tables)


@pytest.mark.parametrize("spread, block", [(0, 2), (5, 100)])
def test_near_against_loops(spark, tables, spread, block):
    docs, items = frames(spark, *tables)
    windows, _ = dec.windows(items)
    entries = dec.index(docs, dec.terms_of(windows))
    got = dec.near(entries, dec.phrases(windows, entries), spread, block)
    ids = dec._documents(entries)
    rows = got.join(ids, "row").join(windows, "w").collect()
    assert {(r.id, " ".join(r.words)) for r in rows} == naive_near(*tables, spread)


@pytest.mark.parametrize("no_docs, no_items", [(True, False), (False, True), (True, True)])
def test_empty_tables(spark, tables, no_docs, no_items):
    docs, items = frames(spark, *tables)
    docs, items = docs.limit(0) if no_docs else docs, items.limit(0) if no_items else items
    want = [] if no_docs else naive(tables[0], [])
    assert found(dec.decontaminate(docs, items)) == want


def test_long_texts(spark):
    passage = " ".join(f"q{i}" for i in range(30))
    docs = [(1, "the " * 200_000 + passage), (2, "x" * 1_000_000)]
    assert found(dec.decontaminate(*frames(spark, docs, [(5, passage), (6, "the")]))) == [
        (1, 200_030, 200_030, 2, ["5", "6"], True), (2, 1, 0, 0, [], False)
    ]


def test_query_is_native_and_agrees_with_sql(spark):
    df = queries.op12_find_benchmark(spark, DATA)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    result = connection.execute(queries.ORACLES["op12_find_benchmark"])
    assert [d[0] for d in result.description] == df.columns
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == sorted(result.fetchall(), key=repr) and any(row[-1] for row in got)
