"""Word translation chances, character models and splits by groups, against plain versions."""

from __future__ import annotations

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import fluency, groups, joins, lexical, word_pairs

DICTIONARY = {w: w[::-1] + "o" for w in "house tree water light stone river green small door night bird road".split()}


def sentences(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(list(DICTIONARY)) for _ in range(rng.randrange(2, 8))]
        other = [DICTIONARY[w] for w in words if rng.random() > 0.1]
        rng.shuffle(other)
        rows.append((i, " ".join(words), " ".join(other) or "x"))
    return rows


def plain_model1(rows, steps):
    pairs = [(["", *a.lower().split()], b.lower().split()) for _, a, b in rows]
    t = defaultdict(lambda: 1.0)
    for _ in range(steps):
        counts, totals = defaultdict(float), defaultdict(float)
        for own, other in pairs:
            for f in other:
                total = sum(t[e, f] for e in own)
                for e in own:
                    counts[e, f] += t[e, f] / total
                    totals[e] += t[e, f] / total
        t = defaultdict(float, {(e, f): c / totals[e] for (e, f), c in counts.items()})
    return t


def pair_frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "id long, en string, ko string, e string, t double").repartition(3)


@pytest.mark.parametrize("most_rows", [joins.MOST_ROWS, 20])
def test_chances_equal_plain_ones(spark, monkeypatch, most_rows):
    monkeypatch.setattr(joins.lookup, "__defaults__", ("inner", most_rows))
    rows = [*sentences(60), (100, "", "x"), (101, "house", ""), (102, None, None), (103, "HOUSE  house", "esuoho")]
    df = pair_frame(spark, rows)
    model = lexical.learn(df, "id", steps=5)
    want = plain_model1([(i, a or "", b or "") for i, a, b in rows if b], 5)
    got = {(r.e, r.f): r.t for r in model.collect()}
    assert set(got) == {k for k, v in want.items()} and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)
    scores = {r.id: r.lexical for r in lexical.score(df, model, "id").collect()}
    assert set(scores) == {i for i, a, b in rows if b}
    for i, a, b in rows:
        if b:
            own = ["", *(a or "").lower().split()]
            mean = sum(math.log(max(sum(want[e, f] for e in own) / len(own), lexical.FLOOR)) for f in b.lower().split())
            assert math.isclose(scores[i], mean / len(b.split()), rel_tol=1e-9)


def test_shuffled_pairs_score_below_true_ones(spark):
    rows = sentences(300)
    others = [r[2] for r in rows[7:] + rows[:7]]
    mixed = [(i, a, b if i % 3 else others[i]) for i, a, b in rows]
    found = lexical.lexical_quality(pair_frame(spark, [*mixed, (900, "", "tree")]), "id").collect()
    got = {r.id: r for r in found}
    true = [got[i].lexical for i in range(300) if i % 3]
    wrong = [got[i].lexical for i in range(0, 300, 3) if set(rows[i][2].split()) != set(others[i].split())]
    assert sorted(true)[len(true) // 10] > sorted(wrong)[9 * len(wrong) // 10]
    assert got[900].lexical is None and not got[900].plausible and {"e", "t"} <= set(found[0].asDict())


def test_very_long_pairs_are_cut_in_proportion(spark):
    words = list(DICTIONARY) * 40
    long = (1, " ".join(words), " ".join(DICTIONARY[w] for w in words))
    seen = lexical.cooccurrences(pair_frame(spark, [long]), "id", "en", "ko", part=10)
    per_part = seen.groupBy("part").agg(F.count_distinct("e").alias("e"), F.count_distinct("f").alias("f")).collect()
    assert len(per_part) == 48 and all(r.e <= 11 and r.f <= 10 for r in per_part)
    assert seen.filter("e <> ''").groupBy("part", "e").agg(F.first("n_e").alias("n")).agg(F.sum("n")).first()[0] == len(words)


def test_parts_and_the_first_step_are_not_shuffled_row_by_row(spark, monkeypatch):
    plans, written = {}, lexical.order.written

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().toString()
        return written(df, label)

    monkeypatch.setattr(lexical.order, "written", noted)
    lexical.learn(pair_frame(spark, sentences(30)), "id", steps=1)
    assert "Join" not in plans["cooccurrences"] and "Aggregate" not in plans["cooccurrences"]
    assert "Window" not in plans["word-counts"]


def test_parts_hold_their_words_with_counts(spark):
    rows = [(1, "a b a c d", "x y"), (2, None, "z z"), (None, "a", "x"), (3, "a", " "), (4, "B b", "Y x y X y w w")]
    df = spark.createDataFrame(rows, "id long, en string, ko string")
    got = Counter()
    for r in lexical.cooccurrences(df, "id", "en", "ko", part=2).collect():
        got[r.row, r.part, r.e, r.n_e, r.f, r.n_f] += 1
    want = Counter()
    for row, en, ko in rows:
        e, f = (en or "").lower().split(), ko.lower().split()
        parts = max(1, math.ceil(max(len(e), len(f)) / 2)) if f and row else 0
        for part in range(parts):
            own = Counter(["", *(w for at, w in enumerate(e) if at * parts // len(e) == part)])
            other = Counter(w for at, w in enumerate(f) if at * parts // len(f) == part)
            want.update((row, part, a, n, b, m) for a, n in own.items() for b, m in other.items())
    assert got == want


@pytest.mark.parametrize(
    "limits",
    [
        {"TARGET": 400},
        {"TARGET": 400, "CHUNK": 50, "ROUNDS": 3},
        {"TARGET": 400, "HOT": 60, "CHUNK": 50},
        {"TARGET": 400, "HOT": 60, "MOST_ROWS": 5, "MOST_WORDS": 5},
        {"CHUNK": 1 << 40, "MOST_ROWS": 5},
    ],
)
def test_chances_do_not_depend_on_buckets(spark, monkeypatch, limits):
    """Many buckets, target words alone or in several of them, totals joined, and words by hash."""
    for name, value in limits.items():
        monkeypatch.setattr(word_pairs, name, value)
    rows = [*sentences(120), (200, "", "x x y"), (201, "house", ""), (202, "HOUSE  house tree", "esuoho x")]
    df = pair_frame(spark, rows)
    model = lexical.learn(df, "id", steps=3)
    want = plain_model1([(i, a, b) for i, a, b in rows if b], 3)
    got = {(r.e, r.f): (r.t, r.n_seen) for r in model.collect()}
    assert set(got) == set(want) and all(math.isclose(got[k][0], want[k], rel_tol=1e-9) for k in got)
    seen = Counter(k for _, a, b in rows for e in {"", *a.lower().split()} for k in {(e, f) for f in b.split()})
    assert {k: n for k, (_, n) in got.items()} == seen
    # The pairs that chances are learned from, and the same pairs as another table.
    own = {r.id: r.lexical for r in lexical.score(df, model, "id").collect()}
    other = {r.id: r.lexical for r in lexical.score(df.filter("true"), model, "id").collect()}
    assert set(own) == set(other) == {i for i, _, b in rows if b}
    assert all(math.isclose(own[i], other[i], rel_tol=1e-9) for i in own)


def test_no_pair_of_words_is_written_or_shuffled_by_itself(spark, monkeypatch):
    """A step hands on numbers of words, not of pairs of words, and the first one needs no pass over the pairs."""
    n_rows, written = Counter(), word_pairs.order.written

    def noted(df, label):
        out = written(df, label)
        n_rows[label] += out.count()
        return out

    monkeypatch.setattr(lexical.order, "written", noted)
    rows = sentences(200)
    df = pair_frame(spark, rows)
    lexical.score(df, lexical.learn(df, "id", steps=2), "id").count()
    words = {w for _, a, b in rows for w in ("", *a.split(), *b.split())}
    assert n_rows["word-counts"] <= 2 * len(words)
    assert n_rows["cooccurrences"] <= 3 and set(n_rows) == {"word-counts", "cooccurrences"}


@pytest.mark.parametrize("values", [[], [5], [-3, -2, 2**62], [1 - 2**63, 2**63 - 1], [9, 3, -4], range(300), [7, 7, 0]])
def test_packed_numbers_come_back(values):
    a = np.array(values, np.int64)
    for grows in (False, True):
        assert word_pairs._whole(*word_pairs._planes(a, grows)).astype(np.int64).tolist() == list(values)
    lists = {"e": np.array([1, 2, 7, 0, 3, 5]), "sizes": np.array([3, 0, 1, 2]), "words": a}
    back = word_pairs.unpacked(word_pairs.packed(dict(lists)))
    assert {k: v.tolist() for k, v in back.items()} == {k: v.tolist() for k, v in lists.items()}


def plain_kneser_ney(texts, size):
    grams = Counter()
    for text in texts:
        padded = "\u0002" * (size - 1) + (text or "") + "\u0003"
        grams.update(padded[i : i + size] for i in range(len(padded) - size + 1))
    tables = [grams]
    for _ in range(size - 1):
        tables.insert(0, Counter(g[1:] for g in tables[0]))
    totals, kinds, discounts = [], [], []
    for table in tables:
        total, kind = Counter(), Counter()
        for g, c in table.items():
            total[g[:-1]] += c
            kind[g[:-1]] += 1
        ones, twos = (sum(c == k for c in table.values()) for k in (1, 2))
        totals.append(total)
        kinds.append(kind)
        discounts.append(ones / (ones + 2 * twos) if ones and twos else 0.5)

    def chance(gram):
        k = len(gram) - 1
        below = chance(gram[1:]) if k else 1 / len(tables[0])
        total = totals[k][gram[:-1]]
        if not total:
            return below
        own = max(tables[k][gram] - discounts[k], 0) if tables[k][gram] else 0
        return own / total + discounts[k] * kinds[k][gram[:-1]] / total * below

    return chance


@pytest.mark.parametrize("size", [1, 3, 4])
def test_grams_of_parts_and_of_long_texts(spark, monkeypatch, size):
    texts = [(1, "a\U0001f600b\u00e9 aa"), (2, None), (3, ""), (4, "abc" * 20), (5, "\U0010ffff" * 3)]
    df = spark.createDataFrame(texts, "id long, text string")
    want = Counter()
    for i, text in texts:
        padded = "\u0002" * (size - 1) + (text or "") + "\u0003"
        want.update((i, padded[k : k + size]) for k in range(len(padded) - size + 1))
    for chars in (7, fluency.CHARS_AT_ONCE):
        monkeypatch.setattr(fluency, "CHARS_AT_ONCE", chars)
        got, every = Counter(), Counter()
        for r in fluency._grams(df, "text", size, "id").collect():
            got[r.row, r.gram] += r.n
        for r in fluency._grams(df, "text", size).collect():
            every[r.gram] += r.n
        assert got == want
        assert every == sum((Counter({g: n}) for (_, g), n in want.items()), Counter())


def test_a_very_long_text_takes_time_as_its_length(spark):
    df = spark.createDataFrame([(1, "some words " * 100_000)], "id long, text string")
    began = time.monotonic()
    assert fluency.score(df, fluency.learn(df, size=3), "id").first().n_chars == 1_100_000
    assert time.monotonic() - began < 120


@pytest.mark.parametrize("most_rows", [joins.MOST_ROWS, 10])
def test_fluency_equals_plain_version(spark, monkeypatch, most_rows):
    monkeypatch.setattr(joins.lookup, "__defaults__", ("inner", most_rows))
    learned = [(i, a) for i, a, _ in sentences(40)] + [(50, None), (51, ""), (52, "Ünï 漢字\n漢字"), (53, "a" * 3_000)]
    asked = [*learned, (60, "river of glass"), (61, "qqzzxj"), (62, None), (63, "漢漢漢")]
    schema = "id long, text string, gram string"
    model = fluency.learn(spark.createDataFrame([(*r, "x") for r in learned], schema), size=3)
    got = {r.id: r for r in fluency.score(spark.createDataFrame([(*r, "x") for r in asked], schema), model, "id").collect()}
    chance = plain_kneser_ney([t for _, t in learned], 3)
    assert set(got) == {i for i, _ in asked}
    for i, text in asked:
        padded = "\u0002\u0002" + (text or "") + "\u0003"
        each = [math.log2(chance(padded[k : k + 3])) for k in range(len(padded) - 2)]
        assert got[i].n_chars == len(text or "") and math.isclose(got[i].fluency, sum(each) / len(each), rel_tol=1e-9)


def test_chances_of_a_context_sum_to_one(spark):
    rows = [(i, a) for i, a, _ in sentences(30)]
    model = fluency.learn(spark.createDataFrame(rows, "id long, text string"), size=3)
    letters = sorted({c for _, t in rows for c in t} | {"\u0003"})
    asked = spark.createDataFrame([(h + c,) for h in ("ho", "zz", "\u0002t", "  ") for c in letters], "gram string")
    found = fluency.chances(asked, model).collect()
    totals = Counter()
    for r in found:
        totals[r.gram[:2]] += r.p
    assert all(math.isclose(total, 1.0, rel_tol=1e-9) for total in totals.values())


def test_junk_ranks_below_prose(spark):
    rng = random.Random(3)
    prose = [(i, a) for i, a, _ in sentences(200)]
    junk = [(1_000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz !#") for _ in range(30))) for i in range(20)]
    df = spark.createDataFrame(prose + junk, "id long, text string")
    got = {r.id: r.fluency for r in fluency.score(df, fluency.learn(df), "id").collect()}
    assert max(got[i] for i, _ in junk) < min(got[i] for i, _ in prose)
    assert fluency.score(df.limit(0), fluency.learn(df.limit(0)), "id").count() == 0


def plain_groups(rows, n_columns=2):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen: dict = {}
    for i, row in enumerate(rows):
        for c in range(n_columns):
            if row[c] is not None:
                root[find(i)] = find(seen.setdefault((c, row[c]), i))
    found = defaultdict(set)
    for i in range(len(rows)):
        found[find(i) if any(v is not None for v in rows[i][:n_columns]) else "none"].add(i)
    return {frozenset(g) for g in found.values()}


@pytest.mark.parametrize("most_rows", [joins.MOST_ROWS, 5])
def test_groups_equal_plain_ones(spark, monkeypatch, most_rows):
    monkeypatch.setattr(joins.lookup, "__defaults__", ("inner", most_rows))
    rng = random.Random(6)
    rows = [(f"a{rng.randrange(150)}", f"b{rng.randrange(150)}") for _ in range(120)]
    rows += [("hub", f"h{i}") for i in range(80)] + [(f"c{i}", f"d{i}") for i in range(50)] + [(f"c{i + 1}", f"d{i}") for i in range(50)]
    rows += [(None, "b1"), (None, None), ("x", None), (None, None), ("x", "x"), ("b1", "a1"), rows[0], rows[0]]
    df = spark.createDataFrame([(i, *r, "keep") for i, r in enumerate(rows)], "id long, en string, ko string, root string").repartition(4)
    found = groups.with_groups(df).collect()
    got = defaultdict(set)
    for r in found:
        got[r.group].add(r.id)
    assert len(found) == len(rows) and {frozenset(g) for g in got.values()} == plain_groups(rows)
    assert found[0].root == "keep"


@pytest.mark.parametrize("n", [0, 3, 40, 250])
def test_split_without_leaks(spark, n):
    rng = random.Random(7)
    rows = [(f"a{rng.randrange(900)}", f"b{rng.randrange(900)}") for _ in range(240)] + [("same", f"s{i}") for i in range(60)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, en string, ko string")
    train, test = (side.collect() for side in groups.split_groups(df, 5, n=n))
    assert sorted(r.id for r in train + test) == list(range(300)) and train[0].__fields__ == df.columns if train else True
    for column in ("en", "ko"):
        assert not {r[column] for r in train} & {r[column] for r in test}
    fitting = [len(g) for g in plain_groups(rows) if len(g) <= n]
    assert len(test) <= n and (len(test) > n - max(fitting, default=1) or len(test) == sum(fitting))
    again = groups.split_groups(df.repartition(7), 5, n=n)[1].collect()
    assert {r.id for r in again} == {r.id for r in test}


def test_rows_are_computed_once_for_a_split(spark):
    calls = spark.sparkContext.accumulator(0)

    def count(text):
        calls.add(1)
        return text

    df = spark.range(50).select(F.col("id"), F.udf(count)(F.concat(F.lit("a"), F.col("id") % 40)).alias("en"), F.col("id").cast("string").alias("ko"))
    train, test = groups.split_groups(df, 5, fraction=0.2)
    assert train.count() + test.count() == 50 and calls.value == 50


def test_split_sizes_are_checked(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id long, en string, ko string")
    for wrong in ({"n": 2}, {"n": -1}, {"fraction": 1.5}, {}, {"n": 1, "fraction": 0.5}):
        with pytest.raises(ValueError):
            groups.split_groups(df, 1, **wrong)
    train, test = groups.split_groups(df.limit(0), 1, fraction=0.5)
    assert train.count() == test.count() == 0


def test_lookup_ways_agree(spark):
    rows = spark.createDataFrame([(i % 3 if i < 50 else i, i) for i in range(100)] + [(None, 7)], "k long, v long")
    table = spark.createDataFrame([(i, f"t{i}") for i in range(90)], "k long, t string")
    for how, size in (("inner", 90), ("left", 101)):
        found = [Counter(map(tuple, joins.lookup(rows, table, ["k"], how, most).collect())) for most in (1_000, 20, 1)]
        assert found[0] == found[1] == found[2] and sum(found[0].values()) == size
