"""Line files that are out of step: beads against a plain dynamic program, and right pairs after gaps."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from pairloom.operators import drift


def plain_beads(a, b, ratio):
    """The whole table, one cell after the other."""
    kinds = list(drift.BEADS)

    def cost(x, y):
        return -math.log(drift.BEADS[x[0], y[0]]) + float(drift.bead_costs(np.array([float(x[1])]), np.array([float(y[1])]), ratio)[0])

    best = {(0, 0): (0.0, None)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            found = []
            for x, y in kinds:
                if i >= x and j >= y and (i, j) != (0, 0):
                    step = cost((x, sum(a[i - x : i])), (y, sum(b[j - y : j])))
                    found.append((best[i - x, j - y][0] + step, (x, y)))
            if found:
                best[i, j] = min(found)
    out, at = [], (len(a), len(b))
    while at != (0, 0):
        kind = best[at][1]
        out.append(kind)
        at = (at[0] - kind[0], at[1] - kind[1])
    return best[len(a), len(b)][0], out[::-1]


def total(a, b, beads, ratio):
    i = j = 0
    cost = 0.0
    for x, y in beads:
        lengths = np.array([float(sum(a[i : i + x]))]), np.array([float(sum(b[j : j + y]))])
        cost += -math.log(drift.BEADS[x, y]) + float(drift.bead_costs(*lengths, ratio)[0])
        i, j = i + x, j + y
    assert (i, j) == (len(a), len(b))
    return cost


@pytest.mark.parametrize("seed", range(12))
def test_beads_cost_the_least(seed):
    rng = random.Random(seed)
    a = [rng.choice([0, 5, 20, 60, 61, 120]) + rng.randrange(9) for _ in range(rng.randrange(26))]
    b = [max(0, round(x * 0.8) + rng.randrange(-4, 5)) for x in a if rng.random() > 0.15]
    b[3:3] = [rng.randrange(100)] * rng.randrange(3)
    ratio = 0.8
    assert math.isclose(total(a, b, drift.beads(a, b, ratio), ratio), plain_beads(a, b, ratio)[0], rel_tol=1e-9, abs_tol=1e-9)


def test_beads_of_distinct_lengths_are_those_of_the_plain_table():
    rng = random.Random(99)
    a = [rng.randrange(10, 300) for _ in range(40)]
    b = [x + rng.randrange(-5, 6) for i, x in enumerate(a) if i not in (7, 21, 22)]
    assert drift.beads(a, b, 1.0) == plain_beads(a, b, 1.0)[1]


def text(rng, n=None):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n or rng.randrange(3, 25)))


def frame(spark, lines, name="f"):
    rows = [(name, i, line, 1) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "name string, line_no long, line string, i int").repartition(3)


def lines_of(rows, at):
    """Every line of a side is in exactly one bead, in order."""
    place = 0
    for row in sorted(rows, key=lambda r: (r[at], -r[at + 1] == 0, r[at + 2 if at == 1 else at - 2])):
        if row[at + 1]:
            assert row[at] == place
            place += row[at + 1]
    return place


def test_pairs_after_dropped_lines(spark, monkeypatch):
    """Anchors, cuts by length and groups at small sizes; lines dropped on either side."""
    monkeypatch.setattr(drift, "BLOCK", 20)
    rng = random.Random(4)
    left, right, true = [], [], {}
    for k in range(900):
        line = text(rng) + (f" {k}" if k < 500 and k % 6 == 0 else "")
        in_left, in_right = k not in range(200, 215) and k != 640, k not in (50, 51, 52, 300, 700, 701)
        if in_left and in_right:
            true[len(left)] = len(right)
        left += [line] if in_left else []
        right += [line.upper()] if in_right else []
    got = [tuple(r) for r in drift.align_drifted(frame(spark, left), frame(spark, right), by=["name"], stretch=40).collect()]
    assert lines_of(got, 1) == len(left) and lines_of(got, 3) == len(right)
    pairs = {r[1]: r[3] for r in got if r[2] == r[4] == 1}
    right_pairs = sum(true.get(i) == j for i, j in pairs.items())
    assert right_pairs > 0.97 * len(true) and right_pairs > 0.99 * len(pairs)
    by_position = sum(i == j for i, j in true.items())
    assert by_position < 0.1 * len(true)
    for r in got:
        assert r[5] == (" ".join(left[r[1] : r[1] + r[2]]) if r[2] else None)
        assert r[6] == (" ".join(right[r[3] : r[3] + r[4]]) if r[4] else None)


def test_small_files_equal_the_plain_table(spark):
    """Several files, told apart by a column that may be null; no anchors, as no line has numbers."""
    rng = random.Random(8)
    files = {}
    for name in ("x", "y", None, "only left", "only right", "nulls"):
        a = [text(rng) for _ in range(rng.randrange(5, 30))]
        b = [line + "s" for line in a if rng.random() > 0.1]
        files[name] = ([] if name == "only right" else a, [] if name == "only left" else b)
    files["nulls"] = ([None, "abc", None], ["abc", None])
    sides = [
        spark.createDataFrame([(name, i, line) for name, pair in files.items() for i, line in enumerate(pair[s])], "name string, line_no long, line string")
        for s in (0, 1)
    ]
    got = [tuple(r) for r in drift.align_drifted(*sides, by=["name"]).collect()]
    chars = [sum(len(x or "") for pair in files.values() for x in pair[s]) for s in (0, 1)]
    for name, (a, b) in files.items():
        a, b = [x or "" for x in a], [x or "" for x in b]
        own = sorted((r[1:] for r in got if r[0] == name), key=lambda r: (r[0], r[2], r[1] + r[3]))
        beads = [(r[1], r[3]) for r in own]
        ratio = chars[1] / chars[0]
        lengths = [len(x) for x in a], [len(x) for x in b]
        assert math.isclose(total(*lengths, beads, ratio), plain_beads(*lengths, ratio)[0], rel_tol=1e-9, abs_tol=1e-9)


def test_unrelated_files_and_empty_ones(spark):
    rng = random.Random(2)
    left, right = [text(rng) for _ in range(700)], [text(rng) for _ in range(90)]
    got = [tuple(r) for r in drift.align_drifted(frame(spark, left), frame(spark, right), by=["name"], stretch=30, reach=20).collect()]
    assert sum(r[2] for r in got) == 700 and sum(r[4] for r in got) == 90
    none = frame(spark, left).limit(0)
    assert drift.align_drifted(none, none).count() == 0
    alone = drift.align_drifted(frame(spark, left), none, stretch=30).collect()
    assert sorted(r.left_no for r in alone) == list(range(700)) and all(r.n_right == 0 and r.ko is None for r in alone)


def test_costs_of_many_lines_are_computed_together(monkeypatch):
    calls, keep = [], drift.bead_costs
    monkeypatch.setattr(drift, "bead_costs", lambda *args: (calls.append(1), keep(*args))[1])
    lengths = [(7 * i) % 90 for i in range(200)]
    want = drift.beads(lengths, lengths[3:], 1.0)
    assert len(calls) < 20
    monkeypatch.setattr(drift, "CELLS", 500)
    assert drift.beads(lengths, lengths[3:], 1.0) == want
