"""Alignment of two line files that are out of step, by the lengths of their lines.

``align_lines`` pairs lines by position; one line dropped on a side makes all later pairs wrong. Here lines
are put together in beads: one line with one, one with none, one or two with two. The beads of a stretch
are those of least cost by dynamic programming over line lengths (W. Gale and K. Church, A Program for
Aligning Sentences in Bilingual Corpora, 1993).

Files of any length are cut into stretches first:

1. lines whose key, by default the numbers in a line, occurs once on each side propose anchors;
2. an anchor stays if one of its three neighbours on either side has drifted about as far, and if it
   crosses no other that stays;
3. where more than ``stretch`` lines lie between two anchors, cuts are added at even distances, each where
   the lengths of the lines around it agree best within ``reach`` lines of the place in proportion;
4. lines are dealt into groups of about ``stretch`` lines, and each group is solved between its anchors,
   in a band around the diagonal.

How the work is spread: anchors are found by joins and aggregations on keys. Neighbours and crossings are
looked up in blocks of the anchors' order with what lies before and after each block, so no file is held
by one task. Groups have a bounded number of lines. Text is shuffled once, to its group.

A stretch without anchors in which one side has over ``reach`` lines more than the other is cut at places
in proportion, within that reach; lines near such a cut may be put together wrongly, but every line is in
exactly one bead at all sizes. Null lines are empty. Line numbers must count from 0 without gaps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators import joins, order

# Probability of each kind of bead, and the variance per character, of the paper.
BEADS = {(1, 1): 0.89, (1, 0): 0.00495, (0, 1): 0.00495, (2, 1): 0.0445, (1, 2): 0.0445, (2, 2): 0.011}
VARIANCE = 6.8
# Lines of a group, and how far from the place in proportion a cut without anchors is looked for.
STRETCH, REACH = 300, 2_000
# Lines whose lengths are compared for a cut.
PROBE = 24
# Lines on either side of the diagonal that the table of a stretch covers.
BAND = 120
# Groups that Python gets together; each has a bounded number of lines, and often few.
GROUPS_AT_ONCE = 32
# Places of a table whose costs are computed together.
CELLS = 1 << 16
# Anchors of a block, and neighbours on either side that may support one.
BLOCK = 2_000
NEIGHBOURS = 3
POINT = ["file", "p", "q"]


def numbers_in(line: Column) -> Column:
    """The numbers of a line as one text; null if it has none."""
    found = F.regexp_extract_all(line, F.lit(r"[0-9]+"), F.lit(0))
    return F.when(F.size(found) > 0, F.array_join(found, " "))


def bead_costs(a: np.ndarray, b: np.ndarray, ratio: float) -> np.ndarray:
    """Minus the logarithm of the chance that texts of lengths ``a`` and ``b`` differ by so much."""
    mean = (a + b / ratio) / 2
    z = np.abs(ratio * a - b) / np.sqrt(VARIANCE * np.where(mean > 0, mean, 1.0))
    # The tail of the normal distribution by Abramowitz and Stegun 26.2.17.
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(mean > 0, z * z / 2 - np.log(2 * 0.3989422804 * poly), 0.0)


def _costs(a: np.ndarray, b: np.ndarray, b2: np.ndarray, first: int, last: int, prior: dict, ratio: float) -> Iterator[dict]:
    """Of each line of a from ``first`` to before ``last``: the costs of beads that end with it, by place in b."""
    one, m = a[first:last, None], len(b)
    two = one + (a[first - 1 : last - 1, None] if first else np.concatenate([[0.0], a[: last - 1]])[:, None])
    found = {(1, 0): np.broadcast_to(prior[1, 0] + bead_costs(one, np.zeros(1), ratio), (last - first, m + 1))}
    for kind, own, other in (((1, 1), one, b), ((1, 2), one, b2), ((2, 1), two, b), ((2, 2), two, b2)):
        cost = prior[kind] + bead_costs(own, other, ratio)
        found[kind] = np.concatenate([np.full((last - first, kind[1]), np.inf), cost], axis=1)
    for row in range(last - first):
        yield {kind: cost[row] for kind, cost in found.items() if first + row or kind[0] == 1}


def beads(a: Sequence[int], b: Sequence[int], ratio: float, band: int = BAND) -> list[tuple[int, int]]:
    """(lines of a, lines of b) of each bead, in order: the least sum of costs.

    The table is filled row by row; of each row, ``band`` places on both sides of the diagonal.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return [(1, 0)] * n + [(0, 1)] * m
    a, b = np.asarray(a, float), np.asarray(b, float)
    b2 = b[:-1] + b[1:]
    zero = np.zeros(m)
    prior = {kind: -math.log(p) for kind, p in BEADS.items()}
    alone = prior[0, 1] + bead_costs(zero, b, ratio)
    run = np.concatenate([[0.0], np.cumsum(alone)])
    wide = band + abs(m - n)
    table = np.full((n + 1, m + 1), np.inf)
    steps: list[dict] = []
    table[0] = np.where(np.arange(m + 1) <= wide, run, np.inf)
    for i in range(1, n + 1):
        if len(steps) < i:
            steps.extend(_costs(a, b, b2, i - 1, min(n, i - 1 + max(1, CELLS // (m + 1))), prior, ratio))
        costs = steps[i - 1]
        best = np.full(m + 1, np.inf)
        for (x, y), cost in costs.items():
            before = np.concatenate([[np.inf] * y, table[i - x][: m + 1 - y]])
            best = np.minimum(best, before + cost)
        middle = i * m / n
        best[: max(0, math.ceil(middle - wide))] = np.inf
        best[math.floor(middle + wide) + 1 :] = np.inf
        # A run of lines of b alone ends here: the least over where it began.
        table[i] = np.minimum(best, run + np.minimum.accumulate(best - run))
        table[i][math.floor(middle + wide) + 1 :] = np.inf
    out, i, j = [], n, m
    while i or j:
        here = table[i][j]
        moves = [] if not i else [k for k in BEADS if k in steps[i - 1] and i >= k[0] and j >= k[1]]
        kinds = [(table[i - x][j - y] + steps[i - 1][x, y][j], (x, y)) for x, y in moves]
        if j:
            kinds.append((table[i][j - 1] + alone[j - 1], (0, 1)))
        # Sums may differ in the last digits; of equal ways the first kind counts.
        chosen = next(kind for cost, kind in kinds if cost <= here + 1e-6 * max(1.0, abs(here)))
        out.append(chosen)
        i, j = i - chosen[0], j - chosen[1]
    return out[::-1]


def _anchors(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, p, q): lines whose key occurs once on each side of a file."""

    def once_only(df: DataFrame, name: str) -> DataFrame:
        keyed = df.filter(F.col("key").isNotNull()).groupBy("file", "key")
        return keyed.agg(F.count("*").alias("n"), F.min("i").alias(name)).filter("n = 1").drop("n")

    return once_only(left, "p").join(once_only(right, "q"), ["file", "key"]).select(*POINT)


def _ranked(points: DataFrame, label: str) -> DataFrame:
    """Points with their rank over all files, written."""
    return order.written(order.dense_index(order.written(points, label), POINT, "rank"), label)


def _supported(points: DataFrame) -> DataFrame:
    """Points with a neighbour that has drifted about as far.

    Each block of the order is looked at with the few points before and after it.
    """
    placed = _ranked(points, "anchors")
    block = F.expr(f"rank div {BLOCK}")
    near = [F.expr(f"greatest(0, rank + {step}) div {BLOCK}") for step in (-NEIGHBOURS, NEIGHBOURS)]
    dealt = placed.withColumn("home", block).withColumn("block", F.explode(F.array_distinct(F.array(block, *near))))
    window = Window.partitionBy("block", "file").orderBy("rank")
    agreed = F.lit(False)
    for step in (s * side for s in range(1, NEIGHBOURS + 1) for side in (1, -1)):
        d_p = F.lag("p", step).over(window) - F.col("p")
        d_q = F.lag("q", step).over(window) - F.col("q")
        agreed = agreed | F.coalesce(F.abs(d_q - d_p) <= 3 + F.abs(d_p) / 3, F.lit(False))
    return dealt.withColumn("agreed", agreed).filter((F.col("block") == F.col("home")) & F.col("agreed")).select(*POINT)


def _uncrossed(points: DataFrame) -> DataFrame:
    """Points that no other crosses: those before are no higher on the right side, those after no lower."""
    blocks = _ranked(points, "anchors").withColumn("block", F.expr(f"rank div {BLOCK}"))
    # One row per file and block.
    ends = blocks.groupBy("file", "block").agg(F.max("q").alias("most"), F.min("q").alias("least"))
    of_file = Window.partitionBy("file").orderBy("block")
    ends = ends.select(
        "file", "block",
        F.max("most").over(of_file.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.min("least").over(of_file.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    window = Window.partitionBy("file", "block").orderBy("rank")
    highest = F.greatest("before", F.max("q").over(window.rowsBetween(Window.unboundedPreceding, -1)))
    lowest = F.least("after", F.min("q").over(window.rowsBetween(1, Window.unboundedFollowing)))
    known = blocks.join(ends, ["file", "block"]).withColumns({"highest": highest, "lowest": lowest})
    good = [F.coalesce(F.col("q") >= F.col("highest"), F.lit(True)), F.coalesce(F.col("q") <= F.col("lowest"), F.lit(True))]
    return known.filter(good[0] & good[1]).select(*POINT)


def _gaps(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """(file, p, q, p_to, q_to): from each point, or a file's start, to the next point or the file's end."""
    starts = sizes.select("file", F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("q"))
    ends = sizes.select("file", F.col("n_left").alias("p"), F.col("n_right").alias("q"))
    ranked = _ranked(points.select(*POINT).unionByName(starts).unionByName(ends).distinct(), "cuts")
    after = ranked.select("file", (F.col("rank") - 1).alias("rank"), F.col("p").alias("p_to"), F.col("q").alias("q_to"))
    return order.written(ranked.join(after, ["file", "rank"]).drop("rank"), "gaps")


def _places(gaps: DataFrame, stretch: int) -> DataFrame:
    """Places at even distances inside the gaps of more than two stretches, in proportion on both sides."""
    n, m = F.col("p_to") - F.col("p"), F.col("q_to") - F.col("q")
    n_cuts = F.expr(f"(greatest(p_to - p, q_to - q) - 1) div {stretch}")
    long = gaps.filter(F.greatest(n, m) > 2 * stretch).withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), n_cuts)))
    share = F.col("k") / (n_cuts + 1)
    return long.select(
        "file", "p_to", "q_to", F.abs(n - m).alias("lacking"), F.col("q").alias("q_from"),
        (F.col("p") + F.floor(n * share)).alias("p"), (F.col("q") + F.floor(m * share)).alias("q"),
    )


def _between(lines: DataFrame, spans: DataFrame, cell: int) -> DataFrame:
    """Lines in each span (file, first, last), joined by cells of ``cell`` lines."""
    cells = spans.filter(F.col("last") >= F.col("first")).withColumn(
        "cell", F.explode(F.expr(f"sequence(first div {cell}, last div {cell})"))
    )
    dealt = lines.withColumn("cell", F.expr(f"i div {cell}"))
    inside = F.col("i").between(F.col("first"), F.col("last"))
    return dealt.join(cells, ["file", "cell"]).filter(inside).drop("first", "last", "cell")


def _cuts_by_length(gaps: DataFrame, left: DataFrame, right: DataFrame, ratio: float, stretch: int, reach: int) -> DataFrame:
    """Cuts at the places in long gaps, each where the lengths of the next lines agree best within reach."""
    places = _places(gaps, stretch).withColumn("w", F.least(F.lit(reach), F.col("lacking") + 32))
    places = order.written(places.withColumn("place", F.monotonically_increasing_id()), "places")
    spans = (
        (left, F.col("p"), F.least(F.col("p") + PROBE, "p_to") - 1),
        (right, F.greatest(F.col("q") - F.col("w"), "q_from"), F.least(F.col("q") + F.col("w") + PROBE, "q_to") - 1),
    )
    rows = None
    for side, (lines, first, last) in enumerate(spans):
        asked = places.select("file", "place", F.col("q"), first.alias("first"), last.alias("last"))
        part = _between(lines.select("file", "i", "length"), asked, 64).select("place", "q", F.lit(side).alias("side"), "i", "length")
        rows = part if rows is None else rows.unionByName(part)

    def best(group: pd.DataFrame) -> pd.DataFrame:
        own, other = (group[group["side"] == side].sort_values("i") for side in (0, 1))
        a, b = own["length"].to_numpy(float), other["length"].to_numpy(float)
        size, found = min(len(a), len(b)), int(group["q"].iloc[0])
        if size:
            seen = np.lib.stride_tricks.sliding_window_view(b, size)
            cost = np.minimum(bead_costs(np.broadcast_to(a[:size], seen.shape), seen, ratio), 8.0).sum(axis=1)
            found = int(other["i"].iloc[int(cost.argmin())])
        return pd.DataFrame({"place": [group["place"].iloc[0]], "found": [found]})

    found = rows.groupBy("place").applyInPandas(best, "place long, found long")
    return places.join(found, "place").select("file", "p", F.col("found").alias("q"))


def _with_groups(gaps: DataFrame, stretch: int) -> DataFrame:
    """Gaps with the number of their group. A group begins at the first gap in each run of ``stretch``
    lines of either side, and so at the start of each file."""
    here, head = F.struct("p", "q"), F.lit(False)
    for side in ("p", "q"):
        run = F.expr(f"{side} div {stretch}").alias("run")
        lead = gaps.groupBy("file", run).agg(F.min(F.struct(F.col("p").alias("lead_p"), F.col("q").alias("lead_q"))).alias(f"lead_{side}"))
        gaps = gaps.withColumn("run", run).join(lead, ["file", "run"]).drop("run")
        head = head | (F.col(f"lead_{side}") == here)
    headed = order.written(gaps.withColumn("head", head.cast("int")).drop("lead_p", "lead_q"), "gaps")
    numbered = order.prefix_sum(headed, POINT, F.col("head"), "before")
    return order.written(numbered.withColumn("group", F.col("before") + F.col("head")).drop("before", "head"), "groups")


def align_drifted(
    left: DataFrame,
    right: DataFrame,
    names: tuple[str, str] = ("en", "ko"),
    index: str = "line_no",
    text: str = "line",
    by: Sequence[str] = (),
    key: Callable[[Column], Column] = numbers_in,
    stretch: int = STRETCH,
    reach: int = REACH,
) -> DataFrame:
    """Beads of two numbered line sets: (by, left_no, n_left, right_no, n_right, and both texts).

    ``by`` names columns that tell files apart; nulls there are equal. The texts of a bead are joined with
    a space, and null where a side has no line. ``left_no`` and ``right_no`` are the first lines, or those
    that would come next.
    """
    by = list(by)
    file = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")

    def prepared(df: DataFrame, label: str) -> DataFrame:
        rows = df.select(file.alias("file"), F.col(index).cast("bigint").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("line"))
        return order.written(rows.withColumns({"length": F.length("line").cast("bigint"), "key": key(F.col("line"))}), label)

    a, b = prepared(left, "left-lines"), prepared(right, "right-lines")
    chars = [df.agg(F.sum("length").alias("s")).first().s or 0 for df in (a, b)]
    ratio = chars[1] / chars[0] if all(chars) else 1.0
    counts = (df.groupBy("file").agg(F.count("*").alias(n)) for df, n in ((a, "n_left"), (b, "n_right")))
    sizes = order.written(next(counts).join(next(counts), "file", "full").fillna(0, ["n_left", "n_right"]), "sizes")

    points = order.written(_uncrossed(_supported(_anchors(a, b))), "anchors")
    more = order.written(_cuts_by_length(_gaps(points, sizes), a, b, ratio, stretch, reach), "anchors")
    points = order.written(points.unionByName(_uncrossed(points.unionByName(more).distinct())).distinct(), "anchors")
    # Where such cuts cross, places in proportion are left; these never do.
    last = _places(_gaps(points, sizes), stretch).select(*POINT)
    gaps = _with_groups(_gaps(points.unionByName(last).distinct(), sizes), stretch)

    spans = gaps.groupBy("file", "group").agg(
        F.min("p").alias("p"), F.min("q").alias("q"), F.max("p_to").alias("p_to"), F.max("q_to").alias("q_to")
    )
    spans = order.written(spans, "groups")
    rows = gaps.select(
        "file", "group", F.lit(2).alias("side"), F.array("p", "p_to", "q", "q_to").alias("gap"),
        F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("string").alias("line"),
    )
    for side, lines, at in ((0, a, "p"), (1, b, "q")):
        asked = spans.select("file", "group", F.col(at).alias("first"), (F.col(f"{at}_to") - 1).alias("last"))
        part = _between(lines.drop("length", "key"), asked, stretch)
        rows = rows.unionByName(part.select("file", "group", F.lit(side).alias("side"), F.lit(None).cast("array<bigint>").alias("gap"), "i", "line"))

    def solve(several: pd.DataFrame) -> pd.DataFrame:
        dealt: dict = {}
        for number, side, name, gap, i, line in zip(*[several[c].tolist() for c in ("group", "side", "file", "gap", "i", "line")]):
            own = dealt.setdefault(number, (name, [], [], []))
            own[1 + side].append((int(i), line) if side < 2 else tuple(gap))
        out: list[tuple] = []
        for name, *sides, gaps_here in dealt.values():
            sides = [sorted(side) for side in sides]
            firsts = [side[0][0] if side else 0 for side in sides]
            texts = [[line for _, line in side] for side in sides]
            for p, p_to, q, q_to in sorted(gaps_here):
                parts = texts[0][p - firsts[0] : p_to - firsts[0]], texts[1][q - firsts[1] : q_to - firsts[1]]
                i = j = 0
                for x, y in beads(*[[len(line) for line in part] for part in parts], ratio):
                    joined = [" ".join(part[at : at + k]) if k else None for part, at, k in zip(parts, (i, j), (x, y))]
                    out.append((name, p + i, x, q + j, y, *joined))
                    i, j = i + x, j + y
        return pd.DataFrame(out, columns=schema.names)

    kinds = (T.StringType(), *(T.LongType(),) * 4, *(T.StringType(),) * 2)
    columns = ("left_no", "n_left", "right_no", "n_right", *names)
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(("file", *columns), kinds)])
    found = rows.groupBy(F.expr(f"group div {GROUPS_AT_ONCE}")).applyInPandas(solve, schema)
    if not by:
        return found.drop("file")
    files = [df.select(file.alias("file"), *[F.col(n).alias(f"by{k}") for k, n in enumerate(by)]).distinct() for df in (left, right)]
    files = order.written(files[0].unionByName(files[1]).distinct(), "files")
    named = joins.lookup(order.written(found, "beads"), files, ["file"])
    return named.select(*[F.col(f"by{k}").alias(name) for k, name in enumerate(by)], *columns)
