"""Mixing sources to target weights: entropy balancing.

Each source is to give a number of words, its target. Of all rates w per document that meet the targets,
with 0 <= w <= ``max_copies``, entropy balancing takes those nearest to 1 by relative entropy,
sum of w log w - w + 1. Its dual is convex with one multiplier per source, and gives the rates
w = min(max_copies, exp(m * size / mean size)): exponentially tilted by what a document adds to the
constraint. Newton steps on the dual find the multipliers, all sources at once; a step that leaves the
bracket of a source halves the bracket instead.

The dual looks at a document by source and size only, so each step is one aggregation over the histogram
of (source, size), a narrow table in the shared folder, and a join of one row per source. A hot source
has no more histogram rows than it has sizes, and folds map-side.

Rates become copies by carrying the error: documents of a source, longest first, get the whole number
below or above their rate that keeps words taken nearest to words due. The last and shortest documents
settle what is left. Sources are dealt into buckets of about ``BUCKET`` documents by a hash of the row.

Nulls: a null source is a source of its own; a null text has no words. Documents without words have rate
1 and take nothing. Rows equal in id, source and text are rounded as one run. Empty table: no rows.
Other columns of the input are not looked at. Reruns agree: nothing is drawn at random.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import one_per_copy, saved, text_or_empty, word_count
from pairloom.operators import order

MAX_COPIES = 3.0
BUCKET = 2_000
STEPS = 100
TOLERANCE = 1e-7


def cyclic_weights(sources: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Add weights in turn to sources, each given once, by code point, null last.

    Sources are numbered by ranges, so no task holds them all.
    """
    sources = saved(sources, "sources")
    named, n = order.indexed(sources.filter(F.col("source").isNotNull()), "source", "_place")
    placed = named.unionByName(sources.filter(F.col("source").isNull()).withColumn("_place", F.lit(n).cast("bigint")))
    values = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.get(values, (F.col("_place") % len(weights)).cast("int"))
    return placed.withColumn("weight", weight).drop("_place")


def targets(sources: DataFrame, share: float = 1.0, max_copies: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size, weight).

    ``share`` of all sizes is dealt by weight. No target passes max_copies times its source's size; the
    excess goes to the others by weight, until none is above. Each round is one aggregation.
    """
    rows = saved(sources.withColumn("cap", F.col("source_size") * max_copies), "mix-sources")
    level, full = 0.0, F.lit(False)
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n * share
    while True:
        sums = rows.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("capped"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(full.cast("int")).alias("n"),
        ).first()
        if not sums.weight:
            break
        level = max(0.0, total - sums.capped) / sums.weight
        now_full = full | (F.col("weight") * level > F.col("cap"))
        if rows.filter(now_full).count() == sums.n:
            break
        full = now_full
    target = F.when(full, F.col("cap")).otherwise(F.col("weight") * level)
    return rows.select("source", "source_size", target.alias("target"))


def multipliers(histogram: DataFrame, goals: DataFrame, max_copies: float = MAX_COPIES) -> DataFrame:
    """(source, mean, m): the dual solution. ``histogram`` has (source, size, n), ``goals`` targets."""
    top = math.log(max_copies)
    means = histogram.filter("size > 0").groupBy(F.col("source").alias("s")).agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least")
    )
    # Beyond top * mean / least even the shortest document has the highest rate.
    state = goals.join(means, F.col("source").eqNullSafe(F.col("s"))).select(
        "source",
        "target",
        "mean",
        F.lit(0.0).alias("m"),
        F.lit(float("-inf")).alias("low"),
        (F.lit(top) * F.col("mean") / F.col("least") + 1e-9).alias("high"),
        (F.col("target") >= F.col("source_size") * max_copies).alias("done"),
    )
    state = state.withColumn("m", F.when(F.col("done"), F.col("high")).otherwise(F.col("m")))
    state = saved(state, "mix-step")
    tilt = F.col("m") * F.col("size") / F.col("mean")
    inside = tilt < top
    for _ in range(STEPS):
        if not state.filter(~F.col("done")).count():
            return state.select("source", "mean", "m")
        rate = F.when(inside, F.exp(tilt)).otherwise(max_copies)
        words = F.col("n") * F.col("size") * rate
        slopes = (
            histogram.filter("size > 0")
            .join(
                state.filter(~F.col("done")).select(F.col("source").alias("s"), "mean", "m"),
                F.col("source").eqNullSafe(F.col("s")),
            )
            .groupBy(F.col("source").alias("s"))
            .agg(
                F.sum(words).alias("words"),
                F.sum(F.when(inside, words * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"),
            )
        )
        m, gap = F.col("m"), F.col("words") - F.col("target")
        low = F.when(gap < 0, m).otherwise(F.col("low"))
        high = F.when(gap > 0, m).otherwise(F.col("high"))
        newton = m - gap / F.col("slope")
        halved = F.when(low == float("-inf"), F.least(2 * high, F.lit(-1.0))).otherwise((low + high) / 2)
        step = F.when((F.col("slope") > 0) & (newton > low) & (newton < high), newton).otherwise(halved)
        close = F.abs(gap) <= TOLERANCE * F.col("target")
        moved = state.join(slopes, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source",
            "target",
            "mean",
            F.when(F.col("done") | close, m).otherwise(step).alias("m"),
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
            (F.col("done") | close).alias("done"),
        )
        state = saved(moved, "mix-step")
    return state.select("source", "mean", "m")  # as near as doubles come


def _carry(rows: Iterable[tuple[int, float, int]]) -> list[int]:
    """Copies for each (size, rate, run length), longest first."""
    error, out = 0.0, []
    for size, rate, run in rows:
        if size == 0:
            out.append(run)
            continue
        due = rate * size * run + error
        copies = round(due / size)
        copies = min(max(copies, math.floor(rate) * run), math.ceil(rate - 1e-12) * run)
        error = due - copies * size
        out.append(copies)
    return out


def mix(
    df: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.0,
    max_copies: float = MAX_COPIES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    digest: Column | None = None,
) -> DataFrame:
    """(id, digest, source, size, source_size, target, rate, copies, taken) of each row.

    ``digest`` tells rows of one id apart and is a hash of the text by default; ``taken`` is copies times
    size.
    """
    digest = F.xxhash64(text_or_empty(text_col)) if digest is None else digest
    keys = ["id", "source", "size", "digest"]
    rows = df.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(text_col).alias("size"),
        digest.alias("digest"),
    )
    rows = saved(rows.groupBy(*keys).agg(F.count("*").alias("run")), "mix-rows")
    histogram = saved(rows.groupBy("source", "size").agg(F.sum("run").alias("n")), "mix-sizes")
    sources = histogram.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs")
    )
    goals = saved(
        targets(cyclic_weights(sources.select("source", "source_size"), weights), share, max_copies).join(
            sources.select(F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))
        ).drop("s"),
        "mix-targets",
    )
    found = multipliers(histogram, goals.select("source", "source_size", "target"), max_copies)
    plan = goals.join(found.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    plan = plan.select(
        F.col("source").alias("s"), "source_size", "target", "mean", "m", F.ceil(F.col("docs") / BUCKET).alias("buckets")
    )
    tilt = F.least(F.col("m") * F.col("size") / F.col("mean"), F.lit(math.log(max_copies)))
    rate = F.when(F.col("size") == 0, 1.0).when(tilt >= math.log(max_copies), max_copies).otherwise(F.exp(tilt))
    rated = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        *keys,
        "run",
        "source_size",
        "target",
        rate.alias("rate"),
        F.pmod(F.xxhash64(*keys), F.col("buckets")).alias("bucket"),
    )
    schema = rated.drop("bucket").schema.add("copies", "long")
    arrow_names = [f.name for f in schema.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket may reach over batches."""
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            names = list(zip(batch.column("source").to_pylist(), batch.column("bucket").to_pylist()))
            begin = 0
            for i in range(len(names) + 1):
                if i == len(names) or names[i] != names[begin]:
                    if i > begin:
                        if held and current != names[begin]:
                            yield _rounded(held)
                            held = []
                        current = names[begin]
                        held.append(batch.slice(begin, i - begin))
                    begin = i
        if held:
            yield _rounded(held)

    def _rounded(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        columns = [table.column(name).to_pylist() for name in ("size", "rate", "run")]
        table = table.append_column("copies", pa.array(_carry(zip(*columns)), pa.int64()))
        return table.select(arrow_names).combine_chunks().to_batches()[0]

    copied = (
        rated.repartition("source", "bucket")
        .sortWithinPartitions("source", "bucket", F.col("size").desc(), "digest", "id")
        .mapInArrow(run, schema)
    )
    # A run of equal rows shares its copies out evenly.
    each = one_per_copy(copied.withColumnRenamed("copies", "run_copies"), "run", "place")
    copies = F.expr("run_copies div run + if(place < run_copies % run, 1, 0)")
    return each.select(
        F.col("id").alias(id_col),
        "digest",
        "source",
        "size",
        "source_size",
        "target",
        "rate",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )
