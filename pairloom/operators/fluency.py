"""How much a text looks like the others: a character n-gram model with Kneser-Ney discounts.

Counts come from aggregations over all texts. The highest order counts occurrences; each lower order counts
in how many different characters' wake a gram stands. A count above a discount goes to the gram, and what
is discounted goes to the order below (R. Kneser and H. Ney, Improved backing-off for m-gram language
modeling, 1995; the discount is n1 / (n1 + 2 n2) of each order).

How the work is spread: grams fold within a task before they are shuffled, so a frequent gram is no hot
key. Tables have one row per different gram, not per text. A text's grams are folded where the text is read,
in time that grows as its length, and looked up by a join that broadcasts the entries of hot grams.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators import joins, order

ORDER = 4
# Stand before the first and after the last character of a text.
START, END = "\u0002", "\u0003"
# Characters whose grams are folded together.
CHARS_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Model:
    """Of each order, from 1: grams (gram, p) and contexts (context, back); and the number of characters."""

    grams: list[DataFrame]
    contexts: list[DataFrame]
    n_chars: int


def _folded(texts: list[tuple[int, str]], size: int) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(number, grams, place of the gram, n): the different grams of numbered texts, and how often each has them."""
    points = np.frombuffer("".join(text for _, text in texts).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(text) for _, text in texts])
    chars, codes = np.unique(points, return_inverse=True)
    kept, first = [np.arange(len(chars))], codes
    for k in range(1, size):
        # What stands in the wake of each place, told apart by one number; numbers stay below the places' own.
        pairs, codes = np.unique(codes[:-1] * len(chars) + first[k:], return_inverse=True)
        kept.append(pairs)
    starts = np.cumsum(lengths) - lengths
    counts = np.maximum(lengths - size + 1, 0)
    inside = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    owners = np.repeat(np.array([number for number, _ in texts]), counts)
    keys, n = np.unique(owners * len(kept[-1]) + codes[inside], return_counts=True)
    used, place = np.unique(keys % len(kept[-1]), return_inverse=True)
    columns, code = [], used
    for pairs in reversed(kept[1:]):
        code, last = np.divmod(pairs[code], len(chars))
        columns.append(chars[last])
    columns.append(chars[code])
    joined = np.stack(columns[::-1], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return keys // len(kept[-1]), [joined[i : i + size] for i in range(0, len(joined), size)], place, n


def _grams(df: DataFrame, text: str, size: int, row: str | None = None) -> DataFrame:
    """(row, gram, n): the grams of each text, each ending in one of its characters or the end mark.

    They are folded within some texts, or where ``row`` names a key within each; what of a gram lies in
    different parts is not put together.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.Array, texts: list[tuple[int, str]]) -> pa.RecordBatch:
            number, grams, place, n = _folded(texts, size)
            own = {"row": rows.take(pa.array(number))} if row is not None else {}
            return pa.RecordBatch.from_pydict({**own, "gram": pa.array(grams).take(pa.array(place)), "n": n})

        for batch in batches:
            waiting, chars = [], 0
            for number, value in enumerate(batch.column(batch.num_columns - 1)):
                padded = START * (size - 1) + (value.as_py() or "") + END
                # Parts of a long text overlap by what a gram begins with.
                for at in range(0, len(padded) - size + 1, CHARS_AT_ONCE):
                    part = padded[at : at + CHARS_AT_ONCE + size - 1]
                    waiting.append((number if row is not None else 0, part))
                    chars += len(part)
                    if chars >= CHARS_AT_ONCE:
                        yield out(batch.column(0), waiting)
                        waiting, chars = [], 0
            if waiting:
                yield out(batch.column(0), waiting)

    asked = df.select(*([F.col(row).alias("row")] if row is not None else []), F.col(text).alias("text"))
    own = f"row {asked.schema['row'].dataType.simpleString()}, " if row is not None else ""
    return asked.mapInArrow(run, f"{own}gram string, n bigint")


def _start(gram: str = "gram") -> Column:
    return F.expr(f"substring({gram}, 1, length({gram}) - 1)")


def _rest(gram: str = "gram") -> Column:
    return F.expr(f"substring({gram}, 2)")


def learn(df: DataFrame, text: str = "text", size: int = ORDER) -> Model:
    """The model of a corpus. A null text is an empty one."""
    counts = _grams(df, text, size).groupBy("gram").agg(F.sum("n").alias("c"))
    tables = [order.written(counts, "grams")]
    for _ in range(size - 1):
        lower = tables[0].groupBy(_rest().alias("gram")).agg(F.count("*").alias("c"))
        tables.insert(0, order.written(lower, "grams"))
    n_chars = tables[0].count()
    grams, contexts = [], []
    for table in tables:
        ones = table.agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
        discount = ones.n1 / (ones.n1 + 2 * ones.n2) if ones.n1 and ones.n2 else 0.5
        kept = table.groupBy(_start().alias("context")).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
        kept = order.written(kept.withColumn("back", discount * F.col("kinds") / F.col("total")), "contexts")
        own = order.written(table.withColumns({"context": _start(), "rest": _rest()}), "grams")
        found = joins.lookup(own, kept, ["context"])
        if grams:
            found = joins.lookup(order.written(found, "grams"), grams[-1].select(F.col("gram").alias("rest"), F.col("p").alias("below")), ["rest"])
        else:
            found = found.withColumn("below", F.lit(1.0 / max(1, n_chars)))
        p = F.greatest(F.col("c") - discount, F.lit(0.0)) / F.col("total") + F.col("back") * F.col("below")
        grams.append(order.written(found.select("gram", p.alias("p")), "grams"))
        contexts.append(kept.select("context", "back"))
    return Model(grams, contexts, n_chars)


def chances(grams: DataFrame, model: Model) -> DataFrame:
    """(gram, p) of distinct grams of the model's order, seen or not."""
    size = len(model.grams)
    wanted = [order.written(grams.select("gram").distinct(), "grams")]
    for _ in range(size - 1):
        wanted.insert(0, order.written(wanted[0].select(_rest().alias("gram")).distinct(), "grams"))
    found = None
    for own, table, contexts in zip(wanted, model.grams, model.contexts):
        rows = joins.lookup(own, table, ["gram"], "left").withColumns({"context": _start(), "rest": _rest()})
        rows = joins.lookup(order.written(rows, "grams"), contexts, ["context"], "left")
        if found is None:
            rows = rows.withColumn("below", F.lit(1.0 / max(1, model.n_chars)))
        else:
            rows = joins.lookup(order.written(rows, "grams"), found.select(F.col("gram").alias("rest"), F.col("p").alias("below")), ["rest"])
        p = F.coalesce(F.col("p"), F.coalesce("back", F.lit(1.0)) * F.col("below"))
        found = order.written(rows.select("gram", p.alias("p")), "grams")
    return found


def score(df: DataFrame, model: Model, row: str, text: str = "text") -> DataFrame:
    """(row, n_chars, fluency): the mean logarithm, base two, of the chance of each character and of the
    text's end. ``row`` is a unique key."""
    folded = order.written(_grams(df, text, len(model.grams), row), "text-grams")
    known = joins.lookup(folded, chances(folded, model), ["gram"])
    mean = F.sum(F.col("n") * F.log2("p")) / F.sum("n")
    return known.groupBy(F.col("row").alias(row)).agg((F.sum("n") - 1).alias("n_chars"), mean.alias("fluency"))
