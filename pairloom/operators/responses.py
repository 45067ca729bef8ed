"""From response lines to sentence pairs.

A response line is a JSON object whose message content is again JSON, as text. A task is all or
nothing: when any level of it is wrong, it gives no pairs and its raw line is set aside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import constants, schemas
from pairloom.functions.json import single_json
from pairloom.functions.rows import once
from pairloom.operators.combine import dedup_pairs

def parse_responses(
    df: DataFrame, langs: Sequence[str] = ("en", "ko"), raw: str = "value"
) -> DataFrame:
    """Both JSON levels of each response line.

    Gives custom_id, task_idx, one sentences_ array and one n_ count per language, error (null when
    good) and the raw line. Errors, the first that applies: bad_json, bad_custom_id, no_choice,
    bad_inner_json, missing_key, not_array. A good line takes two passes, one per JSON level; only
    where an array is missing are the keys looked at too.
    """
    names = [f"sentences_{lang}" for lang in langs]
    lines = df.select(F.col(raw).alias("raw"))
    outer = once(lines, ["raw"], _outer=single_json(F.col("raw"), schemas.RESPONSE))
    choice = F.get(F.col("_outer.response.body.choices"), F.lit(0))
    outer = outer.select(
        "raw",
        F.col("_outer").isNotNull().alias("_good_json"),
        F.col("_outer.custom_id").alias("custom_id"),
        F.expr("try_cast(get(split(_outer.custom_id, '-'), 1) as bigint)").alias("task_idx"),
        choice["message"]["content"].alias("_content"),
    )
    inner = once(
        outer,
        ["raw", "_good_json", "custom_id", "task_idx", "_content"],
        _inner=single_json(F.col("_content"), schemas.sentences(langs)),
    )
    without = F.lit(False)
    for name in names:
        without = without | F.col(f"_inner.{name}").isNull()
    inner = once(
        inner,
        ["raw", "_good_json", "custom_id", "task_idx", "_content", "_inner"],
        _keys=F.when(F.col("_inner").isNotNull() & without, F.json_object_keys("_content")),
    )
    absent, not_array = F.lit(False), F.lit(False)
    for name in names:
        missing = F.col(f"_inner.{name}").isNull()
        absent = absent | (missing & ~F.coalesce(F.array_contains("_keys", name), F.lit(False)))
        not_array = not_array | missing
    error = (
        F.when(~F.col("_good_json"), "bad_json")
        .when(F.col("task_idx").isNull(), "bad_custom_id")
        .when(F.col("_content").isNull(), "no_choice")
        .when(F.col("_inner").isNull(), "bad_inner_json")
        .when(absent, "missing_key")
        .when(not_array, "not_array")
    )
    checked = inner.withColumn("error", error)
    good = F.col("error").isNull()
    return checked.select(
        "custom_id",
        "task_idx",
        *[F.when(good, F.col(f"_inner.{name}")).alias(name) for name in names],
        *[
            F.when(good, F.array_size(f"_inner.{name}")).cast("bigint").alias(f"n_{lang}")
            for name, lang in zip(names, langs)
        ],
        "error",
        "raw",
    )


def _zip_shortest(columns: dict[str, str]) -> Column:
    """Array of structs, as long as the shortest of the arrays (field name -> array column)."""
    lengths = [F.array_size(c) for c in columns.values()]
    shortest = F.least(*lengths) if len(lengths) > 1 else lengths[0]
    cut = [F.slice(c, F.lit(1), shortest).alias(n) for n, c in columns.items()]
    return F.arrays_zip(*cut)


def explode_pairs(
    parsed: DataFrame, a: str = "sentences_en", b: str = "sentences_ko", names: tuple[str, str] = ("en", "ko")
) -> DataFrame:
    """One row per sentence pair; the shorter array ends a task."""
    # A null array gives no row, as an empty one does.
    pairs = parsed.select(
        "task_idx", F.posexplode(_zip_shortest({names[0]: a, names[1]: b})).alias("pos", "pair")
    )
    return pairs.select(
        "task_idx",
        F.col("pos").cast("bigint").alias("pos"),
        F.col(f"pair.{names[0]}").alias(names[0]),
        F.col(f"pair.{names[1]}").alias(names[1]),
    )


def quarantine(parsed: DataFrame) -> DataFrame:
    """Raw text and reason of every task that gave no pairs."""
    return parsed.filter(F.col("error").isNotNull()).select("raw", F.col("error").alias("reason"))


def first_seen(task_idx: str = "task_idx", pos: str = "pos") -> Column:
    """Task and position as one number in the same order.

    A position is an int, so ten digits hold it, and the decimal is exact for every task index. One
    fixed-width number lets the duplicate filter stay a hash aggregation.
    """
    return (
        F.col(task_idx).cast("decimal(19,0)") * F.lit(10**10).cast("decimal(11,0)")
        + F.col(pos).cast("decimal(10,0)")
    )


def build_pairs(
    df: DataFrame, raw: str = "value", keep_order: bool = False
) -> DataFrame:
    """Response lines to distinct (en, ko) pairs; ``keep_order`` adds the first-seen order."""
    pairs = explode_pairs(parse_responses(df, raw=raw))
    ordered = pairs.select("en", "ko", first_seen().alias("first_seen"))
    unique = dedup_pairs(ordered, ["en", "ko"], "first_seen")
    return unique if keep_order else unique.select("en", "ko")


def missing_tasks(requests: DataFrame, parsed: DataFrame) -> DataFrame:
    """Requests without a good response.

    The answered ids are made distinct first, so an id that was answered very often is folded
    before the join.
    """
    answered = parsed.filter(F.col("error").isNull()).select("custom_id").distinct()
    return requests.join(answered, "custom_id", "left_anti")


def explode_multilingual(
    parsed: DataFrame, langs: Sequence[str] = constants.MULTI_LANGS
) -> DataFrame:
    """One row per sentence and target language; the first language is the source."""
    names = {f"s{i}": f"sentences_{lang}" for i, lang in enumerate(langs)}
    rows = parsed.select("task_idx", F.posexplode(_zip_shortest(names)).alias("pos", "row"))
    targets = F.array(
        *[
            F.struct(F.lit(lang).alias("lang"), F.col(f"row.s{i}").alias("target"))
            for i, lang in enumerate(langs)
            if i > 0
        ]
    )
    return rows.select(
        "task_idx",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("row.s0").alias("source"),
        F.explode(targets).alias("t"),
    ).select("task_idx", "pos", F.col("t.lang").alias("lang"), "source", F.col("t.target").alias("target"))


def bidirectional_examples(
    df: DataFrame, a: str = "en", b: str = "ko", keep: Sequence[str] = ()
) -> DataFrame:
    """Each pair as two instruction examples, one per direction."""
    def example(source: str, target: str) -> Column:
        return F.struct(
            F.col(source).alias("input_text"),
            F.col(target).alias("output_text"),
            F.lit(f"{source}-{target}").alias("direction"),
        )

    both = F.explode(F.array(example(a, b), example(b, a))).alias("e")
    return df.select(*keep, both).select(*keep, "e.input_text", "e.output_text", "e.direction")
