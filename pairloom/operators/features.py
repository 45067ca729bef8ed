"""Token features: ids, padding, label masks, packed blocks.

Row-wise steps are column expressions without a shuffle. Packing and per-batch padding depend on
row order and go through the key ranges of ``order``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom import constants
from pairloom.functions import chat
from pairloom.functions.tokens import Tokenizer, hash_tokenizer
from pairloom.operators import order


def tokenize(
    df: DataFrame,
    col: str,
    tokenizer: Tokenizer | None = None,
    add_special: bool = False,
    name: str = "input_ids",
) -> DataFrame:
    """Add the token ids of a text column; ``add_special`` adds begin and end ids."""
    tokenizer = tokenizer or hash_tokenizer()
    return df.withColumn(name, tokenizer.ids(F.col(col), bos=add_special, eos=add_special))


def _repeat(value: int, count: Column) -> Column:
    # A count below zero gives an empty array.
    return F.array_repeat(F.lit(value), count)


def pad_truncate(
    df: DataFrame, max_length: int, pad_id: int, ids: str = "input_ids", keep_end: int = 0
) -> DataFrame:
    """Cut or right-pad the ids to ``max_length`` and add the attention mask.

    The cut takes whatever is last, an end id too. With ``keep_end`` so many ids from the end stay, and
    the cut is made before them, as by tokenizers that reserve room for special ids.
    """
    if not 0 <= keep_end < max_length:
        raise ValueError("keep_end must be below max_length")
    kept = F.when(F.col(ids).isNotNull(), F.least(F.array_size(ids), F.lit(max_length)))
    gap = F.lit(max_length) - kept
    head = F.slice(ids, 1, max_length)
    if keep_end:
        ended = F.concat(F.slice(ids, 1, max_length - keep_end), F.slice(ids, -keep_end, keep_end))
        head = F.when(F.array_size(ids) > max_length, ended).otherwise(F.col(ids))
    return df.withColumns(
        {
            ids: F.concat(head, _repeat(pad_id, gap)),
            "attention_mask": F.concat(_repeat(1, kept), _repeat(0, gap)),
        }
    )


def mask_prompt(
    df: DataFrame,
    prompt_ids: str,
    ids: str = "input_ids",
    bos_offset: int = 0,
    mask_padding: bool = False,
) -> DataFrame:
    """Labels: the ids with the prompt's places replaced by -100.

    The prompt is counted without special ids. With a begin id in front of the full text the mask
    so ends one token early; ``bos_offset=1`` corrects that. Padding keeps its id in the labels
    unless ``mask_padding`` is set.
    """
    length = F.array_size(ids)
    masked = F.least(F.array_size(prompt_ids) + F.lit(bos_offset), length)
    rest = F.slice(F.col(ids), masked + 1, length - masked)
    if mask_padding:
        real = F.greatest(masked, F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x))
        rest = F.concat(
            F.slice(F.col(ids), masked + 1, real - masked),
            _repeat(constants.IGNORE_INDEX, length - real),
        )
    return df.withColumn("labels", F.concat(_repeat(constants.IGNORE_INDEX, masked), rest))


def mask_responses_only(
    df: DataFrame,
    tokenizer: Tokenizer | None = None,
    messages: str = "messages",
    template: str | None = None,
) -> DataFrame:
    """Ids of a whole chat, and labels that are -100 outside the assistant's answers.

    Roles are known from the messages, so no marker is searched for in the text. With a template,
    its begin text, each message's header and its end are tokenised too; as in a search by markers,
    an answer's label starts after its header and includes its end. The parts are tokenised one by
    one.
    """
    tokenizer = tokenizer or hash_tokenizer()
    chat_of = F.col(messages)
    if template is None:
        bodies, headers, begin = F.transform(chat_of, lambda m: m["content"]), None, ""
    else:
        layout = constants.CHAT_TEMPLATES[template]
        bodies = F.transform(chat_of, lambda m: F.concat(m["content"], F.lit(layout["end"])))
        headers = F.transform(chat_of, lambda m: chat.message_header(m["role"], template))
        begin = layout["begin"]
    # One call encodes all texts of a row: begin, then all headers, then all bodies.
    texts = bodies
    if headers is not None:
        texts = F.concat(F.array(F.lit(begin)), headers, bodies)
    count = F.array_size(chat_of)
    df = df.withColumn("_ids", tokenizer.encode(texts))
    if headers is None:
        parts = F.transform(
            chat_of, lambda m, i: F.struct(m["role"].alias("role"), F.array().cast("array<int>").alias("h"), F.get("_ids", i).alias("b"))
        )
        first = F.array().cast("array<int>")
    else:
        parts = F.transform(
            chat_of,
            lambda m, i: F.struct(
                m["role"].alias("role"),
                F.get("_ids", i + 1).alias("h"),
                F.get("_ids", i + 1 + count).alias("b"),
            ),
        )
        first = F.get("_ids", F.lit(0))
    df = df.withColumn("_parts", parts).withColumn("_first", first)
    ids = F.concat(
        F.col("_first"), F.flatten(F.transform("_parts", lambda p: F.concat(p["h"], p["b"])))
    )
    labels = F.concat(
        _repeat(constants.IGNORE_INDEX, F.array_size("_first")),
        F.flatten(
            F.transform(
                "_parts",
                lambda p: F.concat(
                    _repeat(constants.IGNORE_INDEX, F.array_size(p["h"])),
                    F.when(p["role"] == "assistant", p["b"]).otherwise(
                        _repeat(constants.IGNORE_INDEX, F.array_size(p["b"]))
                    ),
                ),
            )
        ),
    )
    return df.withColumns({"input_ids": ids, "labels": labels}).drop("_ids", "_parts", "_first")


def mask_text_responses(
    df: DataFrame, col: str, instruction: str, response: str, tokenizer: Tokenizer | None = None
) -> DataFrame:
    """Ids of a rendered chat text, and labels that are -100 outside the answers.

    An answer begins after a ``response`` marker and ends before the next ``instruction`` marker or
    with the text. A text without a response marker is masked whole. The parts between are tokenised
    one by one.
    """
    tokenizer = tokenizer or hash_tokenizer()
    turns = F.split(F.col(col), re.escape(response), -1)
    # Of each turn, the answer and what comes after it up to the end of the next response marker.
    texts = F.flatten(
        F.transform(
            turns,
            lambda turn, i: F.array(
                F.when(i == 0, "").otherwise(F.substring_index(turn, instruction, 1)),
                F.concat(
                    F.when(i == 0, turn).otherwise(
                        F.substring(turn, F.length(F.substring_index(turn, instruction, 1)) + 1, F.length(turn))
                    ),
                    F.when(i < F.array_size(turns) - 1, response).otherwise(""),
                ),
            ),
        )
    )
    masked = F.transform(
        F.col("_ids"), lambda ids, i: F.when(i % 2 == 0, ids).otherwise(_repeat(constants.IGNORE_INDEX, F.array_size(ids)))
    )
    rows = df.withColumn("_ids", tokenizer.encode(texts))
    return rows.withColumns({"input_ids": F.flatten("_ids"), "labels": F.flatten(masked)}).drop("_ids")


def pack_sequences(
    df: DataFrame,
    block: int,
    order_by: str | Sequence[str],
    ids: str = "input_ids",
    eos_id: int | None = None,
    rows_per_range: int | None = None,
    drop_tail: bool = True,
) -> DataFrame:
    """Put all token arrays end to end and cut them into blocks; the short tail goes unless kept.

    Keys and ids are first written to the shared folder, so that no text is tokenised twice.

    Each row's place is the running total of lengths before it. A row is sliced into the pieces
    that fall into each block, never into single tokens, and a block collects at most ``block``
    pieces. A block inside one range is put together where the range is. Which blocks cross into
    the next range is known from the ranges' starts; only rows that reach into such a block are
    shuffled again. ``eos_id`` is put after each row.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    block = int(block)
    tokens = F.col(ids) if eos_id is None else F.concat(ids, F.array(F.lit(eos_id)))
    narrow = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], tokens.alias("_ids"))
    narrow = order.written(narrow, "tokens")
    length = F.coalesce(F.array_size("_ids"), F.lit(0))
    ranges = order.plan_ranges(
        narrow, [f"_k{i}" for i in range(len(keys))], value=length, rows_per_range=rows_per_range
    )
    placed = (
        order.running_total(narrow, ranges, length, "_start")
        .filter(length > 0)
        .withColumns(
            {
                "_end": F.col("_start") + F.array_size("_ids"),
                "_first": F.expr(f"_start div {block}"),
                "_last": F.expr(f"(_start + array_size(_ids) - 1) div {block}"),
            }
        )
    )

    tail = ranges.total // block  # the block that may be short

    def piece(b: Column) -> Column:
        start = F.greatest(F.col("_start"), b * block)
        offset = start - F.col("_start")
        count = F.least(F.col("_end"), (b + 1) * block) - start
        part = F.slice(F.col("_ids"), (offset + 1).cast("int"), count.cast("int"))
        return F.struct(b.alias("block"), F.struct(start.alias("at"), part.alias("part")).alias("piece"))

    def blocks(rows: DataFrame, numbers: Column, *groups: str) -> DataFrame:
        pieces = rows.select(*groups, F.inline(F.transform(numbers, piece)))
        joined = F.flatten(F.transform(F.sort_array("pieces"), lambda p: p["part"]))
        return (
            pieces.groupBy(*groups, "block")
            .agg(F.collect_list("piece").alias("pieces"), F.sum(F.array_size("piece.part")).alias("n"))
            .filter((F.col("n") == block) | ((F.col("block") == tail) & F.lit(not drop_tail)))
            .select("block", joined.alias("input_ids"))
        )

    inside = blocks(placed, F.sequence("_first", "_last"), order.RANGE)
    if not ranges.cuts:
        return inside

    crossing = [start // block if start % block else None for start in ranges.starts]
    ends = placed.withColumns(
        {"_left": ranges.value(crossing), "_right": ranges.value([*crossing[1:], None])}
    ).filter((F.col("_first") == F.col("_left")) | (F.col("_last") == F.col("_right")))
    numbers = F.filter(
        F.array_distinct(F.array("_left", "_right")),
        lambda b: b.between(F.col("_first"), F.col("_last")),
    )
    return inside.unionByName(blocks(ends, numbers))


def pad_to_batch_max(
    df: DataFrame,
    batch_size: int,
    order_by: str | Sequence[str],
    pad_id: int,
    ids: str = "input_ids",
    labels: str | None = "labels",
    rows_per_range: int | None = None,
) -> DataFrame:
    """Pad each run of ``batch_size`` rows to its longest one; labels are padded with -100.

    Adds rn, batch_id and the attention mask. Ranges are aligned to the batch size, so batches need
    no shuffle beyond the one that numbers the rows.
    """
    ranges = order.plan_ranges(df, order_by, align=batch_size, rows_per_range=rows_per_range)
    rows = order.number_rows(df, ranges, "rn").withColumn(
        "batch_id", F.expr(f"rn div {int(batch_size)}")
    )
    length = F.array_size(ids)
    batch = Window.partitionBy(order.RANGE, "batch_id")
    return padding(rows, F.max(length).over(batch) - length, pad_id, ids, labels).drop(order.RANGE)


def padding(df: DataFrame, gap: Column, pad_id: int, ids: str = "input_ids", labels: str | None = "labels") -> DataFrame:
    """Add ``gap`` pad ids to each row, and the attention mask; labels are padded with -100."""
    rows = df.withColumn("_gap", gap.cast("int"))
    columns = {
        ids: F.concat(ids, _repeat(pad_id, F.col("_gap"))),
        "attention_mask": F.concat(_repeat(1, F.array_size(ids)), _repeat(0, F.col("_gap"))),
    }
    if labels is not None:
        columns[labels] = F.concat(labels, _repeat(constants.IGNORE_INDEX, F.col("_gap")))
    return rows.withColumns(columns).drop("_gap")
