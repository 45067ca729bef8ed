"""From pairs to training features, one function per training recipe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import chat
from pairloom.functions.text import append_eos, format_prompt, prompt_only
from pairloom.functions.tokens import Tokenizer
from pairloom.operators import chats, features, sample, select


def causal_features(
    pairs: DataFrame,
    tokenizer: Tokenizer,
    max_length: int = 2048,
    bos_offset: int = 0,
    mask_padding: bool = False,
) -> DataFrame:
    """Full fine-tuning: padded prompt-and-target ids with the prompt masked in the labels."""
    rows = pairs.withColumns(
        {"_prompt": prompt_only("en"), "_full": format_prompt("en", "ko")}
    )
    rows = features.tokenize(rows, "_prompt", tokenizer, name="_prompt_ids")
    rows = features.tokenize(rows, "_full", tokenizer, add_special=True)
    rows = features.pad_truncate(rows, max_length, tokenizer.pad_id)
    rows = features.mask_prompt(rows, "_prompt_ids", bos_offset=bos_offset, mask_padding=mask_padding)
    return rows.drop("_prompt", "_full", "_prompt_ids")


def causal_datasets(
    pairs: DataFrame,
    tokenizer: Tokenizer,
    key: str | Sequence[str],
    max_examples: int | None = None,
    n_validation: int = 2000,
    seed: int = 42,
    max_length: int = 2048,
    n_rows: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Cap, split, then features for both parts. ``n_rows`` is the number of pairs where known."""
    if max_examples:
        pairs, n_rows = select.counted_head(pairs, max_examples, key, n_rows=n_rows)
    train, validation = sample.split_count(pairs, n_validation, seed, key, n_rows=n_rows)
    return (
        causal_features(train, tokenizer, max_length),
        None if validation is None else causal_features(validation, tokenizer, max_length),
    )


def packed_blocks(
    pairs: DataFrame,
    tokenizer: Tokenizer,
    order_by: str | Sequence[str],
    eos: str,
    block: int = 2048,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Adapter recipe 1: prompt, target and end token as text, packed into full blocks."""
    text = pairs.withColumn("_text", append_eos(format_prompt("en", "ko"), eos))
    ids = features.tokenize(text, "_text", tokenizer)
    return features.pack_sequences(ids, block, order_by, rows_per_range=rows_per_range)


def chat_texts(examples: DataFrame, model: str) -> DataFrame:
    """Adapter recipe 2, text side: messages and their text in the model's template."""
    return chats.render_chat(chats.build_messages(examples), chat.template_name(model))


def chat_batches(
    examples: DataFrame,
    tokenizer: Tokenizer,
    model: str,
    order_by: str | Sequence[str],
    batch_size: int = 32,
    max_length: int = 4096,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Adapter recipe 2: response-only labels, cut to length, padded per training batch."""
    rows = features.mask_responses_only(
        chats.build_messages(examples), tokenizer, template=chat.template_name(model)
    )
    rows = rows.withColumns(
        {c: F.slice(c, 1, max_length) for c in ("input_ids", "labels")}
    )
    return features.pad_to_batch_max(
        rows, batch_size, order_by, tokenizer.pad_id, rows_per_range=rows_per_range
    )
