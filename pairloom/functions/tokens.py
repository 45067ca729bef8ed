"""Tokenizers as columns: a built-in one made of Spark expressions, or any Python one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def words(col: Column | str) -> Column:
    """Parts of a text between runs of white space."""
    return F.array_remove(F.split(_column(col), r"\s+"), "")


@dataclass(frozen=True)
class Tokenizer:
    """Text to token ids, with the special ids.

    ``encode`` maps an ``array<string>`` column, a list of texts, to ``array<array<int>>``, so that
    one call serves a single text and all messages of a chat alike. ``pad_id`` falls back to
    ``eos_id``, as models without a padding token do.
    """

    encode: Callable[[Column], Column]
    bos_id: int | None = None
    eos_id: int | None = None
    pad_token_id: int | None = None

    @property
    def pad_id(self) -> int:
        if self.pad_token_id is not None:
            return self.pad_token_id
        if self.eos_id is None:
            raise ValueError("the tokenizer has neither a padding nor an end-of-sequence id")
        return self.eos_id

    def ids(self, col: Column | str, bos: bool = False, eos: bool = False) -> Column:
        """Token ids of one text column."""
        ids = self.encode(F.array(_column(col)))[0]
        parts = []
        if bos and self.bos_id is not None:
            parts.append(F.array(F.lit(self.bos_id)))
        parts.append(ids)
        if eos and self.eos_id is not None:
            parts.append(F.array(F.lit(self.eos_id)))
        return F.concat(*parts) if len(parts) > 1 else ids


def word_tokenizer(
    word_id: Callable[[Column], Column],
    bos_id: int | None = None,
    eos_id: int | None = None,
    pad_id: int | None = None,
) -> Tokenizer:
    """One token per word, its id given by a column function of the word."""
    return Tokenizer(
        lambda texts: F.transform(
            texts, lambda text: F.transform(words(text), lambda w: word_id(w).cast("int"))
        ),
        bos_id,
        eos_id,
        pad_id,
    )


def hash_tokenizer(vocabulary: int = 32_000) -> Tokenizer:
    """The default: ids are word hashes; two ids after the vocabulary are begin and end."""
    return word_tokenizer(
        lambda w: F.pmod(F.xxhash64(w), F.lit(vocabulary)),
        bos_id=vocabulary,
        eos_id=vocabulary + 1,
    )


def python_tokenizer(
    factory: Callable[[], Callable[[str], list[int]]],
    bos_id: int | None = None,
    eos_id: int | None = None,
    pad_id: int | None = None,
) -> Tokenizer:
    """Wrap a Python tokenizer. ``factory`` runs once per task; texts arrive in Arrow batches."""

    @F.pandas_udf("array<array<int>>")
    def encode_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for texts in batches:
            yield texts.map(
                lambda row: None
                if row is None
                else [None if text is None else list(encode(text)) for text in row]
            )

    return Tokenizer(encode_batches, bos_id, eos_id, pad_id)
