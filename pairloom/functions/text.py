"""Plain text columns: trimming and the fixed instruction prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom import constants

# Unicode white space plus the four separator control characters that Python's strip() also drops.
# A run inside the text is tried once, at its start, and never given back: time stays linear.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]++|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++$"


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    """Drop white space at both ends (``trim`` would drop only U+0020)."""
    return F.regexp_replace(_column(col), _EDGE_SPACE, "")


def format_prompt(source: Column | str, target: Column | str) -> Column:
    """Instruction prompt with source and target text in their slots."""
    before, between, after = constants.PROMPT_TEMPLATE.split("{}")
    return F.concat(
        F.lit(before), _column(source), F.lit(between), _column(target), F.lit(after)
    )


def prompt_only(source: Column | str) -> Column:
    """The same prompt with an empty target slot."""
    return format_prompt(source, F.lit(""))


def append_eos(col: Column | str, eos: str) -> Column:
    """Text followed by the end-of-sequence token's text."""
    return F.concat(_column(col), F.lit(eos))


def extract_answer(col: Column | str, marker: str = constants.ANSWER_MARKER) -> Column:
    """What follows the last marker; the whole text when there is none."""
    return F.substring_index(_column(col), marker, -1)
