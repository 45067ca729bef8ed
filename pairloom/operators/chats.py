"""Chat operators on whole frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom import constants
from pairloom.functions import chat


def build_messages(
    df: DataFrame,
    system_prompt: str = constants.CHAT_SYSTEM_PROMPT,
    with_target: bool = True,
    source: str = "input_text",
    target: str = "output_text",
    name: str = "messages",
) -> DataFrame:
    """Add the message array of an instruction example; without target for inference."""
    return df.withColumn(
        name, chat.chat_messages(F.col(source), F.col(target) if with_target else None, system_prompt)
    )


def render_chat(
    df: DataFrame,
    template: str,
    messages: str = "messages",
    add_generation_prompt: bool = False,
    name: str = "text",
) -> DataFrame:
    """Add the rendered text of a message array."""
    return df.withColumn(name, chat.render_chat(messages, template, add_generation_prompt))
