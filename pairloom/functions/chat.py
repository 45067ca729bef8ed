"""Chat messages, template choice and rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom import constants


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(
    source: Column | str,
    target: Column | str | None = None,
    system_prompt: str = constants.CHAT_SYSTEM_PROMPT,
) -> Column:
    """System and user message, and the assistant's when a target is given."""
    parts = [
        _message("system", F.lit(system_prompt)),
        _message("user", F.concat(F.lit(constants.CHAT_USER_PREFIX), _column(source))),
    ]
    if target is not None:
        parts.append(
            _message("assistant", F.concat(F.lit(constants.CHAT_ASSISTANT_PREFIX), _column(target)))
        )
    return F.array(*parts)


def template_for_model(
    model: Column | str,
    default: str | None = None,
    routes: Sequence[tuple[str, str]] = constants.MODEL_ROUTES,
) -> Column:
    """Template name for a model name, whatever its case.

    An unknown model gives ``default``; without one the query fails and names the model.
    """
    model = _column(model)
    lower = F.lower(model)
    choice = F
    for part, template in routes:
        choice = choice.when(lower.contains(part), F.lit(template))
    if default is not None:
        return choice.otherwise(F.lit(default))
    message = F.concat(F.lit("no chat template for model: "), F.coalesce(model, F.lit("NULL")))
    return choice.otherwise(F.raise_error(message).cast("string"))


def template_name(
    model: str,
    default: str | None = None,
    routes: Sequence[tuple[str, str]] = constants.MODEL_ROUTES,
) -> str:
    """``template_for_model`` for one known name, for use while a plan is being built."""
    for part, template in routes:
        if part in model.lower():
            return template
    if default is None:
        raise ValueError(f"no chat template for model: {model}")
    return default


def message_header(role: Column, template: str) -> Column:
    """Text in front of a message's content."""
    before, after = constants.CHAT_TEMPLATES[template]["header"].split("{role}")
    return F.concat(F.lit(before), role, F.lit(after))


def render_chat(
    messages: Column | str, template: str, add_generation_prompt: bool = False
) -> Column:
    """One training or inference string from a message array; null if any content is."""
    layout = constants.CHAT_TEMPLATES[template]
    parts = F.transform(
        _column(messages),
        lambda m: F.concat(
            message_header(m["role"], template), m["content"], F.lit(layout["end"])
        ),
    )
    # Joined one by one: a null content makes the text null, where array_join would skip it.
    text = F.aggregate(parts, F.lit(layout["begin"]), lambda text, part: F.concat(text, part))
    if add_generation_prompt:
        text = F.concat(text, message_header(F.lit("assistant"), template))
    return text
