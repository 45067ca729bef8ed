"""Batch inference of several models over a test split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom import constants
from pairloom.functions import chat
from pairloom.operators import chats, generate


def evaluate_models(
    test: DataFrame,
    models: Sequence[Mapping],
    generator_factory: generate.GeneratorFactory,
    params: Mapping | None = None,
    add_generation_prompt: bool = False,
    num_partitions: int | None = None,
    store: str | None = None,
) -> DataFrame:
    """(model, input, result) for each test row and model; prompts follow each model's template.

    With ``store`` a run that broke off goes on where it was (see ``generate.resume_generate``).
    """

    def prompt_of(df: DataFrame, model: Mapping) -> DataFrame:
        template = model.get("template") or chat.template_name(
            model["model"], constants.EVALUATION_DEFAULT, constants.EVALUATION_ROUTES
        )
        messages = chats.build_messages(df, with_target=False)
        return chats.render_chat(
            messages, template, add_generation_prompt=add_generation_prompt, name="prompt"
        )

    return generate.fan_out_models(
        test.select(F.col("input_text")),
        models,
        "input_text",
        generator_factory,
        params,
        prompt_of=prompt_of,
        num_partitions=num_partitions,
        store=store,
    )
