"""User functions over column batches, and batch inference with a pluggable generator."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom import schemas
from pairloom.operators import joins
from pairloom.operators.order import written
from pairloom.sources import versions

# Prompts that a resumable run generates, and stores, together.
ROWS_PER_ROUND = 10_000
# Results, which are texts, that are broadcast; of more, those of hot prompts alone.
RESULTS_PER_BROADCAST = 20_000
_STORED = "digest string, result string"

# A generator takes a list of texts and gives as many results.
Generator = Callable[[list], list]
GeneratorFactory = Callable[[Mapping], Generator]


def map_batches(df: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """Apply a function from one pandas batch to another; rows stay in their partition.

    For what Spark's own expressions cannot say; those are faster.
    """

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def settings_from_env(env: Mapping[str, str] | None = None) -> dict:
    """Generation settings, from the environment where set."""
    env = os.environ if env is None else env
    return {
        "device_map": env.get("DEVICE_MAP", "auto"),
        "max_seq_length": int(env.get("MAX_SEQ_LENGTH", "4096")),
        "max_new_tokens": int(env.get("MAX_NEW_TOKENS", "4096")),
        "temperature": float(env.get("TEMPERATURE", "0.9")),
        "do_sample": False,
    }


def batch_generate(
    df: DataFrame,
    col: str,
    generator_factory: GeneratorFactory,
    params: Mapping | None = None,
    prompt: str | None = None,
    batch_size: int = 16,
    num_partitions: int | None = None,
) -> DataFrame:
    """One result per row, next to its input.

    ``generator_factory(params)`` runs once per task, so a model is loaded once for all rows of a
    partition; rows go to it ``batch_size`` at a time. ``prompt`` names the column to generate from
    when that is not the input itself. ``num_partitions`` spreads a small test split over more
    tasks.
    """
    params = dict(params or {})
    rows = df.select(F.col(col).alias("input"), F.col(prompt or col).alias("prompt"))
    if num_partitions is not None:
        rows = rows.repartition(num_partitions)

    def run(batches: Iterator) -> Iterator:
        generator = None
        for batch in batches:
            if generator is None:
                generator = generator_factory(params)
            prompts = batch["prompt"].tolist()
            results: list = []
            for i in range(0, len(prompts), batch_size):
                results.extend(generator(prompts[i : i + batch_size]))
            if len(results) != len(prompts):
                raise ValueError("the generator must give one result per text")
            yield batch[["input"]].assign(result=results)

    return rows.mapInPandas(run, schemas.RESULT)


def _stored(spark, store: str) -> tuple[int, list[str], DataFrame]:
    """Version and folders of a store, and its results."""
    number, content = versions.read(spark, store)
    folders = (content or {"folders": []})["folders"]
    if not folders:
        return number, [], spark.createDataFrame([], _STORED)
    return number, folders, spark.read.schema(_STORED).parquet(*[f"{store}/{f}" for f in folders])


def resume_generate(
    df: DataFrame,
    col: str,
    generator_factory: GeneratorFactory,
    store: str,
    params: Mapping | None = None,
    prompt: str | None = None,
    batch_size: int = 16,
    num_partitions: int | None = None,
    rows_per_round: int = ROWS_PER_ROUND,
) -> DataFrame:
    """``batch_generate`` that keeps its results in the folder ``store``, and generates only what is not there.

    A result is found by the digest of its prompt and of all params, the model among them, so a store may
    serve many models and runs. Equal prompts are generated once. Prompts go in rounds of about
    ``rows_per_round``; each is stored by a version file that is swapped when the round is done, so a
    run that breaks off loses one round at most. A store has one writer at a time.
    """
    spark = df.sparkSession
    settings = hashlib.sha256(json.dumps(dict(params or {}), sort_keys=True, default=str).encode()).hexdigest()
    text = F.coalesce(F.concat(F.lit("t"), F.col(prompt or col)), F.lit("n"))
    digest = F.sha2(F.concat(F.lit(settings), text), 256)
    own = [] if prompt in (None, col) else [F.col(prompt).alias("prompt")]
    rows = written(df.select(F.col(col).alias("input"), *own, digest.alias("digest")), "prompts")
    asked = rows.select("digest", F.col("prompt" if own else "input").alias("prompt"))
    number, folders, known = _stored(spark, store)
    # What is absent is found by digests alone; only the prompts of these are shuffled, to become one each.
    digests = asked.select("digest").distinct()
    digests = written(digests.join(known.select("digest"), "digest", "left_anti") if folders else digests, "absent")
    rounds = -(-digests.count() // rows_per_round)
    turn = F.pmod(F.xxhash64("digest"), F.lit(max(1, rounds)))
    absent = (joins.lookup(asked, digests, ["digest"]) if folders else asked).dropDuplicates(["digest"])
    # In the order of their rounds, so that a round skips the prompts of the others.
    absent = written(absent.withColumn("turn", turn).sortWithinPartitions("turn"), "absent") if rounds else absent
    for i in range(rounds):
        part = absent.filter(F.col("turn") == i).select(F.struct("digest", "prompt").alias("asked"))
        part = part.select(F.col("asked.prompt").alias("prompt"), F.to_json("asked").alias("asked"))
        made = batch_generate(part, "asked", generator_factory, params, "prompt", batch_size, num_partitions)
        folder = uuid.uuid4().hex
        made.select(F.get_json_object("input", "$.digest").alias("digest"), "result").write.parquet(f"{store}/{folder}", compression="zstd")
        folders = [*folders, folder]
        number = versions.publish(spark, store, {"folders": folders}, number)
    # A store has each digest once: a round takes none that is there, and one writer swaps the version.
    results = _stored(spark, store)[2]
    return joins.lookup(rows.select("input", "digest"), results, ["digest"], "left", RESULTS_PER_BROADCAST).select("input", "result")


def fan_out_models(
    df: DataFrame,
    models: Sequence[Mapping],
    col: str,
    generator_factory: GeneratorFactory,
    params: Mapping | None = None,
    prompt_of: Callable[[DataFrame, Mapping], DataFrame] | None = None,
    batch_size: int = 16,
    num_partitions: int | None = None,
    store: str | None = None,
) -> DataFrame:
    """The same rows through each model: (model, input, result).

    The rows are written to the shared folder once. Every model then has its own branch of the plan, so
    a task only ever loads one model and no row is shuffled to meet it. Each entry of ``models`` has a 'model' name and is merged into the params.
    ``prompt_of(df, model)`` may add a 'prompt' column that fits the model. With ``store`` results are kept
    in that folder, and only what is not there is generated (see ``resume_generate``).
    """
    if not models:
        raise ValueError("no model given")
    df = written(df, "prompts") if len(models) > 1 else df
    result = None
    for model in models:
        rows = df if prompt_of is None else prompt_of(df, model)
        settings, prompt = {**(params or {}), **model}, None if prompt_of is None else "prompt"
        if store is None:
            part = batch_generate(rows, col, generator_factory, settings, prompt, batch_size, num_partitions)
        else:
            part = resume_generate(rows, col, generator_factory, store, settings, prompt, batch_size, num_partitions)
        part = part.select(F.lit(model["model"]).alias("model"), "input", "result")
        result = part if result is None else result.unionByName(part)
    return result
