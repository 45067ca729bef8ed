"""Inputs that Spark derives from the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import order
from pairloom.operators.combine import align_lines

MODELS = [{"model": m} for m in ("Llama-3.2-1B", "Llama-3.2-3B", "Qwen2.5-1.5B", "Qwen2.5-3B")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    """Documents of one language as numbered lines."""
    docs = table(spark, sf_dir, "documents").filter(F.col("lang") == lang)
    return order.dense_index(docs.select("doc_id", F.col("text").alias("line")), "doc_id", "line_no").select(
        "line_no", "line"
    )


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English and French documents paired by position: (line_no, en, ko)."""
    return align_lines(lines_of(spark, sf_dir, "en"), lines_of(spark, sf_dir, "fr"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the next one: (line_no, en, ko). Every document is in some pair."""
    return counted_pairs(spark, sf_dir)[0]


def counted_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The pairs and how many they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("line"))
    lines, n = order.indexed(docs, "doc_id", "line_no")
    lines = lines.select("line_no", "line")
    return align_lines(lines, lines.select((F.col("line_no") - 1).alias("line_no"), "line")), max(0, n - 1)


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the one that follows it, or an empty answer."""
    turns = table(spark, sf_dir, "conversations")
    inputs = turns.select("conv_id", "turn", text_of("text").alias("input_text"))
    answers = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output_text"))
    return inputs.join(answers, ["conv_id", "turn"], "left").withColumn("output_text", text_of("output_text"))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def english() -> Column:
    """Whether a document is English; one without a language is not."""
    return F.col("lang").eqNullSafe("en")


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, doc_id, line_no, en, ko): each line of a document, and its longer words with the first letter at the end."""
    docs = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "en"))
    words = F.filter(F.split(F.lower("en"), r"\s+"), lambda w: F.length(w) > 2)
    turned = F.transform(words, lambda w: F.concat(F.substring(w, 2, 1 << 30), F.substring(w, 1, 1), F.lit("ay")))
    key = F.col("doc_id") * (1 << 20) + F.col("line_no")
    return docs.select(key.alias("key"), "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "en", F.array_join(turned, " ").alias("ko"))


def _marked(lang: str):
    return lambda t: F.concat(F.lit(f"{lang}:"), t)


def responses(
    spark: SparkSession, sf_dir: str, langs: Sequence[str] = ("en", "ko")
) -> DataFrame:
    """Response lines for ten documents each: (batch_id, value).

    Every 13th task is broken, in six ways in turn; every 7th lacks its last target sentence.
    """
    docs = order.dense_index(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    batches = (
        docs.groupBy(F.expr("rn div 10").alias("b"))
        .agg(F.sort_array(F.collect_list(F.struct("rn", "text"))).alias("rows"))
        .select("b", F.transform("rows", lambda r: r["text"]).alias("texts"))
    )
    broken = F.col("b") % 13 == 0
    kind = F.when(broken, F.expr("(b div 13) % 6"))
    shorter = ~broken & (F.col("b") % 7 == 3)
    kept = F.size("texts") - F.when(shorter, 1).otherwise(0)
    content = [F.lit('{"sentences_en":'), F.when(kind == 5, F.lit('"text"')).otherwise(F.to_json("texts"))]
    for lang in langs[1:]:
        target = F.to_json(F.transform(F.slice("texts", F.lit(1), kept), _marked(lang)))
        field = F.concat(F.lit(f',"sentences_{lang}":'), target)
        content.append(F.when(kind == 4, F.lit("")).otherwise(field))
    content.append(F.when(kind == 3, F.lit("} trailing")).otherwise(F.lit("}")))
    choice = F.struct(F.struct(F.concat(*content).alias("content")).alias("message"))
    choices = F.slice(F.array(choice), F.lit(1), F.when(kind == 2, 0).otherwise(1))
    task = F.when(kind == 1, F.lit("task")).otherwise(F.concat(F.lit("task-"), F.col("b").cast("string")))
    line = F.to_json(
        F.struct(
            task.alias("custom_id"),
            F.struct(F.struct(choices.alias("choices")).alias("body")).alias("response"),
        )
    )
    cut = F.when(kind == 0, r"\}$").otherwise("$")
    return batches.select(F.col("b").alias("batch_id"), F.regexp_replace(line, cut, F.lit("")).alias("value"))


def joined(array: str | Column) -> Column:
    """An array as comma-separated text."""
    return F.array_join(F.col(array) if isinstance(array, str) else array, ",")
