"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, documents, folder of the tables), whose result is written and read
again as the next one's documents. All but the last keep the columns of documents. Decisions:

1. language_id drops documents without a letter or of no learned language (coverage below MIN_COVERAGE);
2. line_dedup drops a source's boilerplate lines, and documents that consisted of nothing else. Copies and
   near copies, which are in one SimHash class, count as one page, so that their lines are no boilerplate
   for that, and they reach stage 3;
3. simhash_dedup keeps one document of each near-duplicate class, the one with the smallest id;
4. mix_sources repeats or drops documents so that sources meet their targets;
5. pack puts tokens into sequences: one row per piece.

Null and empty texts go in stage 1. Of rows equal in all columns stage 3 keeps one, and stage 4 shares
their copies. Empty tables stay empty. Extra columns of the input are not carried on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import pairloom
from pairloom.llm import langid, line_dedup, mixing, packing, simhash
from pairloom.llm.common import arrow_bytes, saved

# Python workers may start in another folder; send functions of the package along with the job.
cloudpickle.register_pickle_by_value(pairloom)

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Share of a text's n-grams that its language must know.
MIN_COVERAGE = 0.3
# Not expressible in SQL: tokenizers, Newton steps and packing.
ORACLE_SQL = None


def _digest():
    """Tells rows apart that differ in any column."""
    return F.xxhash64(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    found = langid.predict(docs, langid.learn(docs), carry=COLUMNS)
    known = (F.col("lang_pred") != langid.UNDECIDED) & (F.col("coverage") >= MIN_COVERAGE)
    return found.filter(known).select(*COLUMNS)


def _text_classes(docs: DataFrame) -> DataFrame:
    """(page, class) of each text that has near copies; pages are digests of texts, one of them names a class."""
    texts = docs.select(F.xxhash64("text").alias("page"), "text")
    # Python workers, and Arrow in the JVM, keep what their largest batch took.
    with arrow_bytes(docs.sparkSession):
        prints = saved(simhash.fingerprints(texts, ["page"]).distinct(), "page-prints")
    classed = simhash.print_classes(prints.select("fp").distinct())
    several = prints.join(classed, "fp").select("page", "class_fp")
    names = several.groupBy("class_fp").agg(F.min("page").alias("class"), F.count("*").alias("n")).filter("n > 1")
    return saved(several.join(names, "class_fp").select("page", "class"), "page-classes")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    cleaned = line_dedup.drop_site_lines(
        docs,
        F.col("source"),
        keep=["doc_id", "lang", "source", "n_chars"],
        page=F.xxhash64("text"),
        classes=_text_classes(docs),
    )
    emptied = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"\S")
    return cleaned.filter(~F.coalesce(emptied, F.lit(False))).select(
        "doc_id",
        "text",
        "lang",
        "source",
        F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint").alias("n_chars"),
    )


def _once_if_repeated(rows: DataFrame, repeated: bool) -> DataFrame:
    """One of the rows that are equal in all columns; ``rows`` says in ``n_rows`` how many there are."""
    if not repeated:
        return rows
    several = rows.filter("n_rows > 1").dropDuplicates(["doc_id", "digest"])
    return rows.filter("n_rows = 1").unionByName(several)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS, _digest().alias("digest"))
    classes = simhash.near_duplicates(docs, carry=["digest"])
    rows = classes.groupBy("class_fp", "doc_id", "digest").agg(F.count("*").alias("n_rows"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "n_rows")).alias("first")
    kept = rows.groupBy("class_fp").agg(first).select(
        F.col("first.doc_id").alias("kept_id"), F.col("first.digest").alias("kept_digest"), "first.n_rows"
    )
    kept = saved(kept, "kept")
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest"))
    found = _once_if_repeated(docs.join(kept, same), not kept.filter("n_rows > 1").isEmpty())
    return found.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS, _digest().alias("digest"))
    mixed = mixing.mix(docs, digest=F.col("digest"))
    rows = mixed.groupBy(F.col("doc_id").alias("taken_id"), F.col("digest").alias("taken_digest")).agg(
        F.sum("copies").alias("copies"), F.count("*").alias("n_rows")
    )
    taken = saved(rows.filter("copies > 0"), "taken")
    same = F.col("doc_id").eqNullSafe(F.col("taken_id")) & (F.col("digest") == F.col("taken_digest"))
    found = _once_if_repeated(docs.join(taken, same), not taken.filter("n_rows > 1").isEmpty())
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
