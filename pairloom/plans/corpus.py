"""From raw corpora to translation requests, and from responses to a published dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from pairloom import constants
from pairloom.operators import combine, requests, responses, sample, select
from pairloom.operators.combine import Source
from pairloom.sources import readers, writers


def aligned_pairs(spark: SparkSession, left_path: str, right_path: str) -> DataFrame:
    """Two line files to distinct (line_no, en, ko), each pair at its first line."""
    pairs = combine.align_lines(
        readers.read_lines(spark, left_path), readers.read_lines(spark, right_path)
    )
    return combine.dedup_pairs(pairs, ["en", "ko"], "line_no")


def combined_english(
    subtitles: DataFrame,
    talks: DataFrame,
    n: int = 150_000,
    seed: int = 42,
    subtitle_length: int = 100,
    talk_length: int = 30,
) -> DataFrame:
    """Seeded samples of long subtitle lines and of long talk lines, one after the other.

    ``subtitles`` is (line_no, line); ``talks`` is (line_no, en, ...). Gives rn, source_ord, pos,
    english.
    """
    first = select.min_length(subtitles.select("line_no", "line"), "line", subtitle_length)
    second = select.min_length(talks.select("line_no", "en"), "en", talk_length)
    return combine.concat_corpora(
        [
            (sample.sample_n(first, n, seed, "line_no"), "line", "line_no"),
            (sample.sample_n(second, n, seed, "line_no"), "en", "line_no"),
        ]
    )


def mixed_english(
    news: Source, questions: Source, reviews: Source, maths: Source, combined: Source, seed: int
) -> DataFrame:
    """The five-part mix: rn, source_ord, pos, text. Caps and modes come with the sources."""
    return combine.mix_corpora([news, questions, reviews, maths, combined], seed)


def translation_requests(
    corpus: DataFrame,
    col: str,
    index: str = "rn",
    system_prompt: str = constants.TRANSLATION_SYSTEM_PROMPT_KO,
    size: int = constants.BATCH_SIZE,
    limit: int | None = None,
) -> DataFrame:
    """Requests for a numbered corpus; ``limit`` sends its first rows only."""
    if limit is not None:
        corpus = corpus.filter(corpus[index] < limit)
    return requests.build_requests(
        requests.batch_rows(corpus, col, size=size, index=index), system_prompt
    )


def publish_pairs(
    spark: SparkSession, response_path: str, base: str, name: str
) -> tuple[DataFrame, DataFrame]:
    """Response files to a saved train split of distinct pairs; gives it back with the bad lines."""
    lines = spark.read.text(response_path)
    writers.save_split(responses.build_pairs(lines, keep_order=True), base, name, "train")
    bad = responses.quarantine(responses.parse_responses(lines))
    return readers.load_split(spark, base, name, "train"), bad


def split_published(
    pairs: DataFrame, seed: int, fraction: float = 0.1, key: Sequence[str] = ("en", "ko")
) -> tuple[DataFrame, DataFrame]:
    """Train and test set; a pair is its own key, as pairs are distinct."""
    return sample.split_fraction(pairs, fraction, seed, list(key))
