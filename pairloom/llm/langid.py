"""Language identification: n-gram filters whose slots hold one bit per language.

Learning takes a bounded sample of labelled texts per language, counts in how many of a language's texts
each character n-gram occurs, and puts the n-grams that a fair share of them have into a Bloom filter.
The filter is bit-sliced: each slot is a mask with one bit per language, so one probe of k slots and an
AND give the languages that have an n-gram, all at once.

Prediction counts, per language, a text's n-grams whose mask has the language's bit. A share f of set
bits lets f**k of foreign n-grams through by accident; counts are corrected for it. The language with the
highest corrected count is predicted. ``score`` is its count over the sum of its and the runner-up's,
``coverage`` its count over the text's n-grams, corrected and within 0 to 1.

N-grams are of letters in lower case and single spaces between words, over the whole text; a text of
more than ``CHUNK`` characters is looked at in parts cut at white space, which learning takes as texts. Nulls: a
null text, and one without a letter, is ``und`` with score 0; rows without text or label, or with a null
id, are not learned from. With nothing learned every text is ``und``. Of equal counts the language first
by code point wins. Repeated rows are predicted each, and learned from once. Empty table: no rows. Other
columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import map_rows, parts_of, saved

SIZES = (2, 3, 4)
# Labelled texts that are learned from, per language.
SAMPLE = 3000
# Share of a language's texts that must have an n-gram for it to count as one of the language.
MIN_SHARE = 0.02
PROBES = 4
SLOTS_PER_GRAM = 16
MAX_SLOTS = 1 << 20
MAX_LANGUAGES = 4096
UNDECIDED = "und"
# Characters that are looked at together; bounds the memory of a task beside its batch of texts.
CHUNK = 1 << 16

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Filters:
    """languages; slots x words table of masks; per language the share of n-grams let through by accident."""

    languages: list[str]
    table: np.ndarray
    accident: np.ndarray


def held_out(id_col: str) -> Column:
    """Whether a row is never learned from: every fifth, by the checksum of its id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Grams:
    """Hashes of the n-grams of many texts."""

    def __init__(self):
        self.letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, number of the text) of each n-gram."""
        joined = "\0".join(["", *[f" {text.lower()} " for text in texts], ""])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        border = codes == 0
        if border.sum() != len(texts) + 1:  # a text with a null character of its own
            cleaned = [text.replace("\0", " ") for text in texts]
            return self.of(cleaned)
        letter = self.letters[codes]
        keep = letter | border
        keep[1:] |= letter[:-1] | border[:-1]  # the first of other characters in a row becomes a space
        codes = np.where(letter, codes, np.where(border, 0, 32))[keep].astype(np.uint64)
        text_of = np.cumsum(codes == 0) - 1
        mixed = (codes + np.uint64(1)) * _GOLDEN
        mixed ^= mixed >> np.uint64(29)
        inside = codes != 0
        hashes, owners = [], []
        rolled, whole = mixed, inside
        for size in range(2, max(SIZES) + 1):
            rolled = rolled[:-1] * _MIX + mixed[size - 1 :]
            whole = whole[:-1] & inside[size - 1 :]
            if size in SIZES:
                some = rolled[whole]
                hashes.append(some ^ (some >> np.uint64(31)) ^ np.uint64(size))
                owners.append(text_of[: len(rolled)][whole])
        return np.concatenate(hashes), np.concatenate(owners)


def slots_of(hashes: np.ndarray, n_slots: int) -> Iterator[np.ndarray]:
    """The slots of each hash, one array per probe. ``n_slots`` is a power of two."""
    first = hashes * _MIX
    first ^= first >> np.uint64(32)
    step = (hashes * _GOLDEN) >> np.uint64(32) | np.uint64(1)
    for _ in range(PROBES):
        yield (first & np.uint64(n_slots - 1)).astype(np.int64)
        first = first + step


def _gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, texts) counted within batches; still to be summed up."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for group in _groups((part,) for text in texts for part in parts_of(text, CHUNK)):
                    hashes, owners = grams.of([part for (part,) in group])
                    # Once per text, and then once per group.
                    own = np.unique(hashes * _GOLDEN ^ owners.astype(np.uint64) * _MIX, return_index=True)[1]
                    unique, counts = np.unique(hashes[own].view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_pydict(
                        {"lang": pa.array([lang] * len(unique), pa.string()), "gram": unique, "texts": counts}
                    )

    return sample.select("lang", "text").mapInArrow(run, "lang string, gram long, texts long")


def _groups(parts: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Tuples that end with a text, in lists of about CHUNK characters."""
    group, chars = [], 0
    for part in parts:
        group.append(part)
        chars += len(part[-1]) + 3
        if chars >= CHUNK:
            yield group
            group, chars = [], 0
    if group:
        yield group


def learn(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = SAMPLE,
    min_share: float = MIN_SHARE,
) -> Filters:
    """Filters from about ``sample`` labelled texts of each language, all outside the held-out fold."""
    rows = df.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")
    ).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id")
    )
    totals = rows.groupBy("lang").agg(F.count("*").alias("n"))
    totals = saved(totals, "langid-totals")
    if totals.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; is {lang_col} the column of labels?")
    chance = F.pmod(F.xxhash64("id", "text"), F.col("n")) < sample
    chosen = rows.join(F.broadcast(totals), "lang").filter(chance).dropDuplicates(["lang", "text"])
    chosen = saved(chosen.select("lang", "text"), "langid-sample")
    n_texts = {r.lang: r.n for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(n_texts, key=lambda lang: lang.encode())
    if not languages:
        return Filters([], np.zeros((1, 1), np.uint64), np.zeros(0))
    least = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min_share * n_texts[lang])])
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    enough = F.col("texts") >= F.element_at(least, F.col("lang"))
    kept = (
        _gram_counts(chosen)
        .groupBy("lang", "gram")
        .agg(F.sum("texts").alias("texts"))
        .filter(enough)
        .select(F.element_at(number, F.col("lang")).alias("number"), "gram")
    )
    # One row per language and n-gram of a bounded sample.
    kept = saved(kept, "langid-grams")
    most = kept.groupBy("number").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    n_slots = min(MAX_SLOTS, 1 << (SLOTS_PER_GRAM * most - 1).bit_length())

    words = -(-len(languages) // 64)

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column(0).to_numpy()
            hashes = batch.column(1).to_numpy().view(np.uint64)
            slots = np.concatenate(list(slots_of(hashes, n_slots)))
            yield pa.RecordBatch.from_pydict(
                {
                    "place": slots * words + np.tile(which // 64, PROBES),
                    "mask": np.tile(np.uint64(1) << (which % 64).astype(np.uint64), PROBES).view(np.int64),
                }
            )

    masks = kept.mapInArrow(bits, "place long, mask long").groupBy("place").agg(F.bit_or("mask").alias("mask"))
    got = masks.toArrow()  # at most one row per slot and word, and so at most MAX_SLOTS x words
    table = np.zeros(n_slots * words, np.uint64)
    table[got["place"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    table = table.reshape(n_slots, words)
    filled = np.array([_bit(table, i).mean() for i in range(len(languages))])
    return Filters(languages, table, filled**PROBES)


def _bit(masks: np.ndarray, number: int) -> np.ndarray:
    return (masks[:, number // 64] >> np.uint64(number % 64)) & np.uint64(1)


def hits_of(filters: Filters, grams: Grams, parts: list[str]) -> np.ndarray:
    """Of each part, how many n-grams each language has, and in the last column how many there are."""
    n = len(parts)
    hashes, owners = grams.of(parts)
    masks = None
    for slots in slots_of(hashes, len(filters.table)):
        masks = filters.table[slots] if masks is None else masks & filters.table[slots]
    found = [np.bincount(owners, weights=_bit(masks, i), minlength=n) for i in range(len(filters.languages))]
    return np.stack([*found, np.bincount(owners, minlength=n)], axis=1)


def decide(filters: Filters, hits: np.ndarray) -> tuple[list[str], list[float], list[float]]:
    """(language, score, coverage) from the counts of texts that have a letter."""
    shares = hits[:, :-1] / np.maximum(hits[:, -1:], 1)
    shares = np.clip((shares - filters.accident) / np.maximum(1e-9, 1.0 - filters.accident), 0.0, 1.0)
    rows = np.arange(len(hits))
    best = shares.argmax(axis=1)
    top = shares[rows, best]
    shares[rows, best] = 0.0
    second = shares.max(axis=1)
    score = np.divide(top, top + second, out=np.zeros(len(hits)), where=top > 0)
    return [filters.languages[i] for i in best], score.tolist(), top.tolist()


def predict(df: DataFrame, filters: Filters, carry: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The carried columns, lang_pred, score and coverage of each row."""
    schema = T.StructType(
        [
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("coverage", T.DoubleType()),
        ]
    )
    # At most MAX_SLOTS masks. Plain values, as workers may lack this package's classes.
    values = (filters.languages, filters.table, filters.accident)
    shared = df.sparkSession.sparkContext.broadcast(values)

    def make():
        filters, grams = Filters(*shared.value), Grams()

        def run(columns: dict[str, list]) -> dict[str, list]:
            texts = columns["_text"]
            langs, scores, coverage = [UNDECIDED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            lettered = [
                i for i, text in enumerate(texts) if filters.languages and text and any(map(str.isalpha, text))
            ]
            hits = np.zeros((len(texts), len(filters.languages) + 1))
            for group in _groups((i, part) for i in lettered for part in parts_of(texts[i], CHUNK)):
                owners, parts = zip(*group)
                np.add.at(hits, list(owners), hits_of(filters, grams, list(parts)))
            if lettered:
                for i, *found in zip(lettered, *decide(filters, hits[lettered])):
                    langs[i], scores[i], coverage[i] = found
            return {"lang_pred": langs, "score": scores, "coverage": coverage}

        return run

    return map_rows(df.select(*carry, F.col(text_col).alias("_text")), make, schema, carry)


def identify(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold, and predict all rows."""
    return predict(df, learn(df, id_col, text_col, lang_col), [id_col], text_col)
