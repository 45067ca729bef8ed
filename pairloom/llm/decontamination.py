"""Benchmark decontamination: a distributed positional inverted index, searched from the rarest terms.

``index`` stores the postings (document, place, term) of the training texts as a table, next to one entry
per document with its number of words. ``phrases`` cuts test items into windows of ten words and orders
the terms of each window by their number of postings. A window is then found by intersecting lists that
are adjusted by the terms' offsets: each posting of the rarest term proposes a start, those that have the
second rarest term at its place stay, and of what is left all other terms are looked up. ``exact`` gives
every place where a window occurs, ``near`` documents in which all terms of a window lie close together in
any order, ``contamination`` the words hit in each document and the items found there.

Everything is DataFrame functions; there is no Python code in the plan.

How the work is spread: texts are read once and never shuffled. Only terms of the test items are stored if
there are at most ``MAX_TERMS`` of these, all terms otherwise. Windows are searched in blocks of
``BLOCK``, which bounds what is broadcast. Lists are joined by document, place and term, so neither a hot
term nor a hot document falls to one task; the places of a document fold map-side when they are counted.
Documents with candidates are broadcast up to ``BROADCAST_ROWS`` and joined beyond.

Words are the longest runs of ASCII digits, ASCII letters in either case, and characters beyond ASCII. An
item of fewer than ten words is one window; an item without words is found nowhere. Nulls: a null text has
no words; a null document id is passed on; an item without id is searched, but not counted or listed.
Repeated documents are rows of their own. An item id that is repeated counts once. Empty tables: no rows,
or no hits. Other columns are not looked at.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.rows import once
from pairloom.llm.common import saved, text_or_empty
from pairloom.operators import joins

WINDOW = 10
# The words of the contract.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Distinct terms of test items up to which the index stores only these.
MAX_TERMS = 1_000_000
# Windows that are searched, and broadcast, together.
BLOCK = 20_000
# Row numbers that are broadcast.
BROADCAST_ROWS = 1_000_000
# The term of the entry that stands for a document itself; no word is empty.
ENTRY = ""


def words_of(text: str | Column) -> Column:
    return F.regexp_extract_all(F.translate(text_or_empty(text), UPPER, LOWER), F.lit(WORDS), F.lit(0))


def index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, pos, term, id, n_words): the postings, places from 1, and at place 0 the document itself.

    ``terms`` has the one column ``term`` and is broadcast; without it all postings are stored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = once(rows, ["row", "id"], words=words_of("text"))
    entries = rows.select("row", "id", "words", F.posexplode(F.concat(F.array(F.lit(ENTRY)), "words")).alias("pos", "term"))
    entries = entries.select(
        "row", "pos", "term",
        F.when(F.col("pos") == 0, F.col("id")).alias("id"),
        F.when(F.col("pos") == 0, F.size("words").cast("bigint")).alias("n_words"),
    )
    if terms is not None:
        own = entries.sparkSession.createDataFrame([(ENTRY,)], "term string")
        entries = entries.join(F.broadcast(terms.select("term").unionByName(own)), "term", "left_semi")
    return saved(entries.select("row", "pos", "term", "id", "n_words"), "postings")


def _documents(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("pos") == 0).select("row", "id", "n_words")


def _postings(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("pos") > 0).select("row", "pos", "term")


def windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(w, words) with each distinct window once, and (w, item) with the items that have it."""
    worded = once(items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")), ["item"], words=words_of("text"))
    length = F.least(F.lit(size), F.size("words"))
    starts = worded.filter(F.size("words") > 0).withColumn(
        "start", F.explode(F.sequence(F.lit(1), F.size("words") - length + 1))
    )
    cut = saved(starts.select("item", F.slice("words", F.col("start"), length).alias("words")).distinct(), "windows")
    distinct = saved(cut.select("words").distinct().select(F.monotonically_increasing_id().alias("w"), "words"), "windows")
    owners = saved(cut.join(distinct, "words").select("w", "item").distinct(), "window-items")
    return distinct, owners


def terms_of(found: DataFrame, most: int = MAX_TERMS) -> DataFrame | None:
    """The distinct terms of the windows, or None if there are more than ``most``."""
    terms = saved(found.select(F.explode("words").alias("term")).distinct(), "terms")
    return terms if terms.count() <= most else None


def phrases(found: DataFrame, entries: DataFrame) -> DataFrame:
    """(w, length, rank, offset, term, n): the terms of each window, the rarest first.

    Windows with a term that no document has are left out, as they occur nowhere.
    """
    counts = saved(_postings(entries).groupBy("term").agg(F.count("*").alias("n")), "term-counts")
    terms = found.select("w", F.size("words").alias("length"), F.posexplode("words").alias("offset", "term"))
    by_window = Window.partitionBy("w")
    ranked = (
        joins.lookup(terms, counts, ["term"])
        .withColumn("present", F.count("*").over(by_window))
        .withColumn("rank", F.row_number().over(by_window.orderBy("n", "term", "offset")) - 1)
        .filter(F.col("present") == F.col("length"))
    )
    return saved(ranked.select("w", "length", "rank", "offset", "term", "n"), "phrases")


def _blocks(plan: DataFrame, block: int) -> list[DataFrame]:
    n = max(1, math.ceil(plan.filter(F.col("rank") == 0).count() / block))
    return [plan.filter(F.pmod(F.xxhash64("w"), F.lit(n)) == i) for i in range(n)]


def _only_rows(postings: DataFrame, rows: DataFrame) -> DataFrame:
    """Postings of some documents. ``rows`` is a written table of distinct rows."""
    few = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return postings.join(F.broadcast(rows) if few else rows, "row", "left_semi")


def _anchored(postings: DataFrame, plan: DataFrame) -> DataFrame:
    """(row, pos, w, length, offset, term2, offset2): postings of each window's rarest term."""
    second = plan.filter(F.col("rank") == 1).select("w", F.col("term").alias("term2"), F.col("offset").alias("offset2"))
    anchors = plan.filter(F.col("rank") == 0).join(second, "w", "left").drop("rank", "n")
    return postings.join(F.broadcast(anchors), "term").drop("term")


def _of_rank(postings: DataFrame, plan: DataFrame, rank: Column) -> DataFrame:
    """Postings of the terms that some window has at a rank."""
    return postings.join(F.broadcast(plan.filter(rank).select("term").distinct()), "term", "left_semi")


def _exact_block(postings: DataFrame, plan: DataFrame) -> DataFrame:
    at = F.col("pos") - F.col("offset")
    starts = _anchored(postings, plan).withColumn("start", at).filter(F.col("start") >= 1)
    starts = starts.select("row", "start", "w", "length", (F.col("start") + F.col("offset2")).alias("pos"), F.col("term2").alias("term"))
    second = _of_rank(postings, plan, F.col("rank") == 1)
    paired = starts.filter("term IS NULL").unionByName(
        starts.filter("term IS NOT NULL").join(second, ["row", "pos", "term"], "left_semi")
    )
    paired = saved(paired.select("row", "start", "w", "length"), "starts")
    short = paired.filter(F.col("length") <= 2)
    rest = plan.filter(F.col("rank") >= 2).select("w", "offset", "term")
    wanted = paired.join(F.broadcast(rest), "w").withColumn("pos", F.col("start") + F.col("offset"))
    own = _only_rows(postings, saved(paired.select("row").distinct(), "rows"))
    full = (
        wanted.join(own, ["row", "pos", "term"])
        .groupBy("row", "start", "w", "length")
        .agg(F.count("*").alias("found"))
        .filter(F.col("found") == F.col("length") - 2)
    )
    return short.unionByName(full.drop("found"))


def exact(entries: DataFrame, plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, start, w, length): each place where a window occurs, written to the shared folder."""
    postings = _postings(entries)
    found = [saved(_exact_block(postings, part), "matches") for part in _blocks(plan, block)]
    return reduce(DataFrame.unionByName, found)


def _near_block(postings: DataFrame, plan: DataFrame, spread: int) -> DataFrame:
    # Terms that a window repeats are needed once.
    by_term = Window.partitionBy("w", "term").orderBy("offset")
    plan = plan.withColumn("__copy", F.row_number().over(by_term)).filter(F.col("__copy") == 1)
    plan = plan.withColumn("rank", F.row_number().over(Window.partitionBy("w").orderBy("n", "term")) - 1)
    plan = saved(plan.select("w", "length", "rank", "offset", "term", "n"), "phrases")
    reach = F.col("length") + spread
    anchors = _anchored(postings, plan).select("row", F.col("pos").alias("p"), "w", (reach - 1).alias("reach"), "term2")
    cell = plan.agg(F.max("length")).first()[0]
    cell = (cell or 1) + spread

    def close(left: DataFrame, right: DataFrame) -> DataFrame:
        """Rows of ``left`` with each posting of their term at most ``reach`` places away."""
        cells = left.withColumn(
            "cell", F.explode(F.sequence(F.expr(f"(p - reach) div {cell}"), F.expr(f"(p + reach) div {cell}")))
        )
        dealt = right.withColumn("cell", F.expr(f"pos div {cell}"))
        return cells.join(dealt, ["row", "cell", "term"]).filter(F.abs(F.col("pos") - F.col("p")) <= F.col("reach"))

    keys = ["row", "p", "w", "reach"]
    second = _of_rank(postings, plan, F.col("rank") == 1)
    paired = anchors.filter("term2 IS NULL").select(keys).unionByName(
        close(anchors.withColumnRenamed("term2", "term"), second).select(keys).distinct()
    )
    paired = saved(paired, "starts")
    wanted = paired.join(F.broadcast(plan.select("w", "rank", "term")), "w")
    own = _only_rows(postings, saved(paired.select("row").distinct(), "rows"))
    # At most twice the reach places each, as a place holds one term.
    around = close(wanted, own).groupBy(keys).agg(F.collect_set(F.struct("pos", "rank")).alias("around"))
    sizes = plan.groupBy("w").agg(F.count("*").alias("terms"))

    def complete(first: Column) -> Column:
        inside = F.filter("around", lambda x: (x["pos"] >= first["pos"]) & (x["pos"] <= first["pos"] + F.col("reach")))
        return F.size(F.array_distinct(F.transform(inside, lambda x: x["rank"]))) == F.col("terms")

    return around.join(F.broadcast(sizes), "w").filter(F.exists("around", complete)).select("row", "w").distinct()


def near(entries: DataFrame, plan: DataFrame, spread: int = 5, block: int = BLOCK) -> DataFrame:
    """(row, w): documents with all distinct terms of a window, in any order, within as many places as the
    window has words and ``spread`` more."""
    postings = _postings(entries)
    return reduce(DataFrame.unionByName, [saved(_near_block(postings, part, spread), "near") for part in _blocks(plan, block)])


def contamination(entries: DataFrame, matches: DataFrame, owners: DataFrame) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated) of each document."""
    places = matches.select("row", "start", "length").distinct()
    places = places.select("row", F.explode(F.expr("sequence(start, start + length - 1)")).alias("pos")).distinct()
    hits = places.groupBy("row").agg(F.count("*").alias("n_hit"))
    listed = matches.select("row", "w").distinct().join(owners.filter("item IS NOT NULL"), "w").select("row", F.col("item").cast("string").alias("item"))
    # A document's list has each item of the benchmark once at most.
    items = listed.distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = hits.join(items, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return _documents(entries).join(found, "row", "left").select(
        "id", "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """``contamination`` of all documents by the items, with the document's id under its own name."""
    found, owners = windows(items, WINDOW, item_col, text_col)
    entries = index(docs, terms_of(found), id_col, text_col)
    matches = exact(entries, phrases(found, entries))
    return contamination(entries, matches, owners).withColumnRenamed("id", id_col)
