"""Line dedup: drop lines that too large a share of a site's pages have.

Pages are grouped by host. For each line of a host, the pages that contain it are divided by the pages
of the host; a line above ``max_ratio`` that at least ``min_pages`` pages contain is boilerplate, and goes
from every page of that host. Lines are compared without white space around them and counted once per
page; blank lines are left where they are.

The count folds map-side, so a host or line that holds a third of all rows arrives as one row per task.
A host has at most (lines per page / max_ratio) boilerplate lines. The list of all hosts is broadcast up
to ``BROADCAST_LINES`` lines, checked by a count; beyond, it is joined by host and a salt, which deals a
host with many pages over several tasks. Both ways give the same rows. A page looks up its lines among its
own boilerplate only, in buckets, so a page of many lines takes little more than linear time.

Nulls: a null host is a host of its own; a null text has no lines, counts as a page, and stays null. An
empty text stays empty. Empty table: no rows. Repeated rows count as pages of their own, unless a
``page`` column says which rows are one page: then copies of a page, or near copies that have been put in
one class, are no sign that its lines are boilerplate. The result has the named columns only, so others
may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.rows import once
from pairloom.llm.common import saved

MAX_RATIO = 0.05
MIN_PAGES = 3
BROADCAST_LINES = 200_000
# Beyond the broadcast: pages of a host that one task should hold, and hosts that may be larger.
PAGES_PER_SALT = 100_000
MOST_SALTS = 256


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\f\v"))


def _digest(line: Column) -> Column:
    return F.xxhash64(_stripped(line))


def _wide_digest(stripped: Column) -> Column:
    # 96 bits: two lines of one host do not meet by accident.
    return F.struct(F.xxhash64(stripped).alias("a"), F.hash(stripped).alias("b"))


def line_digests(text: str) -> Column:
    """Digests of a text's different lines that are not blank."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n", -1), _stripped), lambda line: line != "")
    # Texts are told apart by hashing; structs would be compared in pairs.
    return F.transform(F.array_distinct(lines), _wide_digest)


def boilerplate(
    pages: DataFrame,
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    classes: DataFrame | None = None,
) -> DataFrame:
    """(host, host_pages, line, line_pages) of each boilerplate line; ``pages`` has host and text.

    Where ``pages`` has a column ``page``, rows of one value are one page, and ``classes`` (page, class)
    may put several pages together as one. Copies fold map-side before they are looked up there.
    """
    lines = F.explode(line_digests("text")).alias("line")
    if "page" in pages.columns:
        host_pages = pages.select("host", "page").distinct()
        line_pages = pages.select("host", "page", lines).distinct()
        if classes is not None:
            host_pages, line_pages = (
                df.join(classes, "page", "left").withColumn("page", F.coalesce("class", "page"))
                for df in (host_pages, line_pages)
            )
        n_pages = F.count_distinct("page")
    else:
        host_pages, line_pages, n_pages = pages, pages.select("host", lines), F.count("*")
    hosts = host_pages.groupBy("host").agg(n_pages.alias("host_pages"))
    found = (
        line_pages.groupBy("host", "line")
        .agg(n_pages.alias("line_pages"))
        .filter(F.col("line_pages") >= min_pages)
        .select(F.col("host").alias("line_host"), "line", "line_pages")
    )
    return (
        found.join(hosts, F.col("line_host").eqNullSafe(F.col("host")))
        .filter(F.col("line_pages") > max_ratio * F.col("host_pages"))
        .select("host", "host_pages", "line", "line_pages")
    )


def _with_lists(pages: DataFrame, found: DataFrame, broadcast_lines: int) -> DataFrame:
    """Pages with the boilerplate of their host in ``listed``."""
    lists = found.groupBy(F.col("host").alias("list_host")).agg(
        F.collect_list("line.a").alias("listed"), F.max("host_pages").alias("host_pages")
    )
    same_host = F.col("host").eqNullSafe(F.col("list_host"))
    if found.count() <= broadcast_lines:
        return pages.join(F.broadcast(lists), same_host, "left").drop("list_host", "host_pages")
    salts = F.least(F.lit(MOST_SALTS), 1 + F.floor(F.col("host_pages") / PAGES_PER_SALT)).cast("int")
    salted = lists.withColumn("list_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    # Hosts of several salts; each has PAGES_PER_SALT pages, so there are few, and all others have salt 0.
    large = lists.filter(salts > 1).select(F.col("list_host").alias("large_host"), salts.alias("salts"))
    dealt = pages.join(F.broadcast(large), F.col("host").eqNullSafe(F.col("large_host")), "left").withColumn(
        "salt", F.pmod(F.xxhash64("text", "_k0"), F.coalesce("salts", F.lit(1))).cast("int")
    )
    return dealt.join(salted, same_host & (F.col("salt") == F.col("list_salt")), "left").drop(
        "list_host", "host_pages", "large_host", "salts", "salt", "list_salt"
    )


def drop_site_lines(
    df: DataFrame,
    host: Column,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
    page: Column | None = None,
    classes: DataFrame | None = None,
) -> DataFrame:
    """The ``keep`` columns, ``host``, ``text`` without boilerplate, ``n_lines`` and ``n_dropped``.

    ``n_lines`` counts the lines of the text before, blank ones too. ``page`` and ``classes`` are those
    of ``boilerplate``.
    """
    kept = [F.col(f"`{name}`").alias(f"_k{i}") for i, name in enumerate(keep)]
    names = [f"_k{i}" for i in range(len(kept))]
    pages = df.select(*kept, host.alias("host"), F.col(f"`{text_col}`").alias("text"))
    counted = df.select(host.alias("host"), F.col(f"`{text_col}`").alias("text"), *([page.alias("page")] if page is not None else []))
    found = saved(boilerplate(counted, max_ratio, min_pages, classes), "boilerplate")
    matched = _with_lists(pages, found, broadcast_lines)
    # The page's own boilerplate, by hashing, and then in as many buckets as make both steps short.
    lines = F.split("text", "\n", -1)
    looked = once(
        matched, [*names, "host", "text"], own=F.array_intersect(F.transform(lines, _digest), F.col("listed"))
    )
    n_buckets = F.ceil(F.sqrt(F.size("own"))).cast("int")
    numbers = F.when(F.size("own") > 0, F.sequence(F.lit(0), n_buckets - 1))
    cut = once(
        looked,
        [*names, "host", "text"],
        buckets=F.transform(numbers, lambda i: F.filter("own", lambda line: F.pmod(line, n_buckets) == i)),
    )
    in_bucket = lambda line: F.get("buckets", F.pmod(_digest(line), F.size("buckets")).cast("int"))
    left = F.filter(lines, lambda line: ~F.array_contains(in_bucket(line), _digest(line)) | (_stripped(line) == ""))
    cleaned = cut.select(
        *names,
        "host",
        "text",
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.when(F.col("buckets").isNotNull(), left).alias("left"),
    )
    return cleaned.select(
        *[F.col(f"_k{i}").alias(name) for i, name in enumerate(keep)],
        "host",
        F.coalesce(F.array_join("left", "\n"), F.col("text")).alias("text"),
        F.greatest(F.lit(0).cast("bigint"), F.col("n_lines")).alias("n_lines"),
        F.when(F.col("left").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("left")).cast("bigint").alias("n_dropped"),
    )


# Patterns that never read a stretch of text twice: what is not closed goes on to the end of the page, as
# in browsers, and a match that has begun cannot fail.
_HIDDEN = r"(?is)<script.*?(?:</script>|\z)|<style.*?(?:</style>|\z)|<!--.*?(?:-->|\z)"
# What begins a new line of text in a page.
_BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|nav|h[1-6]|tr|td|th|table|article|section|header|footer|main|aside|title|body|head|html|form|blockquote|pre)(?:[\s/][^>]*+)?(?:>|\z)"
_TAG = r"<[A-Za-z/!?][^>]*+(?:>|\z)"


def visible_lines(html: str) -> Column:
    """A page's text: scripts, styles and comments out, block tags as line ends, other tags out.

    A tag begins with a letter, slash, exclamation or question mark after the bracket; another bracket is
    text. Null stays null, an empty page has an empty text.
    """
    text = F.regexp_replace(F.col(html), _HIDDEN, "")
    text = F.regexp_replace(text, _BREAKS, "\n")
    text = F.regexp_replace(text, _TAG, "")
    text = F.regexp_replace(text, r"(?<![ \t])[ \t]*+\n[ \t\n]*+", "\n")
    return F.btrim(text, F.lit("\n"))
