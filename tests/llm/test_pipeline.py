"""The corpus pipeline on a small table, against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from pairloom.llm import common
from tests.llm.test_search import naive_classes, naive_print

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and to in that was with for his this which", "fr": "les des une que dans pour qui avec sur est pas nous"}


def texts(seed: int, n: int):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        yield i, " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "s", "x"]) for _ in range(rng.randint(20, 60))), lang


def table(rows):
    return [(i, t, lang, f"src{i % 4}", len(t) if t is not None else None) for i, t, lang in rows]


@pytest.fixture(scope="module")
def docs():
    rows = table(texts(1, 150))
    rows = [(i, t + ("\nFooter of the site" if i % 4 == 1 else ""), *rest) for i, t, *rest in rows]
    rows += [(500 + i, rows[i][1], "en", "src9", 1) for i in range(5)]  # copies
    rows += [(600, None, None, None, None), (601, "", "en", "src1", 0), (602, "12 34", None, "src2", 5)]
    rows += [(603, "Footer of the site", "en", "src1", 18), rows[3], rows[3], (None, rows[8][1] + " tail", "en", None, 3)]
    return rows


def stage(spark, name, rows):
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], SCHEMA + ", digest long, copies long").repartition(3)
    found = dict(corpus_pipeline.STAGES)[name](spark, df, "")
    return found.columns, Counter(map(tuple, found.collect()))


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mix_sources", "pack"]


def test_language_stage_keeps_clean_documents(spark, docs):
    columns, got = stage(spark, "language_id", docs)
    assert columns == COLUMNS and got == Counter(r for r in docs if r[0] not in (600, 601, 602))


def naive_pages(rows):
    """Rows after the line stage: near copies of a text, in one SimHash class, are one page of a source."""
    prints = {r[1]: naive_print(r[1]) for r in rows}
    classes = naive_classes(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    strip = lambda line: line.strip(" \t\r\f\v")
    pages, lines = defaultdict(set), defaultdict(set)
    for r in rows:
        page = classes[prints[r[1]]]
        pages[r[3]].add(page)
        for line in {strip(x) for x in (r[1] or "").split("\n")} - {""}:
            lines[r[3], line].add(page)
    want = Counter()
    for key, text, lang, source, n_chars in rows:
        if text is None:
            want[(key, text, lang, source, n_chars)] += 1
            continue
        counts = {x: len(lines[source, strip(x)]) for x in text.split("\n")}
        left = [x for x in text.split("\n") if not (counts[x] >= 3 and counts[x] > 0.05 * len(pages[source]))]
        cut = "\n".join(left)
        if cut == text or len(left) == len(counts) == len(text.split("\n")):
            want[(key, text, lang, source, n_chars)] += 1
        elif cut.strip():
            want[(key, cut, lang, source, len(cut))] += 1
    return want


def test_line_stage(spark, docs):
    columns, got = stage(spark, "line_dedup", docs)
    assert columns == COLUMNS and got == naive_pages(docs)
    assert not any("Footer" in (r[1] or "") for r in got if r[3] == "src1")
    # A document that is there three times stays, and its lines too.
    assert got[docs[3]] == 3


def test_pages_that_are_mostly_boilerplate_lose_it(spark):
    """One long line on all pages of a source goes, however little else a page has."""
    cookie = "This site uses cookies to give you the best of experiences here."
    for words in (4, 80):
        rng = random.Random(words)
        bodies = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(words)) for _ in range(100)]
        rows = [(i, f"{cookie}\n{body}", "en", "src", 1) for i, body in enumerate(bodies)]
        columns, got = stage(spark, "line_dedup", rows)
        assert got == naive_pages(rows)
        assert sorted(r[1] for r in got.elements()) == sorted(bodies)


def test_copies_and_near_copies_leave_one(spark):
    """Copies above 5% of a source are no boilerplate: their text reaches the stage that keeps one."""
    rows = table((i, t, lang) for i, t, lang in texts(5, 95))
    rows = [(i, t + "\nFooter of the site", lang, "src", n) for i, t, lang, _, n in rows]
    lines = [t for _, t, _ in texts(6, 30)]
    copy, near = "\n".join(lines[:10]), "\n".join(lines[10:])
    rows += [(200 + i, copy, "en", "src", len(copy)) for i in range(7)]
    rows += [(300 + i, near + " \n" * i, "en", "src", len(near) + 2 * i) for i in range(8)]
    rows += [(400 + i, "\n".join([*lines, f"the end {i}"]), "en", "src", 1) for i in range(9)]
    rows += [(500 + i, "Footer of the site\n" + " " * i, "en", "src", 1) for i in range(4)]
    _, got = stage(spark, "line_dedup", rows)
    assert got == naive_pages(rows)
    ids = Counter(r[0] for r in got.elements())
    assert set(ids) == {r[0] for r in rows if r[0] < 500} and set(ids.values()) == {1}
    want = {r[0]: r[1] for r in rows}
    assert all(r[1] == want[r[0]].replace("\nFooter of the site", "") for r in got)
    _, kept = stage(spark, "simhash_dedup", list(got.elements()))
    assert {r[0] for r in kept if 200 <= r[0] < 500} == {200, 300, 400}


def test_simhash_stage_keeps_one_of_each_class(spark, docs):
    columns, got = stage(spark, "simhash_dedup", docs)
    prints = {r[1]: naive_print(r[1]) for r in docs}
    classes = naive_classes(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    groups: dict = {}
    for r in docs:
        groups.setdefault(classes[prints[r[1]]], []).append(r)
    assert columns == COLUMNS and sum(got.values()) == len(groups)
    kept = {classes[prints[r[1]]]: r for r in got}
    for name, rows in groups.items():
        ids = [r[0] for r in rows if r[0] is not None]
        assert kept[name] in rows and kept[name][0] == min(ids, default=None)


def test_mix_stage_repeats_documents(spark, docs):
    columns, got = stage(spark, "mix_sources", docs)
    have = Counter(docs)
    assert columns == COLUMNS and set(got) <= set(have)
    assert all(n <= 3 * have[r] for r, n in got.items())
    words = lambda rows: Counter({s: sum(n * len((r[1] or "").split()) for r, n in rows.items() if r[3] == s) for s in {r[3] for r in rows}})
    taken, given = words(got), words(have)
    assert abs(sum(taken.values()) - sum(given.values())) < 0.05 * sum(given.values())
    assert taken["src0"] > taken["src1"] > taken["src2"]


def test_empty_tables(spark):
    for name, _ in corpus_pipeline.STAGES:
        assert not stage(spark, name, [])[1]


def test_run(spark, docs, tmp_path):
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} <= {r[0] for r in docs}
    assert all(np.frombuffer(r.ids, "<u4").size == r.length for r in pieces)
    assert sum(np.frombuffer(r.ids, "<u4")[-1] == 2 for r in pieces) >= 100


def test_python_gets_small_batches_of_texts_for_classes(spark, docs, monkeypatch):
    sizes, keep = [], corpus_pipeline.simhash.fingerprints
    size = lambda: spark.conf.get(common.ARROW_BYTES)
    monkeypatch.setattr(corpus_pipeline.simhash, "fingerprints", lambda *args: (sizes.append(size()), keep(*args))[1])
    before = size()
    assert corpus_pipeline._text_classes(spark.createDataFrame(docs, SCHEMA)).count() >= 2
    assert sizes == ["4m"] and size() == before
