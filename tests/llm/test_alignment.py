"""Cross-tokenizer alignment against a plain version that encodes whole texts and walks both token lists."""

from __future__ import annotations

import hashlib
import itertools
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairloom.llm import alignment, queries
from tests.conftest import DATA

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    return a, b, alignment.byte_vocabulary(BYTES), alignment.piece_vocabulary(b)


def naive_tokens(tools, text):
    a, b, a_bytes, b_bytes = tools
    if not text:
        return [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    want = (" " + text).encode()
    if b"".join(a_bytes[i] for i in ids_a) != want or b"".join(b_bytes[i] for i in ids_b) != want:
        return [], []
    return ids_a, ids_b


def spans(ids, sizes):
    ends = np.cumsum([len(sizes[i]) for i in ids]).tolist()
    return [(i, start, end) for i, start, end in zip(ids, [0, *ends], ends)]


def naive(tools, rows):
    """Rows of the query, by merging both token lists place by place."""
    counts, kept = Counter(), []
    for key, text in rows:
        a, b = naive_tokens(tools, text)
        a, b = spans(a, tools[2]), spans(b, tools[3])
        groups, links, at, to = [], [], 0, 0
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        for end in cuts:
            own_a = list(itertools.takewhile(lambda t: t[2] <= end, itertools.islice(a, at, None)))
            own_b = list(itertools.takewhile(lambda t: t[2] <= end, itertools.islice(b, to, None)))
            at, to = at + len(own_a), to + len(own_b)
            groups.append(",".join(str(t[0]) for t in own_a) + "|" + ",".join(str(t[0]) for t in own_b))
            links += [(x[0], y[0]) for x in own_a for y in own_b if x[1] < y[2] and y[1] < x[2]]
        counts.update(links)
        kept.append((key, len(a), len(b), groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (
            key, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links),
            sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for key, n_a, n_b, groups, links in kept
    ]


TEXTS = [
    "plain words in a row", "a  b   c    d", " starts and ends ", "", None, " ", "   ", "x\n\n  y \n z\t w \t\n v",
    "<|endoftext|> is plain text <s> </s> <unk> <0x0A>", "mark ▁ inside", "▁", "漢字 かな 🙂🙂 𝒳 é é",
    "don't 's ' re it'll", "a b 　 c  d", "\x00\x1f \x1c x", "tabs\t\tand\r\nbreaks \r\n\r\n x",
    "plain words in a row", "1234567890 3.14 -- == ///", "supercalifragilistic" * 8, "﻿bom ​zero",
]


@pytest.fixture(scope="module")
def encoders():
    return alignment.Encoders(BYTES, PIECES)


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_tokens_of_whole_texts(tools, encoders, text):
    found = encoders.encode([text])[0]
    want = naive_tokens(tools, text)
    got = ([], []) if found is None else tuple(x.tolist() for x in found)
    assert got == want


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet="ab '\n\t s　\u0085é,.0漢", min_size=1, max_size=40))
def test_tokens_of_anything(tools, encoders, text):
    test_tokens_of_whole_texts(tools, encoders, text)


def assert_words_give_whole_texts(encoders, words, texts):
    for want, got in zip(encoders.encode(texts), words.encode(texts)):
        assert (want is None) == (got is None)
        if got is not None:
            assert [x.tolist() for x in want] == [x.tolist() for x in got[:2]] and got[2][-1] == len(got[0])


def test_words_give_the_tokens_of_whole_texts(encoders, monkeypatch):
    words, texts = alignment._Words(encoders), ["", *filter(None, TEXTS)]
    for size in (1, 3, len(texts)):
        for at in range(0, len(texts), size):
            assert_words_give_whole_texts(encoders, words, texts[at : at + size])
    monkeypatch.setattr(alignment, "WORD_CHARS", 10)
    monkeypatch.setattr(alignment, "WORDS_TOGETHER", 2)
    for at in range(len(texts)):
        assert_words_give_whole_texts(encoders, words, texts[at:])


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab '\n\t s　\u0085é,.0漢▁\u0301\x1c", max_size=40), min_size=1, max_size=5))
def test_words_give_the_tokens_of_anything(encoders, texts):
    words = alignment._Words(encoders)
    assert_words_give_whole_texts(encoders, words, texts)
    assert_words_give_whole_texts(encoders, words, texts[::-1])


def test_repeated_words_are_encoded_once(monkeypatch):
    encoded, encode = [], alignment.Encoders.encode
    monkeypatch.setattr(alignment.Encoders, "encode", lambda self, texts: encoded.extend(texts) or encode(self, texts))
    run = alignment._aligner(BYTES, PIECES)
    texts = [" ".join(f"word{i * j % 97}" for i in range(200)) for j in range(1, 50)]
    first = run(texts)
    assert sum(map(len, encoded)) < 1000
    assert [[x.tolist() for x in row] for row in run(texts)] == [[x.tolist() for x in row] for row in first]
    assert sum(map(len, encoded)) < 1000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=60), st.lists(st.integers(1, 6), min_size=1, max_size=60))
def test_halving_finds_every_shared_cut(a, b):
    b = b[:-1] + [max(1, b[-1] + sum(a) - sum(b))]
    a = a[:-1] + [a[-1] + sum(b) - sum(a)]
    if a[-1] < 1:
        return
    a_ends, b_ends = np.cumsum(a), np.cumsum(b)
    sizes = alignment.group_sizes(a_ends, b_ends, np.array([len(a) - 1]))
    cuts = sorted(set(a_ends.tolist()) & set(b_ends.tolist()))
    assert a_ends[np.cumsum(sizes[0]) - 1].tolist() == cuts
    assert b_ends[np.cumsum(sizes[1]) - 1].tolist() == cuts


def test_halving_without_cuts_ends_soon():
    a_ends, b_ends = np.arange(2, 2_000_002, 2), np.append(np.arange(1, 1_999_999, 2), 2_000_000)
    start = time.time()
    assert [len(x) for x in alignment.group_sizes(a_ends, b_ends, np.array([999_999]))] == [1, 1]
    assert time.time() - start < 10


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("hot", [alignment.HOT_PAIRS, 30, 0])
def test_figures(spark, tools, hot):
    rows = [(None if i == 3 else i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, a_ids int").repartition(3)
    lengths = alignment.byte_lengths(BYTES, PIECES)
    aligned = alignment.saved(alignment.align(df, BYTES, PIECES), "test")
    got = alignment.describe(aligned, lengths, hot_pairs=hot)
    assert got.columns == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    ]
    assert rows_of(got) == sorted(naive(tools, [r[:2] for r in rows]), key=repr)


def test_groups_rebuild_the_text(spark, tools):
    df = spark.createDataFrame([(1, "Hello there, wörld 漢字\n" * 50)], "doc_id long, text string")
    row = alignment.align(df, BYTES, PIECES).first()
    at = to = 0
    for n_a, n_b in zip(row.a_sizes, row.b_sizes):
        own = b"".join(tools[2][i] for i in row.a_ids[at : at + n_a])
        assert own == b"".join(tools[3][i] for i in row.b_ids[to : to + n_b])
        at, to = at + n_a, to + n_b
    assert (at, to) == (len(row.a_ids), len(row.b_ids))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned_texts(df, BYTES, PIECES).collect() == []


def test_very_long_texts(spark, tools, monkeypatch):
    monkeypatch.setattr(alignment, "CHARS_AT_ONCE", 2_000)
    texts = ["some words \n\n  of a long text " * 400, "x" * 9_000, "a b " * 3_000, " " * 9_000 + "x" + "\n" * 9_000 + "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(alignment.aligned_texts(df, BYTES, PIECES)) == sorted(naive(tools, list(enumerate(texts))), key=repr)


def test_query(spark, tools):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = rows_of(queries.op11_align_tokens(spark, DATA))
    assert got == sorted(naive(tools, [tuple(r) for r in rows]), key=repr)
