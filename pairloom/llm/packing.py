"""Packing: sum-of-squares online placement of token sequences into windows.

For each fill level 0 < h < W a level array counts the open windows filled up to h. A document of s
tokens goes where the sum of the squared counts grows least: into a window of level h, which then has
level h + s, or into a new window (h = 0). Full windows leave the array. Documents longer than a window
are cut into whole windows, and what is left over is placed.

A task packs the documents of its own input partition: no shuffle. It holds the open windows only. When
more than ``max_open`` are open, the fullest quarter is closed: documents of the emptiest windows are cut to
fill their gaps. All others stay open on their levels, and placement by squares goes on. At the end all are
closed in this way, so that a task pads one window at most.

The result depends on the input's partitions, which for a table in files are the same when a task runs
again. An input whose rows come in another order each time should be written first.

Tokens: each stretch of text between spaces and line feeds is tokenised by itself and remembered within
the Python worker. That gives the ids of the whole text for tokenizers that drop white space, split letters from
punctuation, ignore case and mark word ends with ``</w>``, as ``word_bpe_49k.json`` does.

Nulls: a null text is an empty one, and consists of the end id alone. Empty table: no rows. Repeated
rows are packed as often as they occur. Other columns of the input are not looked at.
"""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairloom.llm.common import _arrow_type, field, parts_of

WINDOW = 4096
MAX_OPEN = 1024
# Distinct stretches of text that a Python worker remembers.
MEMO = 600_000
# How many of them stay when there are more, and at the end of a task: the first seen, which are the most
# frequent.
KEEP = 150_000
# Characters whose lower case may depend on their place or on the version of Unicode.
OTHER_CASE = re.compile("[^\x00-\u012f\u0131-\u024f]")
# Marks that make one word of the tokenizer however many stand together.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
# Characters of text that are tokenised together.
GROUP_CHARS = 2 << 20
BATCH_BYTES = 8 << 20


class Levels:
    """The level array: which fill level a document should be put on."""

    def __init__(self, window: int):
        self.window = window
        self.twice = np.zeros(window + 1, np.int64)  # 2 N(h) for the level that a window reaches
        # -2 N(h) for the level that a window leaves; out of reach where there is none.
        self.leave = np.full(window + 1, np.iinfo(np.int64).max // 4, np.int64)
        self.leave[0] = -1

    def best(self, size: int) -> int:
        """Level with the least growth of the sum of squares; the fullest of equals."""
        growth = self.twice[size:] + self.leave[: self.window + 1 - size]
        growth[-1] -= 1  # a full window adds no square
        return len(growth) - 1 - int(np.argmin(growth[::-1]))

    def add(self, level: int, change: int) -> None:
        if 0 < level < self.window:
            self.twice[level] += 2 * change
            count = self.twice[level]
            self.leave[level] = -count if count else np.iinfo(np.int64).max // 4


class Packer:
    """Places pieces (id, start, ids as bytes, tokens of the document) and gives back full windows."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.levels = Levels(window)
        self.open: dict[int, list[list[tuple]]] = {}
        self.n_open = 0

    def place(self, key, ids: bytes) -> Iterator[list[tuple]]:
        tokens = len(ids) // 4
        whole = tokens - tokens % self.window
        for start in range(0, whole, self.window):
            yield [(key, start, ids[4 * start : 4 * (start + self.window)], tokens)]
        size = tokens - whole
        if not size:
            return
        level = self.levels.best(size)
        if level:
            waiting = self.open[level]
            pieces = waiting.pop()
            if not waiting:
                del self.open[level]
            self.n_open -= 1
            self.levels.add(level, -1)
        else:
            pieces = []
        pieces.append((key, whole, ids[4 * whole :], tokens))
        if level + size == self.window:
            yield pieces
            return
        self.open.setdefault(level + size, []).append(pieces)
        self.n_open += 1
        self.levels.add(level + size, 1)
        if self.n_open > self.max_open:
            yield from self.close(last=False)

    def close(self, last: bool = True) -> Iterator[list[tuple]]:
        """Close the fullest quarter of the open windows, or the ``last`` time all of them.

        They are filled up by cutting documents of the emptiest windows. Only the very last window of all
        may be left with a gap.
        """
        windows = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.n_open, self.levels = {}, 0, Levels(self.window)
        first, donor = 0, len(windows) - 1
        closing = len(windows) if last else len(windows) // 4
        while first <= donor and first < closing:
            pieces = windows[first]
            gap = self.window - sum(len(p[2]) // 4 for p in pieces)
            while gap and first < donor:
                key, start, ids, tokens = windows[donor].pop()
                taken = min(gap, len(ids) // 4)
                pieces.append((key, start, ids[: 4 * taken], tokens))
                if len(ids) > 4 * taken:
                    windows[donor].append((key, start + taken, ids[4 * taken :], tokens))
                if not windows[donor]:
                    donor -= 1
                gap -= taken
            first += 1
            if gap and not last:
                self._keep(pieces)
            else:
                yield pieces
        for pieces in windows[first : donor + 1]:
            self._keep(pieces)

    def _keep(self, pieces: list[tuple]) -> None:
        level = sum(len(p[2]) // 4 for p in pieces)
        self.open.setdefault(level, []).append(pieces)
        self.n_open += 1
        self.levels.add(level, 1)


class Encoder:
    """Texts to ids, as little-endian bytes; stretches of text are remembered."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # For words that are in lower case, composed, and cut already, the merges alone.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.end = np.asarray([end_id], "<u4").tobytes()
        self.memo: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def many(self, texts: Sequence[str | None]) -> list[bytes]:
        if any(len(text or "") > 2 * GROUP_CHARS for text in texts):
            # Part by part, so that a very long text takes little beside itself and its ids.
            return [
                b"".join(self._ids([part])[0] for part in parts_of(text or "", GROUP_CHARS)) + self.end
                for text in texts
            ]
        return [ids + self.end for ids in self._ids(texts)]

    def _ids(self, texts: Sequence[str | None]) -> list[bytes]:
        parts = [_lowered(text or "").replace("\n", " ").split(" ") for text in texts]
        seen = set().union(*parts)
        unseen = seen - self.memo.keys()
        if len(self.memo) + len(unseen) > MEMO:
            self.trim()
            unseen = seen - self.memo.keys()
        self._learn(unseen)
        get = self.memo.__getitem__
        return [b"".join(map(get, stretches)) for stretches in parts]

    def trim(self) -> None:
        if len(self.memo) > KEEP:
            self.memo = dict(islice(self.memo.items(), KEEP))

    def _learn(self, unseen: set[str]) -> None:
        """Stretches of letters, and perhaps marks after them, go to the tokenizer in long lists."""
        plain = [stretch for stretch in unseen if stretch.isalpha()]
        marked, apart = [], []
        for stretch in unseen.difference(plain):
            word = stretch.rstrip(MARKS)
            if word.isalpha():
                marked.append(stretch)
                apart.append(f"{word} {stretch[len(word) :]}")
            else:
                self.memo[stretch] = self._one(stretch)
        self._learn_list(plain, plain, 1)
        self._learn_list(marked, apart, 2)

    def _learn_list(self, stretches: list[str], words: list[str], words_each: int) -> None:
        """Many stretches in one call; the last token of each word carries the word end."""
        lists = [stretches[i : i + 500] for i in range(0, len(stretches), 500)]
        joined = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        simple = all(not OTHER_CASE.search(text) and text == text.lower() for text in joined)
        encode = (self.merges if simple else self.tokenizer).encode_batch_fast
        for some, encoding in zip(lists, encode(joined, add_special_tokens=False)):
            ids = np.asarray(encoding.ids, "<u4")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
            if len(ends) != words_each * len(some) or ends[-1] != 4 * len(ids):
                # A letter that falls apart in lower case, and so makes more words.
                self.memo.update((stretch, self._one(stretch)) for stretch in some)
                continue
            raw, ends = ids.tobytes(), ends[words_each - 1 :: words_each].tolist()
            cuts = map(slice, [0, *ends[:-1]], ends)
            self.memo.update(zip(some, map(raw.__getitem__, cuts)))

    def _one(self, stretch: str) -> bytes:
        ids = self.tokenizer.encode(stretch, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()


def worker_encoder(path: str, end_id: int) -> Encoder:
    """One encoder per Python worker, which outlives the task: later tasks find the words it has seen."""
    store = sys.modules.setdefault("pairloom_worker_store", types.ModuleType("pairloom_worker_store"))
    key = f"{path} {end_id}"
    if key not in store.__dict__:
        store.__dict__[key] = Encoder(path, end_id)
    return store.__dict__[key]


def _lowered(text: str) -> str:
    """In lower case where Python and the tokenizer are sure to agree, so that fewer stretches differ."""
    return text if OTHER_CASE.search(text) or "<|" in text else text.lower()


def _in_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(keys, texts) of at most GROUP_CHARS characters, or of one text."""
    keys, texts, chars = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            keys.append(key.as_py())
            texts.append(text.as_py())
            chars += len(texts[-1] or "")
            if chars >= GROUP_CHARS:
                yield keys, texts
                keys, texts, chars = [], [], 0
    if keys:
        yield keys, texts


def pack(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = 2,
    max_open: int = MAX_OPEN,
) -> DataFrame:
    """One row per piece: (id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers, ``start`` how many ids of
    its document lie before it, ``offset`` how many ids of its sequence do. ``tokenizer`` is the path
    of a tokenizer file that every executor has.
    """
    schema = T.StructType(
        [
            field(df, id_col),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    arrow = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, end_id)
        packer = Packer(window, max_open)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, size
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)]
            rows, size = [], 0
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        def windows() -> Iterator[list[tuple]]:
            for keys, texts in _in_groups(batches):
                for key, ids in zip(keys, encoder.many(texts)):
                    yield from packer.place(key, ids)
            encoder.trim()  # the worker lives on, perhaps with other work
            yield from packer.close()

        for pieces in windows():
            offset = 0
            for key, start, ids, tokens in pieces:
                length = len(ids) // 4
                rows.append((key, start, length, ids, tokens, sequence, offset))
                offset += length
                size += len(ids)
            sequence += 1
            if size >= BATCH_BYTES:
                yield flush()
        if rows:
            yield flush()

    return df.select(id_col, text_col).mapInArrow(run, schema)
