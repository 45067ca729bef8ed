"""Cross-tokenizer alignment: divide and conquer at shared cuts, and corpus-wide counts of linked ids.

Two tokenizers cut the bytes of one text. Where a token of each ends at the same byte there is a shared
cut. Within an interval the shared cut nearest to the middle is located: the ends of one side around the
middle are looked up by bisection among those of the other, in a window that doubles until one is found.
The interval is split there and both halves are treated alike; an interval without a shared cut inside is
a leaf, one group. All intervals of one depth are worked off together, as columns of a batch.

``align`` returns tokens and groups of each text. ``link_counts`` counts over the whole corpus how often
two ids overlap; ``describe`` gives the figures of each text against those counts.

How the work is spread: texts are encoded where they are read and written once, as lists of ids and group
sizes; no text is shuffled. Counts fold within a task before they are shuffled by pair of ids. The
``HOT_PAIRS`` most frequent pairs go to every task (17 bytes each); rarer ones, of which no text can hold
a large share, are joined. Both ways give the same sums, so results do not depend on the bound.

Very long texts are encoded and aligned in parts that end before a space between other characters: neither
tokenizer has a token that reaches across one, so both sides share a cut there. What stands between two such
cuts is a word; a task remembers the ids of words, ``WORD_CHARS`` characters of them, and alignment begins with
the words as intervals.

Nulls: a null text has no tokens, as an empty one and one whose bytes a tokenizer does not give back; a
null id is passed on. Special tokens' strings within a text are plain text. Repeated rows are rows of
their own, and their links are counted each time. Empty table: no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import ROWS_AT_ONCE, arrow_bytes, field, saved, small_batches

# Characters that are encoded and aligned together.
CHARS_AT_ONCE = 1 << 19
# Characters of words whose ids a task remembers.
WORD_CHARS = 1 << 21
# Words that are encoded as one text.
WORDS_TOGETHER = 1024
# Bytes that a task's writer of token ids holds.
WRITER_BYTES = 16 << 20
# Pairs of ids whose counts every task holds.
HOT_PAIRS = 1 << 20
# Pairs of ids that a task folds before it passes them on.
FOLD = 1 << 19

ALIGNED = "a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"
_LISTS = ("a_ids", "b_ids", "a_sizes", "b_sizes")
# A space where a text may be cut.
_CUT = re.compile(r" (?<=[^ ] )(?=\S)")
# Longer runs of white space are left to the tokenizer file's own library.
_LONG_RUN = re.compile(r"\s{2000}")
# Fixed value: how byte-level tokenizers of this kind split a text before they merge.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_vocabulary(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    entries = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    special = {t["id"] for t in spec.get("added_tokens", [])}
    code = byte_level_bytes()
    found = [b""] * (max(entries.values()) + 1)
    for token, i in entries.items():
        found[i] = token.encode() if i in special else bytes(code[c] for c in token)
    return found


def piece_vocabulary(model) -> list[bytes]:
    """Bytes of each id of a piece model: the mark is a space, byte pieces are their byte."""
    found = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        found.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return found


def _segments(text: str) -> Iterator[str]:
    """A text in parts of bounded size, cut at spaces; each stands for a space and itself."""
    at = 0
    while len(text) - at > CHARS_AT_ONCE:
        found = _CUT.search(text, at + CHARS_AT_ONCE)
        if not found:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


def _by_rank(byte_file: str, found: list[bytes]):
    """An encoder that merges by the rank of ids, if ids are in the order of merges, else None.

    It gives the ids of the tokenizer file three times as fast.
    """
    import tiktoken

    with open(byte_file, encoding="utf-8") as file:
        model = json.load(file)["model"]
    ids, code = model["vocab"], byte_level_bytes()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if [ids.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))) or any(ids.get(c, 256) > 255 for c in code):
        return None
    ranks = {found[i]: i for i in range(256 + len(pairs))}
    return tiktoken.Encoding("ranks", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoders:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, byte_file: str, piece_file: str):
        import sentencepiece

        self.byte_file = byte_file
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.a_bytes, self.b_bytes = byte_vocabulary(byte_file), piece_vocabulary(self.b)
        self.a_len, self.b_len = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.by_rank = _by_rank(byte_file, self.a_bytes)

    @cached_property
    def by_file(self):
        """The tokenizer file's own library, which takes much memory and is seldom needed."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.byte_file)
        tokenizer.encode_special_tokens = True
        return tokenizer

    def _a(self, text: str) -> list[int]:
        if self.by_rank is None or _LONG_RUN.search(text):
            return self.by_file.encode(text, add_special_tokens=False).ids
        return self.by_rank(text)

    def encode(self, segments: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both tokenizers for each segment; None where bytes are not given back."""
        out = []
        for segment, ids_b in zip(segments, self.b.encode(segments, num_threads=1)):
            ids_a, want = self._a(" " + segment), (" " + segment).encode()
            same = b"".join([self.a_bytes[i] for i in ids_a]) == want == b"".join([self.b_bytes[i] for i in ids_b])
            out.append((np.array(ids_a, np.int32), np.array(ids_b, np.int32)) if same else None)
        return out


class _Words:
    """Ids of both tokenizers for words that were met before; a word is what stands between two cuts.

    Neither tokenizer has a token that reaches across a cut, so a text's ids are those of its words. New words
    are encoded many together, as texts, and taken apart where both sides have an end.
    """

    def __init__(self, encoders: Encoders):
        self.encoders = encoders
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}  # -1: bytes are not given back
        self.chars = 0
        # For each side the ids of all words, and where each word's end.
        self.ids = [np.zeros(0, np.int32) for _ in range(2)]
        self.stops = [np.zeros(1, np.int64) for _ in range(2)]

    def encode(self, segments: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
        """What ``Encoders.encode`` gives for each segment, and where its words end on side a."""
        if self.chars > WORD_CHARS:
            self._clear()
        rows = [_CUT.split(segment) for segment in segments]
        words = [w for row in rows for w in row]
        self._learn([w for w in dict.fromkeys(words) if w not in self.places])
        places = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        ends = np.cumsum([len(row) for row in rows])
        known = places >= 0
        sides = []
        for ids, stops in zip(self.ids, self.stops):
            first = np.where(known, stops[places], 0)
            sizes = np.where(known, stops[places + 1], 0) - first
            word_stops = np.cumsum(sizes)
            sides.append((ids[_ranges(first, sizes)], word_stops, [0, *word_stops[ends - 1].tolist()]))
        (a, a_words, a_at), (b, _, b_at) = sides
        out, first = [], 0
        for i, end in enumerate(ends.tolist()):
            if known[first:end].all():
                out.append((a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]], a_words[first:end] - a_at[i]))
            else:
                # A word that is not given back alone may be so within its text.
                pair = self.encoders.encode([segments[i]])[0]
                out.append(pair and (*pair, np.array([len(pair[0])])))
            first = end
        return out

    def _learn(self, words: list[str]) -> None:
        # Next to white space at an end would be no cut.
        apart = [w for w in words if not w or w[0].isspace() or w[-1] == " "]
        odd = set(apart)
        together = [w for w in words if w not in odd]
        chunks = [together[at : at + WORDS_TOGETHER] for at in range(0, len(together), WORDS_TOGETHER)]
        kept = []
        for chunk, pair in zip(chunks, self.encoders.encode([" ".join(chunk) for chunk in chunks])):
            stops = pair and self._stops(chunk, pair)
            if stops:
                kept.append((chunk, pair, stops))
            else:
                apart += chunk
        for word, pair in zip(apart, self.encoders.encode(apart)):
            if pair:
                kept.append(([word], pair, [[len(ids)] for ids in pair]))
            else:
                self.places[word] = -1
                self.chars += len(word)
        self._keep(kept)

    def _stops(self, words: list[str], pair) -> list[np.ndarray] | None:
        """Where each word's ids end on both sides, if they do."""
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        found = []
        for ids, length in zip(pair, (self.encoders.a_len, self.encoders.b_len)):
            token_ends = np.cumsum(length[ids])
            at = np.searchsorted(token_ends, ends)
            if not np.array_equal(token_ends[at], ends):
                return None
            found.append(at + 1)
        return found

    def _keep(self, kept: list[tuple]) -> None:
        words = [w for chunk, _, _ in kept for w in chunk]
        first = len(self.stops[0]) - 1
        self.places.update(zip(words, range(first, first + len(words))))
        self.chars += sum(map(len, words))
        for side in range(2):
            ids = [pair[side] for _, pair, _ in kept]
            sizes = [np.diff(stops[side], prepend=0) for _, _, stops in kept]
            self.ids[side] = np.concatenate([self.ids[side], *ids])
            self.stops[side] = np.cumsum(np.concatenate([[0], np.diff(self.stops[side]), *sizes]), dtype=np.int64)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each pair, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Which ends of side a within the intervals [low, high) are also ends of side b.

    Both lists ascend. Each round looks at a window around the middle of each open interval.
    """
    shared = np.zeros(len(a_ends), bool)
    width = np.zeros(len(lows), np.int64)
    while True:
        open_ = lows < highs
        lows, highs, width = lows[open_], highs[open_], width[open_]
        if not len(lows):
            return shared
        middle = (lows + highs) // 2
        first, last = np.maximum(lows, middle - width), np.minimum(highs, middle + width + 1)
        sizes = last - first
        places = _ranges(first, sizes)
        ends = a_ends[places]
        hit = b_ends[np.minimum(np.searchsorted(b_ends, ends), len(b_ends) - 1)] == ends
        # The hit nearest to the middle; of two, the one before it.
        far = np.abs(4 * (places - np.repeat(middle, sizes)) + 1)
        far[~hit] = np.iinfo(np.int64).max
        starts = np.cumsum(sizes) - sizes
        nearest = np.minimum.reduceat(far, starts)
        found = nearest < np.iinfo(np.int64).max
        chosen = (far == np.repeat(nearest, sizes)) & hit
        cuts = places[chosen]
        shared[cuts] = True
        again = ~found & ((first > lows) | (last < highs))
        lows = np.concatenate([lows[found], cuts + 1, lows[again]])
        highs = np.concatenate([cuts, highs[found], highs[again]])
        width = np.concatenate([np.zeros(2 * len(cuts), np.int64), 2 * width[again] + 1])


def group_sizes(a_ends: np.ndarray, b_ends: np.ndarray, a_lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each side in each group. ``a_lasts``: the last token of each word, or segment, on side a."""
    lows = np.concatenate([[0], a_lasts[:-1] + 1])
    shared = shared_cuts(a_ends, b_ends, lows, a_lasts)
    shared[a_lasts] = True
    at = np.flatnonzero(shared)
    b_at = np.searchsorted(b_ends, a_ends[at])
    return np.diff(at, prepend=-1), np.diff(b_at, prepend=-1)


def _aligner(byte_file: str, piece_file: str):
    encoders = Encoders(byte_file, piece_file)
    words = _Words(encoders)
    a_len, b_len = encoders.a_len, encoders.b_len
    empty = np.zeros(0, np.int32)

    def group(segments: list[tuple[int, str]]) -> Iterator[tuple[int, tuple | None]]:
        """(text number, its four lists or None) for each segment."""
        found = words.encode([segment for _, segment in segments])
        good = [pair for pair in found if pair is not None]
        lists = []
        if good:
            a, b, word_stops = (np.concatenate(side) for side in zip(*good))
            a_stops, b_stops, n_words = (np.cumsum([len(x) for x in side]) for side in zip(*good))
            word_stops += np.repeat(a_stops - np.diff(a_stops, prepend=0), np.diff(n_words, prepend=0))
            a_sizes, b_sizes = group_sizes(np.cumsum(a_len[a]), np.cumsum(b_len[b]), word_stops - 1)
            stops = np.searchsorted(np.cumsum(a_sizes), a_stops) + 1
            parts = [np.split(x, s[:-1]) for x, s in ((a, a_stops), (b, b_stops), (a_sizes, stops), (b_sizes, stops))]
            lists = list(zip(*parts))
        at = iter(lists)
        for (number, _), pair in zip(segments, found):
            yield number, None if pair is None else next(at)

    def run(texts: list[str | None]) -> list[list[np.ndarray]]:
        """The four list columns of some texts."""
        kept: list[list[tuple] | None] = [[] for _ in texts]

        def take(segments: list[tuple[int, str]]) -> None:
            for number, lists in group(segments):
                if lists is None:
                    kept[number] = None
                elif kept[number] is not None:
                    kept[number].append(lists)

        waiting, chars = [], 0
        for number, text in enumerate(texts):
            for segment in _segments(text) if text else ():
                waiting.append((number, segment))
                chars += len(segment)
                if chars >= CHARS_AT_ONCE:
                    take(waiting)
                    waiting, chars = [], 0
        if waiting:
            take(waiting)
        return [
            [np.concatenate(column).astype(np.int32) for column in zip(*lists)] if lists else [empty] * 4
            for lists in kept
        ]

    return run


def _list_array(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def align(
    df: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, a_ids, b_ids, a_sizes, b_sizes): token ids of both sides, and how many each group takes.

    Side a is the byte-level tokenizer of ``byte_file`` over a space and the text, side b the pieces of
    ``piece_file``, which put that space in front themselves. Both are paths that every executor has.
    """
    id_type = field(df, id_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_file, piece_file)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                columns = zip(*aligner(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[_list_array(list(c)) for c in columns]], names=[id_col, *_LISTS]
                )

    schema = f"`{id_col}` {id_type.dataType.simpleString()}, {ALIGNED}"
    return df.select(id_col, text_col).mapInArrow(run, schema)


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each row's begin."""
    column = batch.column(name)
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _links(a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair code, token of side a) of each pair of tokens whose bytes overlap."""
    a_ends, b_ends = np.cumsum(a_len[a]), np.cumsum(b_len[b])
    first = np.searchsorted(b_ends, a_ends - a_len[a], "right")
    last = np.searchsorted(b_ends, a_ends, "left")
    sizes = last - first + 1
    from_a = np.repeat(np.arange(len(a)), sizes)
    return a[from_a].astype(np.int64) * len(b_len) + b[_ranges(first, sizes)], from_a


def _folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = np.zeros(len(codes), np.int64)
    np.add.at(sums, at, np.concatenate([p[1] for p in parts]))
    return codes, sums


def byte_lengths(byte_file: str, piece_file: str) -> tuple[np.ndarray, np.ndarray]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_file)
    return tuple(np.array([len(x) for x in v], np.int64) for v in (byte_vocabulary(byte_file), piece_vocabulary(model)))


def link_counts(aligned: DataFrame, lengths: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(code, n, best): how many links hold a pair of ids, and whether no other id is linked more often
    with the pair's id of side b. The code is id a x size of vocabulary b + id b."""
    a_len, b_len = lengths

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(part):
            return pa.RecordBatch.from_pydict({"code": part[0], "n": part[1]})

        waiting, size = [], 0
        for batch in batches:
            codes, _ = _links(_flat(batch, "a_ids")[0], _flat(batch, "b_ids")[0], a_len, b_len)
            waiting.append(np.unique(codes, return_counts=True))
            size += len(waiting[-1][0])
            if size >= 2 * FOLD:
                waiting = [_folded(waiting)]
                size = len(waiting[0][0])
                if size >= FOLD:
                    yield rows(waiting[0])
                    waiting, size = [], 0
        if waiting:
            yield rows(_folded(waiting))

    counted = aligned.select("a_ids", "b_ids").mapInArrow(run, "code long, n long")
    counted = saved(counted.groupBy("code").agg(F.sum("n").alias("n")), "link-counts")
    b_id = F.col("code") % len(b_len)
    most = counted.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # at most a row per id of side b
    return counted.join(F.broadcast(most), b_id == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def _threshold(counts: DataFrame, most: int) -> int:
    """The least count from which on there are at most ``most`` pairs."""
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs"), F.min("n").alias("n")).collect()
    total, least = 0, None
    for row in sorted(levels, key=lambda r: -r.level):  # at most 8 x 63 levels
        total += row.pairs
        if total > most:
            break
        least = row.n
    return least if least is not None else max((r.n for r in levels), default=0) + 1


def _entries(size_a: int, size_b: int) -> np.ndarray:
    """Each id in decimals with what may follow it, padded with zero bytes to eight."""
    texts = [b"%d%s" % (i, mark) for mark in (b",", b"|") for i in range(size_a)]
    texts += [b"%d%s" % (i, mark) for mark in (b",", b";", b"") for i in range(size_b)]
    return np.array(texts, "S8").view(np.uint64)


def _group_texts(batch: pa.RecordBatch, entries: np.ndarray, size_a: int, size_b: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each row."""
    (a, a_at), (b, b_at) = _flat(batch, "a_ids"), _flat(batch, "b_ids")
    (a_sizes, at), (b_sizes, _) = _flat(batch, "a_sizes"), _flat(batch, "b_sizes")
    a_stops, b_stops = np.cumsum(a_sizes, dtype=np.int64), np.cumsum(b_sizes, dtype=np.int64)
    marked = np.empty(len(a) + len(b), np.int64)
    with_a = a.astype(np.int64)
    with_a[a_stops - 1] += size_a
    with_b = b.astype(np.int64) + 2 * size_a
    with_b[b_stops - 1] += size_b
    with_b[b_at[1:][b_at[1:] > b_at[:-1]] - 1] += size_b
    marked[np.arange(len(a)) + np.repeat(b_stops - b_sizes, a_sizes)] = with_a
    marked[np.arange(len(b)) + np.repeat(a_stops, b_sizes)] = with_b
    raw = entries[marked].tobytes()
    stops = 8 * (a_at + b_at).astype(np.int64)
    return [raw[s:e].translate(None, b"\0") for s, e in zip(stops.tolist(), stops[1:].tolist())]


def describe(
    aligned: DataFrame, lengths: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", hot_pairs: int = HOT_PAIRS
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text.

    ``aligned`` is read twice, so it should be a written table.
    """
    spark = aligned.sparkSession
    counts = saved(link_counts(aligned, lengths), "link-counts")
    least = _threshold(counts, hot_pairs)
    got = counts.filter(F.col("n") >= least).toArrow()  # at most ``hot_pairs`` rows
    order = np.argsort(got["code"].to_numpy())
    hot = tuple(got[name].to_numpy()[order] for name in ("code", "n", "best"))
    shared = spark.sparkContext.broadcast((*lengths, *hot))
    id_type = field(aligned, id_col).dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_len, b_len, codes, counts, best = shared.value
        entries = _entries(len(a_len), len(b_len))
        # A last entry that no pair has.
        codes = np.append(codes, np.iinfo(np.int64).max)
        counts, best = np.append(counts, 0), np.append(best, False)
        for batch in batches:
            (a, a_at), (b, b_at), (_, at) = (_flat(batch, n) for n in ("a_ids", "b_ids", "a_sizes"))
            links, from_a = _links(a, b, a_len, b_len)
            found, back = np.unique(links, return_inverse=True)
            place = np.searchsorted(codes, found)
            known = codes[place] == found
            n = np.where(known, counts[place], 0)[back]
            top = (known & best[place])[back]
            stops = np.searchsorted(from_a, a_at)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[stops]) for x in (top, n)]
            rare = np.flatnonzero(~known[back])
            rare_at = np.searchsorted(rare, stops).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "row": batch.column("row"),
                    id_col: batch.column(id_col),
                    "n_a": np.diff(a_at).astype(np.int64),
                    "n_b": np.diff(b_at).astype(np.int64),
                    "n_groups": np.diff(at).astype(np.int64),
                    "n_links": np.diff(stops).astype(np.int64),
                    "n_best": sums[0],
                    "count_sum": sums[1],
                    "groups_sha256": [
                        hashlib.sha256(x).hexdigest() if x else ""
                        for x in _group_texts(batch, entries, len(a_len), len(b_len))
                    ],
                    "rare": pa.ListArray.from_arrays(pa.array(rare_at), pa.array(links[rare])),
                }
            )

    schema = (
        f"row long, `{id_col}` {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
        "count_sum long, groups_sha256 string, rare array<long>"
    )
    rows = saved(aligned.select(F.monotonically_increasing_id().alias("row"), id_col, *_LISTS).mapInArrow(run, schema), "links")
    # Links with a pair that is not among the hot ones; no such pair has more than ``least`` of them.
    rest = (
        rows.select("row", F.explode("rare").alias("code"))
        .groupBy("row", "code")
        .agg(F.count("*").alias("links"))
        .join(counts.filter(F.col("n") < least), "code")
        .groupBy("row")
        .agg(
            F.sum(F.col("links") * F.col("n")).alias("more"),
            F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"),
        )
    )
    if not rows.filter(F.size("rare") > 0).isEmpty():
        rows = rows.join(rest, "row", "left")
    else:
        rows = rows.withColumns({"more": F.lit(0), "more_best": F.lit(0)})
    return rows.select(
        id_col, "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def aligned_texts(
    df: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The figures of ``describe`` for each row."""
    session = small_batches(df.sparkSession)
    aligned = align(df, byte_file, piece_file, id_col, text_col)
    with arrow_bytes(df.sparkSession):
        aligned = saved(aligned, "aligned", session, **{"parquet.block.size": WRITER_BYTES})
    return describe(aligned, byte_lengths(byte_file, piece_file), id_col)
