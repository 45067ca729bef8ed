"""Token counts: Viterbi over a unigram vocabulary that carries a score and a count, but no path.

An Aho-Corasick automaton lists all pieces that end at each place of a word; dynamic programming keeps,
for each place, the best score that reaches it and the number of pieces of that best way. Ties are
resolved as the public unigram tokenizer does: places are extended from left to right, and a later way
replaces an earlier one only if its score is strictly greater, so of equal ways the one whose last piece
is longest stays. Where no single-character piece starts, an unknown piece of one character stands in,
ten below the lowest score; unknown pieces in a row count as one.

Text is cut as the tokenizer's own pre-tokenizer does: spaces become U+2581, one is put in front unless
the text starts with it, and a word starts at each. Pieces never cross words, so words are counted alone
and remembered within the Python worker; a text's count is the sum. Very long words take time in
proportion to their length.

Nulls: a null text has 0 tokens, as an empty one; a null id is passed on. Empty table: no rows. Repeated
rows are counted each. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairloom.llm.common import field, map_rows, parts_of

MARK = "▁"
UNKNOWN_PENALTY = 10.0
# Words that a task remembers.
MEMO = 400_000
# A longer word is not remembered.
LONG_WORD = 64
# Characters of a text that are split into words together.
PART = 4 << 20


def zipf_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a public piece file with unigram scores by rank, log 1 / (rank + 10).

    The file gives pieces in the order of their ids, which for merged pieces is the order of merging and
    so nearly that of frequency; it has no unigram probabilities of its own. Control, unknown and byte
    pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    return [(piece, -math.log(rank + 10.0)) for rank, piece in enumerate(pieces)]


class Counter:
    """Counts the pieces of the best segmentation of words."""

    def __init__(self, vocabulary: Sequence[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.longest = max(len(piece) for piece, _ in vocabulary)
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of one word, without remembering it. Memory does not grow with the word."""
        # Best score up to each of the last places, and pieces on that way.
        ring = self.longest + 1
        best, count, unknown = [0.0] * ring, [0] * ring, False
        single, hits = self.single, self.automaton.iter(word)
        hit = next(hits, None)
        for end in range(1, len(word) + 1):
            found = []
            while hit is not None and hit[0] < end:
                found.append(hit[1])
                hit = next(hits, None)
            top, pieces, odd = None, 0, False
            # Longest first is the order of start places.
            for length, score in sorted(found, reverse=True) if len(found) > 1 else found:
                start = (end - length) % ring
                if top is None or best[start] + score > top:
                    top, pieces = best[start] + score, count[start] + 1
            if word[end - 1] not in single:
                start = (end - 1) % ring
                score = best[start] + self.unknown
                if top is None or score > top:
                    top, pieces, odd = score, count[start] + (0 if unknown else 1), True
            best[end % ring], count[end % ring], unknown = top, pieces, odd
        return count[len(word) % ring]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        # A text that starts with a mark gets none in front; any other word begins with its mark.
        text = text[1:] if text[0] == " " else text
        return sum(map(self._words, parts_of(text, PART, " ")))

    def _words(self, part: str) -> int:
        memo, total = self.memo, 0
        for word in part.split(" "):
            found = memo.get(word)
            if found is None:
                found = self.word(MARK + word)
                if len(word) <= LONG_WORD:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = found
            total += found
        return total


def count_tokens(df: DataFrame, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, n_tokens) for each row. ``piece_file`` is a path that every executor has."""
    schema = T.StructType(
        [field(df, id_col), T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )

    def make():
        counter = Counter(zipf_vocabulary(piece_file))

        def run(columns: dict[str, list]) -> dict[str, list]:
            texts = columns[text_col]
            return {
                id_col: columns[id_col],
                "n_chars": [len(text or "") for text in texts],
                "n_tokens": [counter.text(text) for text in texts],
            }

        return run

    return map_rows(df.select(id_col, text_col), make, schema)
