"""Token counts under a unigram vocabulary, without keeping the tokens.

An Aho-Corasick automaton enumerates the vocabulary pieces inside a word; dynamic programming over its characters carries the best
score and its number of pieces. Ties follow the usual unigram tokenizer: only a strictly better score replaces a path, starts
are taken from left to right, characters in no piece cost ten less than the least score, and runs of those count as one piece.
Texts are normalised first: white space at either end goes, and each run of white space inside counts as one space, which marks the
begin of a word. With that normaliser the counts are those of the tokenizers library's unigram model under a Metaspace splitter.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, map_texts

#: Marks the begin of a word in the vocabulary.
MARK = "▁"
#: Words a worker remembers before it forgets them all.
REMEMBERED = 400_000
UNKNOWN_PENALTY = 10.0
RESULT = "n_tokens long, n_words long, n_unknown long, best_score double"


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, control and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]


class Counter:
    """Counts pieces of words; words are remembered."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.singles = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, int, float]] = {}

    def word(self, word: str) -> tuple[int, int, float]:
        """(pieces, of them unknown, score) of one word, its mark included."""
        text = MARK + word
        n = len(text)
        if self.singles.issuperset(text):  # nothing unknown: one pass over the matches, by end, those that start first coming first
            most: list[float | None] = [None] * (n + 1)
            count = [0] * (n + 1)
            most[0] = 0.0
            for last, (length, score) in self.automaton.iter(text):
                start = last + 1 - length
                total = most[start] + score
                so_far = most[last + 1]
                if so_far is None or total > so_far:
                    most[last + 1] = total
                    count[last + 1] = count[start] + 1
            return count[n], 0, most[n]
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        if len(self.automaton):
            for last, (length, score) in self.automaton.iter(text):
                ending[last + 1].append((last + 1 - length, score))
        best = [0.0] * (n + 1)
        pieces, unknown, in_unknown = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        single = [False] * n
        for end in range(1, n + 1):
            for start, _ in ending[end]:
                if start == end - 1:
                    single[start] = True
        for end in range(1, n + 1):
            options = sorted(ending[end])
            if not single[end - 1]:
                options.append((end - 1, None))
            chosen, score = options[0][0], None
            for start, value in options:
                total = best[start] + (self.unknown if value is None else value)
                if score is None or total > score:
                    chosen, score, gap = start, total, value is None
            best[end] = score
            joined = gap and in_unknown[chosen]
            pieces[end] = pieces[chosen] + (not joined)
            unknown[end] = unknown[chosen] + (gap and not joined)
            in_unknown[end] = gap
        return pieces[n], unknown[n], best[n]

    def text(self, text: str) -> tuple[int, int, int, float]:
        known = self.known
        words = re.split(r"\s+", text.strip()) if text.strip() else []
        if len(known) > REMEMBERED:
            known.clear()
        total, unknown, score = 0, 0, 0.0
        for w in words:
            got = known.get(w)
            if got is None:
                got = self.word(w)
                if len(w) <= 64:
                    known[w] = got
            total += got[0]
            unknown += got[1]
            score += got[2]
        return total, len(words), unknown, score


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_tokens, n_words, n_unknown, best_score.

    Words are split at white space and each is marked at its begin. Null, empty and blank texts have no tokens and score 0. Repeated
    rows and null ids stay. The vocabulary (fixed in size, not by the data) travels once to each executor.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vocabulary))
    name = f"unigram {zlib.crc32(repr(vocabulary).encode())} {len(vocabulary)}"

    def counted(counter: Counter, texts: pa.Array) -> dict:
        rows = [counter.text(t) for t in texts.to_pylist()]
        columns = list(zip(*rows, strict=True))
        return {"n_tokens": pa.array(columns[0], pa.int64()), "n_words": pa.array(columns[1], pa.int64()), "n_unknown": pa.array(columns[2], pa.int64()), "best_score": np.array(columns[3], float)}

    def kernel():
        counter = kept(name, lambda: Counter(list(shared.value)))
        return lambda texts: counted(counter, texts)

    return map_texts(docs, kernel, RESULT, id_col, text_col, keep=name)
