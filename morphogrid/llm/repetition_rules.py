"""Quality rules: how much of a text lies inside repeated n-grams and repeated lines.

Rolling 64-bit hashes of the words' n-grams, for several n at once, are compared within each text in numpy; a character counts
when its word lies in an n-gram found twice or more, or its line equals an earlier one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec as tv
from .common import filter_texts, map_texts

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80

RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, dup_5gram_share double, dup_9gram_share double"


def measure(texts: pa.Array, max_line_share: float, max_5gram_share: float, max_9gram_share: float) -> dict:
    data, offsets = tv.buffers(texts)
    count = len(texts)
    starts, ends, owner = tv.spans(data, offsets, tv.SPACED)
    chars = np.concatenate(([0], np.cumsum(FIRST_BYTE[data], dtype=np.int64)))
    width = chars[ends] - chars[starts]
    hashes = tv.span_hashes(data, starts, ends)
    n_words, word_chars = tv.per_text(owner, count), tv.per_text(owner, count, width)
    n_repeat = tv.per_text(owner, count, tv.covered(hashes, owner, 3))

    begin, end, of = tv.lines(data, offsets)
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    full = last > first
    begin, end, of, first, last = begin[full], end[full], of[full], first[full], last[full]
    key = tv.span_hashes(data, begin, end) ^ tv.mix(of.astype(tv.U64))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    sums = np.concatenate(([0], np.cumsum(width)))
    line_chars = tv.per_text(of, count, (sums[last] - sums[first]) * again)

    share = lambda x: x / np.maximum(word_chars, 1)
    by_line = share(line_chars)
    by_5, by_9 = (share(tv.per_text(owner, count, width * tv.covered(hashes, owner, n))) for n in (5, 9))
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": tv.count_bytes(data, offsets, SYMBOLS), "n_dup_lines": tv.per_text(of, count, again), "n_repeat_words": n_repeat,
        "base_failed": failed, "kept": ~failed & (by_line <= max_line_share) & (by_5 <= max_5gram_share) & (by_9 <= max_9gram_share),
        "dup_line_share": by_line, "dup_5gram_share": by_5, "dup_9gram_share": by_9,
    }


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_line_share: float = 0.5, max_5gram_share: float = 0.45, max_9gram_share: float = 0.4) -> DataFrame:
    """One row for each row of `docs`, repeated rows and null ids included: counts, shares and the verdict.

    Words are runs of characters other than space and U+0009..U+000D. `base_failed`: under 50 words, or over half of the words in
    repeated 3-word windows. `kept`: not failed, and no share of repeated characters over its limit. A null or empty text has no
    words, all counts 0, and fails. Other columns of `docs` aren't read; an empty table gives an empty result.
    """
    return map_texts(docs, lambda texts: measure(texts, max_line_share, max_5gram_share, max_9gram_share), RESULT, id_col, text_col)


def kept_rows(docs: DataFrame, text_col: str = "text", max_line_share: float = 0.5, max_5gram_share: float = 0.45, max_9gram_share: float = 0.4) -> DataFrame:
    """The rows of `docs` whose texts `repetition_rules` keeps, with all their columns; each row is judged by itself."""
    return filter_texts(docs, lambda texts: measure(texts, max_line_share, max_5gram_share, max_9gram_share)["kept"], text_col)
