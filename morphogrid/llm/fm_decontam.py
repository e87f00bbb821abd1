"""Benchmark decontamination with an FM-index over each shard of training text.

A shard (a few megabytes of documents inside one task) is rewritten as numbers of benchmark words, all other words being breaks, and
stretches too short to hold any phrase left out. Its suffix array gives the Burrows-Wheeler transform, kept as a wavelet matrix
whose ranks drive backward search for all phrases at once; sampled suffix positions locate the occurrences by walking back, and the
removal spans merge per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import durable, releasing, text_batches

WINDOW = 8
#: Bytes of documents in one index, and of benchmark text in one block; more blocks mean more passes.
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 32 << 20
SAMPLE = 8
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TO_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector with running counts for each bit."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.ones, self.zeros = [], []
        self.bits = list(range(max(1, (symbols - 1).bit_length()) - 1, -1, -1))
        for bit in self.bits:
            set_ = (sequence >> bit) & 1
            ones = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(set_, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(sequence) - int(ones[-1]))
            sequence = np.concatenate((sequence[set_ == 0], sequence[set_ == 1]))
        # equal symbols are together now, in an order of their own
        self.begin = np.zeros(symbols, np.int64)
        if len(sequence):
            first = np.flatnonzero(np.append(True, sequence[1:] != sequence[:-1]))
            self.begin[sequence[first]] = first

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        at = position
        for bit, ones, zeros in zip(self.bits, self.ones, self.zeros, strict=True):
            before = ones[at]
            at = np.where((symbol >> bit) & 1, zeros + before, at - before)
        return at - self.begin[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; each 0 is a break of its own, ordered by place, before all symbols."""
    n = len(text)
    breaks = text == 0
    rank = np.where(breaks, np.cumsum(breaks) - 1, text.astype(np.int64) + n)
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        step = np.append(False, rank[order][1:] != rank[order][:-1])
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(step)
        if dense[order[-1]] == n - 1:
            return order
        follow = np.zeros(n, np.int64)
        follow[:-width] = dense[width:] + 1
        rank = dense * (n + 1) + follow
        order = np.argsort(rank, kind="stable")
        width *= 2


class FmIndex:
    """Full-text index of one shard; symbols from 1 on, 0 breaks the text, which must end in a break."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_order(text)
        last = text[order - 1]
        counts = np.bincount(text, minlength=symbols)
        self.first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.last = last
        self.wavelet = WaveletMatrix(last, symbols)
        # where to stop walking back: each eighth place, and each begin of a stretch
        stop = np.zeros(len(text), bool)
        stop[::SAMPLE] = True
        stop[0] = True
        stop[1:] |= text[:-1] == 0
        stop |= text == 0
        self.stop = stop[order]
        self.sampled = np.where(self.stop, order, -1)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase (rows padded at the end)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.last), np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((lengths > k) & (low < high))
            symbol = phrases[live, k]
            low[live] = self.first[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.wavelet.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes by their rank."""
        out = np.full(len(rows), -1, np.int64)
        walk, steps, open_ = rows.copy(), 0, np.arange(len(rows))
        while len(open_):
            done = self.stop[walk]
            out[open_[done]] = self.sampled[walk[done]] + steps
            open_, walk = open_[~done], walk[~done]
            symbol = self.last[walk]
            walk = self.first[symbol] + self.wavelet.rank(symbol, walk)
            steps += 1
        return out


@dataclass(frozen=True)
class Phrases:
    """Windows of benchmark items: sorted word hashes (word k is symbol k + 1), rows of symbols, and the items of each window."""

    words: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray
    owners: list[list[str]]


def phrases(items: list[tuple[str, str]], window: int = WINDOW) -> Phrases:
    """Windows of `window` consecutive words of each (id, text); shorter items are one window."""
    found: dict[tuple[str, ...], set[str]] = {}
    for name, text in items:
        words = WORD.findall((text or "").translate(TO_LOWER))
        for k in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[k : k + window]), set()).add(name)
    vocabulary = sorted({w for p in found for w in p})
    column = pa.array(vocabulary, pa.large_string())
    data, offsets = tv.buffers(column)
    hashes = tv.span_hashes(data, offsets[:-1], offsets[1:])
    order = np.argsort(hashes)
    number = {vocabulary[o]: k + 1 for k, o in enumerate(order.tolist())}
    keys = sorted(found)
    table = np.zeros((len(keys), window), np.int64)
    for row, key in enumerate(keys):
        table[row, : len(key)] = [number[w] for w in key]
    return Phrases(hashes[order], table, np.array([len(k) for k in keys], np.int64), [sorted(found[k]) for k in keys])


def occurrences(texts: pa.Array, wanted: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, word place) of all occurrences in a shard, then its words' begins, ends and owners."""
    data, offsets = tv.buffers(texts)
    starts, ends, owner = tv.spans(tv.LOWER[data], offsets, tv.PLAIN)
    none = np.zeros(0, np.int64)
    if not len(wanted.words) or not len(starts):
        return none, none, starts, ends, owner
    hashes = tv.span_hashes(tv.LOWER[data], starts, ends)
    at = np.minimum(np.searchsorted(wanted.words, hashes), len(wanted.words) - 1)
    symbol = np.where(wanted.words[at] == hashes, at + 1, 0)
    # stretches of benchmark words in one document, as long as the shortest phrase at least
    cut = np.append(True, (symbol[1:] == 0) | (symbol[:-1] == 0) | (owner[1:] != owner[:-1]))
    begin = np.flatnonzero(cut)
    length = np.diff(np.append(begin, len(symbol)))
    good = (symbol[begin] > 0) & (length >= wanted.lengths.min())
    begin, length = begin[good], length[good]
    if not len(begin):
        return none, none, starts, ends, owner
    total = int((length + 1).sum())
    text, place = np.zeros(total, np.int64), np.zeros(total, np.int64)
    to = np.repeat(np.cumsum(length + 1) - length - 1, length) + (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
    source = np.repeat(begin, length) + (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
    text[to], place[to] = symbol[source], source
    index = FmIndex(text, len(wanted.words) + 1)
    low, high = index.search(wanted.symbols, wanted.lengths)
    count = np.maximum(high - low, 0)
    phrase = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    return phrase, place[index.locate(rows)], starts, ends, owner


def _find(texts: pa.Array, wanted: Phrases) -> tuple[list[int], list[list[list[int]]], list[list[str]]]:
    """Words, merged hit spans (word and byte bounds) and item ids of each text of a shard."""
    phrase, place, starts, ends, owner = occurrences(texts, wanted)
    offsets = tv.buffers(texts)[1]
    count = len(texts)
    first_word = np.searchsorted(owner, np.arange(count))
    spans: list[list[list[int]]] = [[] for _ in range(count)]
    items: list[list[str]] = [[] for _ in range(count)]
    if len(phrase):
        hit = np.zeros(len(starts) + 1, np.int64)
        np.add.at(hit, place, 1)
        np.subtract.at(hit, place + wanted.lengths[phrase], 1)
        inside = np.cumsum(hit[:-1]) > 0
        edge = np.append(True, (inside[1:] != inside[:-1]) | (owner[1:] != owner[:-1]))
        begin = np.flatnonzero(edge)
        end = np.append(begin[1:], len(inside))
        for b, e in zip(begin[inside[begin]].tolist(), end[inside[begin]].tolist(), strict=True):
            d = int(owner[b])
            spans[d].append([b - int(first_word[d]), e - int(first_word[d]), int(starts[b] - offsets[d]), int(ends[e - 1] - offsets[d])])
        both = np.unique(owner[place] * len(wanted.lengths) + phrase)
        for d, p in zip((both // len(wanted.lengths)).tolist(), (both % len(wanted.lengths)).tolist(), strict=True):
            items[d] += wanted.owners[p]
    return np.bincount(owner, minlength=count).tolist(), spans, [sorted(set(x)) for x in items]


def _union(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1][1], out[-1][3] = s[1], s[3]
        else:
            out.append(list(s))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[Broadcast]:
    """The phrases of the benchmark in blocks of about `limit` bytes; its size is measured before anything is collected, and the driver
    holds one block at a time: a broadcast value lies in a file."""
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = int(size // limit) + 1
    for k in range(parts):
        block = rows.where(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast(phrases([(r["name"], r["text"]) for r in block.collect()]))


def mark_benchmark(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, carry: bool = True) -> DataFrame:
    """`docs` with its own columns under `doc` (if `carry`), and of each row: doc_id, n_words, spans, items.

    spans: merged (first word, end word, first byte, end byte) bounds that lie in occurrences of 8-word windows of benchmark items
    (shorter items are one window); items: sorted distinct ids, as text, of the items whose windows occur. Null or empty texts have no
    words and no hits; benchmark rows with a null id or text are left out; repeated rows and null ids stay. A narrow map, no shuffle;
    a benchmark over `block_bytes` is searched in blocks, one map after the other.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    span = "spans array<struct<word:int,end_word:int,byte:int,end_byte:int>>, items array<string>"
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns] if carry else [F.col(id_col)]).alias("doc"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = out.withColumn("n_words", F.lit(0).cast("long"))
    blocks = list(_blocks(benchmark, item_col, item_text_col, block_bytes))
    for number, shared in enumerate(blocks):
        last = number == len(blocks) - 1
        schema = T.StructType([*out.schema.fields[:4], *T._parse_datatype_string(span).fields])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, arrow=arrow, later=number > 0, last=last) -> Iterator[pa.RecordBatch]:
            for batch, texts in text_batches(batches, "text", SHARD_BYTES):
                n, spans, items = _find(texts, shared.value)
                if later:
                    old = [[list(s.values()) for s in row] for row in batch.column(4).to_pylist()]
                    spans = [_union(a + b) for a, b in zip(old, spans, strict=True)]
                    items = [sorted({*a, *b}) for a, b in zip(batch.column(5).to_pylist(), items, strict=True)]
                named = [[dict(zip(("word", "end_word", "byte", "end_byte"), s, strict=True)) for s in row] for row in spans]
                own = [batch.column(0), batch.column(1), pa.nulls(len(texts), pa.string()) if last else batch.column(2)]  # the last pass needs no text any more
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip([*own, pa.array(n, pa.int64()), pa.array(named, arrow.field(4).type), pa.array(items, pa.list_(pa.string()))], arrow, strict=True)], schema=arrow)

        out = out.mapInArrow(releasing(run), schema)
    return out.select("doc", "doc_id", "n_words", "spans", "items")


def digest(marked: DataFrame, least: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the ids, comma-joined) and contaminated (`least` items and more)."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["word"])
    return marked.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("items") >= least).alias("contaminated"),
    )


def without_passages(texts: pa.Array, wanted: Phrases) -> dict[int, str]:
    """The texts of a shard in which phrases occur, without the spans of all occurrences; cut until none occurs, as what stood on
    either side of a span may make up another one."""
    out: dict[int, str] = {}
    rows = list(range(len(texts)))
    while rows:
        _, spans, _ = _find(texts, wanted)
        again = []
        for k, row in enumerate(rows):
            if spans[k]:
                raw, at, pieces = texts[k].as_py().encode(), 0, []
                for _, _, begin, end in spans[k]:
                    pieces.append(raw[at:begin])
                    at = end
                out[row] = b"".join([*pieces, raw[at:]]).decode()
                again.append(row)
        rows = again
        texts = pa.array([out[r] for r in rows], pa.large_string())
    return out


def remove_passages(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", item_text_col: str = "text", count_col: str = "n_chars", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with all their columns, without the passages of benchmark items: no window of an item occurs in a text any more.

    `count_col`, where there is one, is counted anew (code points) in rows that were cut. Null and empty texts, null ids and repeated rows
    stay as they are; an empty benchmark cuts nothing. A narrow map for each block of the benchmark; several blocks are gone through again
    until none cuts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(docs.schema)
    at, counted = docs.columns.index(text_col), docs.columns.index(count_col) if count_col in docs.columns else None
    blocks = list(_blocks(benchmark, item_col, item_text_col, block_bytes))

    def cut(df: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in text_batches(batches, text_col, SHARD_BYTES):
                changed = without_passages(texts, shared.value)
                columns = list(batch.columns)
                if changed:
                    rows = pa.array([k in changed for k in range(len(batch))])
                    fresh = [changed[k] for k in sorted(changed)]
                    columns[at] = pc.replace_with_mask(columns[at], rows, pa.array(fresh, columns[at].type))
                    if counted is not None:
                        columns[counted] = pc.replace_with_mask(columns[counted], rows, pa.array([len(t) for t in fresh]).cast(columns[counted].type))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        return df.mapInArrow(releasing(run), docs.schema)

    if len(blocks) == 1:
        return cut(docs, blocks[0])
    total = F.sum(F.octet_length(text_col))
    before = docs.agg(total).first()[0]
    while True:
        for block in blocks:
            docs = cut(docs, block)
        docs = durable(docs)
        now = docs.agg(total).first()[0]
        if now == before:
            return docs
        before = now
