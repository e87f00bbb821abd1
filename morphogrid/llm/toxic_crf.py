"""Toxicity: a linear-chain conditional random field over words.

Words of labelled documents get token labels first: those that stand in many toxic documents, in many different contexts, and hardly
in clean ones, by themselves or by their beginnings (inflected and compounded words). The chain (two states, weights of words and of word beginnings, start and transition weights) is then trained on those tokens, and
forward-backward marginals give each word's chance to be toxic. A document's score is logistic in the sum, the maximum
and the density of its marginals; words of one half and more are its offending spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import held_out, map_texts, text_batches
from .repetition_rules import FIRST_BYTE

CUT = 0.3
BLOCK = 256
#: Byte lengths of the word beginnings that are features beside the whole word.
PREFIXES = (4, 5, 6, 7, 8)


def _scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Ratios r[t] = (c[t] + d[t] r[t-1]) / (a[t] + b[t] r[t-1]), r[-1] = 0, in blocks that run side by side."""
    n = len(a)
    rows = -(-n // BLOCK)
    pad = rows * BLOCK - n
    A, B, C, D = (np.concatenate((x, np.full(pad, fill))).reshape(rows, BLOCK).T for x, fill in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)))
    p, q, r, s = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for k in range(BLOCK):  # each block's product of matrices
        p, q, r, s = A[k] * p + B[k] * r, A[k] * q + B[k] * s, C[k] * p + D[k] * r, C[k] * q + D[k] * s
        if k % 8 == 7:
            scale = 1 / (p + q + r + s)
            p, q, r, s = p * scale, q * scale, r * scale, s * scale
    first, ratio = np.empty(rows), 0.0
    for i, (pi, qi, ri, si) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        first[i] = ratio
        ratio = (ri + si * ratio) / (pi + qi * ratio)
    out = np.empty((BLOCK, rows))
    for k in range(BLOCK):
        first = (C[k] + D[k] * first) / (A[k] + B[k] * first)
        out[k] = first
    return out.T.reshape(-1)[:n]


def chain(emission: np.ndarray, owner: np.ndarray, start: float, t01: float, t10: float, t11: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward ratios of state 1 to state 0, and the marginal of state 1, for words of many texts in a row."""
    x = np.exp(np.clip(emission, -30, 30))
    n = len(x)
    head, tail = np.ones(n, bool), np.ones(n, bool)
    head[1:] = owner[1:] != owner[:-1]
    tail[:-1] = head[1:]
    e01, e10, e11, s = np.exp(t01), np.exp(t10), np.exp(t11), np.exp(start)
    one = np.ones(n)
    forward = _scan(one, np.where(head, 0.0, e10), np.where(head, x * s, x * e01), np.where(head, 0.0, x * e11))
    after = np.append(x[1:], 1.0)
    backward = _scan(one[::-1], np.where(tail, 0.0, e01 * after)[::-1], np.where(tail, 1.0, e10)[::-1], np.where(tail, 0.0, e11 * after)[::-1])[::-1]
    both = forward * backward
    return forward, backward, both / (1 + both)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts, ends, owners and hashes; A-Z in lower case."""
    data, offsets = tv.buffers(texts)
    data = tv.LOWER[data]
    starts, ends, owner = tv.spans(data, offsets, tv.PLAIN)
    return data, starts, ends, owner, tv.span_hashes(data, starts, ends)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each word the hashes of its features: the word, and its beginnings; 0 where a word is shorter."""
    out = [hashes]
    for k in PREFIXES:
        long = ends - starts >= k
        part = np.zeros(len(hashes), tv.U64)
        part[long] = tv.mix(tv.span_hashes(data, starts[long], starts[long] + k) + tv.U64(k))
        out.append(part)
    return np.column_stack(out)


@dataclass(frozen=True)
class Tagger:
    """Sorted hashes of the features that count, their weights, the weight of every word, and the chain's four weights."""

    known: np.ndarray
    weights: np.ndarray
    bias: float
    start: float
    t01: float
    t10: float
    t11: float
    calibration: tuple[float, ...] = ()

    def marginals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes) or not len(self.known):
            return np.zeros(len(hashes))
        _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        parts = word_features(data, starts[first], ends[first], hashes[first])
        at = np.minimum(np.searchsorted(self.known, parts), len(self.known) - 1)
        weight = self.bias + np.where(self.known[at] == parts, self.weights[at], 0.0).sum(1)
        return chain(weight[back], owner, self.start, self.t01, self.t10, self.t11)[2]

    def documents(self, p: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
        """Chance that each of `count` texts is toxic, from its words' marginals."""
        x = np.column_stack([np.ones(count), evidence(p, owner, count)])
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.calibration), -30, 30))) if self.calibration else np.zeros(count)


def evidence(p: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Of each text: summed and largest surprise that a word would be clean, and the density of toxic words."""
    surprise = -np.log1p(-np.minimum(p, 1 - 1e-6))
    surprise[p < 0.05] = 0.0
    most = np.zeros(count)
    np.maximum.at(most, owner, surprise)
    words = np.maximum(np.bincount(owner, minlength=count), 1)
    return np.column_stack([np.log1p(np.bincount(owner, surprise, count)), np.log1p(most), np.log1p(1000 * np.bincount(owner, p * (p >= 0.05), count) / words)])


def calibrated(x: np.ndarray, toxic: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic weights of documents' evidence, the constant first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (toxic - q) - ridge * w)
    return tuple(map(float, w))


def marking(doc: np.ndarray, kind: np.ndarray, context: np.ndarray, toxic: np.ndarray, count: int, least: int, least_share: float, odds: float) -> np.ndarray:
    """Numbers of the features that mark toxic documents: found in many of them, in many different contexts, and seldom in clean ones.

    Contexts (the words on either side) count because near copies of one toxic text repeat all its words, but in one context.
    """
    bad, good = int(toxic.sum()), int((~toxic).sum())
    pairs = np.unique(doc.astype(np.int64) * count + kind)
    held, each = pairs // count, pairs % count
    clean = np.bincount(each[~toxic[held]], minlength=count)
    found = np.bincount(each[toxic[held]], minlength=count)
    at = np.flatnonzero(toxic[doc])
    order = np.lexsort((context[at], kind[at]))
    new = np.append(True, (np.diff(context[at][order]) != 0) | (np.diff(kind[at][order]) != 0))[: len(order)]
    found = np.minimum(found, np.bincount(kind[at][order][new], minlength=count))
    rate = (found + 0.5) / (bad + 1) / ((clean + 0.5) / (good + 1))
    return np.flatnonzero((rate >= odds) & (found >= max(least, least_share * bad)))


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 50, rate: float = 0.3, l2: float = 0.3, least: int = 4, least_share: float = 0.005, odds: float = 12.0, base_odds: float | None = None) -> Tagger:
    """Train the chain on whole texts with document labels; without a feature that tells them apart, every marginal is 0.

    `base_odds`: toxic to clean documents in the population, if `texts` were drawn at other odds.
    """
    parts, base = [], 0
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    for piece, column in text_batches([batch], "text"):
        data, starts, ends, owner, hashes = tokens(column)
        uniques, first = np.unique(hashes, return_index=True)
        parts.append((owner + base, hashes, uniques, word_features(data, starts[first], ends[first], uniques)))
        base += len(piece)
    none = Tagger(np.zeros(0, tv.U64), np.zeros(0), -8.0, 0.0, 0.0, 0.0, 0.0)
    if not parts or toxic.all() or not toxic.any():
        return none
    owner, hashes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    vocabulary, word = np.unique(hashes, return_inverse=True)
    if not len(vocabulary):
        return none
    listed, first = np.unique(np.concatenate([p[2] for p in parts]), return_index=True)
    rows = np.vstack([p[3] for p in parts])[first]  # by word number, as `listed` equals `vocabulary`
    known, columns = np.unique(rows, return_inverse=True)
    columns = columns.reshape(rows.shape)
    real = known != 0
    joined = np.zeros(len(word), bool)
    joined[:-1] = owner[1:] == owner[:-1]
    left = np.append(0, np.where(joined[:-1], word[:-1] + 1, 0))
    right = np.append(np.where(joined[:-1], word[1:] + 1, 0), 0)
    context = tv.mix(left.astype(tv.U64) * tv.U64(0x9E3779B97F4A7C15) + right.astype(tv.U64))
    marked = np.zeros(len(known), bool)
    for j in range(rows.shape[1]):
        kind = columns[:, j][word]
        held = real[kind]
        marked[marking(owner[held], kind[held], context[held], toxic, len(known), least, least_share, odds)] = True
    if not marked.any():
        return none
    y = (marked[columns].any(1)[word] & toxic[owner]).astype(float)
    a, b = np.flatnonzero(joined), np.flatnonzero(joined) + 1
    heads = np.flatnonzero(np.append(True, ~joined[:-1]))
    w = np.zeros(len(known) + 5)  # features, then bias, start, t01, t10, t11
    w[-5] = -4.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    seen = np.array([(y[a] * (1 - y[b])).sum(), ((1 - y[a]) * y[b]).sum(), (y[a] * y[b]).sum()])
    for step in range(1, rounds + 1):
        emission = (w[:-5][columns] * real[columns]).sum(1)[word] + w[-5]
        forward, backward, p = chain(emission, owner, w[-4], w[-3], w[-2], w[-1])
        by_word = np.bincount(word, p - y, len(vocabulary))
        grad = np.zeros_like(w)
        grad[:-5] = (np.bincount(columns.ravel(), np.repeat(by_word, columns.shape[1]), len(known)) + l2 * w[:-5]) * real
        grad[-5] = by_word.sum()
        grad[-4] = (p[heads] - y[heads]).sum()
        follow = np.exp(np.clip(emission[b], -30, 30)) * backward[b]
        x01, x10, x11 = np.exp(w[-3]) * follow, forward[a] * np.exp(w[-2]), forward[a] * np.exp(w[-1]) * follow
        total = 1 + x01 + x10 + x11
        grad[-3], grad[-2], grad[-1] = (x01 / total).sum() - seen[1], (x10 / total).sum() - seen[0], (x11 / total).sum() - seen[2]
        grad[-4:] += l2 * w[-4:]
        m, v = 0.8 * m + 0.2 * grad, 0.95 * v + 0.05 * grad * grad
        w -= rate * (m / (1 - 0.8**step)) / (np.sqrt(v / (1 - 0.95**step)) + 1e-8)
    keep = (np.abs(w[:-5]) > 0.02) & real
    emission = (w[:-5][columns] * real[columns]).sum(1)[word] + w[-5]
    p = chain(emission, owner, *w[-4:])[2]
    constant, *slopes = calibrated(evidence(p, owner, len(texts)), toxic)
    if base_odds:
        constant += float(np.log(base_odds * (~toxic).sum() / toxic.sum()))
    return Tagger(known[keep], w[:-5][keep], *map(float, w[-5:]), (constant, *slopes))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labels: int = 1_600) -> Tagger:
    """Fit on the whole texts of at most `max_labels` labelled rows outside the held-out fold, half of each label.

    Equal texts teach once. Rows with a null id or label teach nothing.
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & ~held_out())
    half = [marks.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels // 2) for k in (0, 1)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(half[0].union(half[1])), "doc_id")
    table = rows.dropDuplicates(["text"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).toPandas()
    counts = {r["label"]: r["count"] for r in marks.where(F.col("label").isin(0, 1)).groupBy("label").count().collect()}
    return fit(table["text"].to_list(), table["label"].to_numpy() == 1, base_odds=counts.get(1, 0) / max(counts.get(0, 0), 1))


def toxicity(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, score, predicted (1 from a score of 0.3 on), and the offending spans.

    Spans are (begin, end) in code points. Null and empty texts have no spans and the score of no evidence, as any text without a toxic
    word has; null ids count as not held out; repeated rows
    stay.
    """

    def kernel(texts: pa.Array) -> dict:
        data, starts, ends, owner, hashes = tokens(texts)
        offsets = tv.buffers(texts)[1]
        p = model.marginals(data, starts, ends, owner, hashes)
        score = model.documents(p, owner, len(texts))
        bad = np.flatnonzero(p >= 0.5)
        chars = np.concatenate(([0], np.cumsum(FIRST_BYTE[data], dtype=np.int64)))
        base = chars[offsets[owner[bad]]]
        pairs = pa.StructArray.from_arrays([pa.array((chars[starts[bad]] - base).astype(np.int32)), pa.array((chars[ends[bad]] - base).astype(np.int32))], ["begin", "end"])
        ends_at = np.concatenate(([0], np.cumsum(np.bincount(owner[bad], minlength=len(texts))))).astype(np.int32)
        return {"score": score, "predicted": (score >= CUT).astype(np.int32), "spans": pa.ListArray.from_arrays(pa.array(ends_at), pairs)}

    scored = map_texts(docs, kernel, "score double, predicted int, spans array<struct<begin:int,end:int>>", id_col, text_col)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "spans")
