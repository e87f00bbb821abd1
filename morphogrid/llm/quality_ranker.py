"""Quality classifier: a Bradley-Terry ranking of documents from preference pairs.

A labelled good document is preferred to a labelled bad one; the logistic loss on the difference of their features gives one
weight for each feature, and the weighted sum is a document's strength. The cut between good and bad is the quantile of the
training strengths that best separates the labels, and the reported score is 0.7 exactly at that cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import filter_texts, held_out, map_texts
from .repetition_rules import FIRST_BYTE, SYMBOLS

CUT = 0.7


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


UPPER, LETTERS, DIGITS, BARS, SHOUTS, STOPS = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class("|"), _class("!?"), _class(".,;:")
FEATURES = ("log_words", "symbols", "bars", "shouts", "upper", "digits", "stops", "word_length", "repeat_1", "repeat_2", "repeat_3", "stutter", "repeat_line", "line_words")


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    data, offsets = tv.buffers(texts)
    count = len(texts)
    starts, ends, owner = tv.spans(data, offsets, tv.SPACED)
    hashes = tv.span_hashes(tv.LOWER[data], starts, ends)
    n = tv.per_text(owner, count)
    words, size = np.maximum(n, 1), np.maximum(np.diff(offsets), 1)
    chars = np.concatenate(([0], np.cumsum(FIRST_BYTE[data], dtype=np.int64)))
    per = lambda member: tv.count_bytes(data, offsets, member) / words
    stutter = np.zeros(len(hashes), bool)
    stutter[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    begin, end, of = tv.lines(data, offsets)
    key = tv.span_hashes(data, begin, end) ^ tv.mix(of.astype(tv.U64))
    line_bytes = tv.per_text(of, count, (end - begin) * tv.repeated(key))
    return np.column_stack([
        np.log1p(n), np.log1p(per(SYMBOLS)), np.log1p(per(BARS)), np.log1p(per(SHOUTS)), tv.count_bytes(data, offsets, UPPER) / np.maximum(tv.count_bytes(data, offsets, LETTERS), 1),
        tv.count_bytes(data, offsets, DIGITS) / size, np.log1p(per(STOPS)), np.minimum((chars[offsets[1:]] - chars[offsets[:-1]]) / words, 30),
        *(tv.per_text(owner, count, tv.covered(hashes, owner, k)) / words for k in (1, 2, 3)), tv.per_text(owner, count, stutter) / words, line_bytes / size, np.log1p(n / np.maximum(tv.per_text(of, count), 1)),
    ])


@dataclass(frozen=True)
class Ranking:
    """Means and scales of the raw features, the weights of the expanded ones, and the strength at the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def expand(self, raw: np.ndarray) -> np.ndarray:
        z = np.clip((raw - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z / 6])

    def score(self, raw: np.ndarray) -> np.ndarray:
        strength = self.expand(raw) @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(strength + np.log(CUT / (1 - CUT)), -30, 30)))


def fit(raw: np.ndarray, good: np.ndarray, pairs: int = 60_000, ridge: float = 1e-3, rounds: int = 25, seed: int = 7) -> Ranking:
    """Bradley-Terry weights by Newton's method over `pairs` drawn pairs; without both labels every text scores at the cut."""
    width = len(FEATURES)
    if not len(raw) or good.all() or not good.any():
        return Ranking(np.zeros(width), np.ones(width), np.zeros(2 * width), 0.0)
    scale = raw.std(0)
    empty = Ranking(raw.mean(0), np.where(scale > 1e-9, scale, 1.0), np.zeros(2 * width), 0.0)
    x = empty.expand(raw)
    rng = np.random.default_rng(seed)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    d = x[rng.choice(better, pairs)] - x[rng.choice(worse, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance that the pair is misjudged
        grad = d.T @ p / pairs - ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, grad)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    strength = x @ w
    order = np.sort(strength)
    quantiles = order[(np.linspace(0.005, 0.995, 199) * (len(order) - 1)).astype(int)]
    balanced = [(good & (strength >= q)).sum() / good.sum() + (~good & (strength < q)).sum() / (~good).sum() for q in quantiles]
    best = np.flatnonzero(np.isclose(balanced, np.max(balanced)))
    return Ranking(empty.mean, empty.scale, w, float(quantiles[best[len(best) // 2]]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = 20_000) -> Ranking:
    """Fit on at most `max_labels` labelled rows outside the held-out fold, those first by a hash of the id.

    Rows with a null id or label teach nothing. Only the features of at most `max_labels` rows reach the driver, never texts, also where
    one id is repeated.
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labels)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "doc_id")
    named = rows.withColumn("doc_id", F.struct("doc_id", "label"))
    table = map_texts(named, lambda t: {"f": pa.FixedSizeListArray.from_arrays(features(t).ravel(), len(FEATURES)).cast(pa.list_(pa.float64()))}, "f array<double>").selectExpr("doc_id.doc_id", "doc_id.label", "f")
    table = table.orderBy("doc_id", "label", "f").limit(max_labels).toPandas()
    raw = np.vstack(table["f"].to_list()) if len(table) else np.zeros((0, len(FEATURES)))
    return fit(raw, table["label"].to_numpy() == 1)


def quality_scores(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, score, predicted (1 from a score of 0.7 on).

    Null and empty texts have zero features and are scored as any other; null ids count as not held out; repeated rows stay.
    """

    def kernel(texts: pa.Array) -> dict:
        score = model.score(features(texts))
        return {"score": score, "predicted": (score >= CUT).astype(np.int32)}

    scored = map_texts(docs, kernel, "score double, predicted int", id_col, text_col)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def kept_rows(docs: DataFrame, model: Ranking, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose texts score 0.7 or more, with all their columns; each row is judged by itself."""
    return filter_texts(docs, lambda texts: model.score(features(texts)) >= CUT, text_col)
