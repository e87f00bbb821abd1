"""Tokens and hashes of many texts at once, as numpy operations on the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(0x5EED))
_TABLE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_ODD = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}

#: Bytes of the two word classes; bytes of 0x80 and over are in both, so UTF-8 bytes may stand for code points.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
PLAIN = np.zeros(256, bool)
PLAIN[0x30:0x3A] = PLAIN[0x61:0x7B] = PLAIN[0x80:] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a null-free large_string array, and where each text begins (one more at the end)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, U64)
            step[0] = 1
            _powers[key] = np.cumprod(step, dtype=U64)
    return _powers["up"], _powers["down"]


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes in the class `member` that don't cross texts: starts, ends, and the text of each."""
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    counts = np.searchsorted(starts, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(counts))
    return starts, ends, owner


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, alike in every process and on every machine."""
    n = len(data)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_TABLE[data] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * _ODD[63])


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all `n` consecutive entries, across texts too; callers mask those."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    total = np.zeros(m, U64)
    for k in range(n):
        total += hashes[k : k + m] * _ODD[k]
    return mix(total)


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands elsewhere in `keys`."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    flag = np.zeros(len(keys), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag


def covered(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each word, whether it lies in a window of `n` words found twice or more in its text."""
    keys = windows(hashes, n)
    out = np.zeros(len(hashes), bool)
    valid = np.flatnonzero(owner[: len(keys)] == owner[n - 1 :][: len(keys)])
    if not len(valid):
        return out
    hit = np.zeros(len(hashes) + 1, np.int32)
    begins = valid[repeated(keys[valid] ^ mix(owner[valid].astype(U64) + _ODD[62]))]
    np.add.at(hit, begins, 1)
    np.subtract.at(hit, begins + n, 1)
    return np.cumsum(hit[:-1]) > 0


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines split at each newline: starts, ends, and the text of each; an empty last line may be left out."""
    n = len(data)
    starts = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(data == 10) + 1)))
    starts = starts[starts < n]
    ends = np.append(starts[1:], n)[: len(starts)]
    ends = ends - (data[ends - 1] == 10) if len(starts) else ends
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def per_text(owner: np.ndarray, count: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights, count).astype(np.int64)


def count_bytes(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Bytes of the class `member` in each text."""
    sums = np.concatenate(([0], np.cumsum(member[data], dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]
