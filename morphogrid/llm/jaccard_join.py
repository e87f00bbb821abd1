"""N-gram Jaccard self-join: size-banded tiles, hashed bitmap signatures, exact intersections.

A document's set of word shingles (64-bit hashes) is one node of the link graph, whatever documents have that set; its 128-bit digest
names it, so ids may be of any type, repeat or be null. Two sets that meet the threshold share one of the first shingles of either in
any common order, so each set enters the tiles of those only; shingles found often come last in the order, so that common passages
make few and small tiles. A tile is the sets of one shingle in one band of sizes: sorted by size, a band ends where the next set that
could be the smaller of a linked pair is too large for the last one. The places of the shared shingle in both sets bound their overlap, as
it is the first that they share in one of their tiles. Bitmaps hold the parity of the members of each bit; bits that differ bound the
overlap from above, before sorted arrays are intersected exactly.

Links are found in four passes, so that a group of many near copies gives about as many pairs as it has sets and no link is lost. First
each set is held against one neighbour and one pivot of its tile, which settles tiles of up to three sets. The links found give
components; sets of tiles with several components are held against the tile's hub, the linked set whose first shingles are shared most,
as copies are often near their original but not near one another. The tiles of a hub then form one group, in which sets of other
components than the hub's meet all sets of different components, each pair once: at first only the nearest partner by bitmaps is
followed up, and when those links are known every pair that is still of different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import discard, durable, releasing, text_batches
from .components import components

#: Counters of the shingle sketch: a fixed size, whatever the data.
SKETCH = 1 << 22
#: Bits of the filter of asked texts: sixteen for each, and at most so many (16 MB).
FILTER_BITS = 1 << 27
#: Largest set size and 64-bit words of each bitmap length; longer ones fold onto shorter.
BITMAP_WORDS = ((16, 1), (100, 4), (1_000, 16), (4_000, 64), (1 << 62, 256))
#: Sets of one role in one comparison cell of a hub's group; larger groups are compared block by block.
CELL = 8_192
#: Pairs that a cell looks at in one step.
STEP = 400_000


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted: (hashes, owners, set sizes). Under `k` words the whole sequence is one shingle."""
    data, offsets = tv.buffers(texts)
    data = tv.LOWER[data]
    count = len(texts)
    starts, ends, owner = tv.spans(data, offsets, tv.SPACED)
    hashes = tv.span_hashes(data, starts, ends)
    keys = tv.windows(hashes, k)
    valid = np.flatnonzero(owner[: len(keys)] == owner[k - 1 :][: len(keys)])
    words = np.bincount(owner, minlength=count)
    short = np.flatnonzero((words > 0) & (words < k))
    first = np.searchsorted(owner, short)
    whole = np.zeros(len(short), tv.U64)
    for j in range(k - 1):
        there = words[short] > j
        whole[there] += hashes[first[there] + j] * tv._ODD[j]
    key = np.concatenate((keys[valid], tv.mix(whole + words[short].astype(tv.U64) * tv._ODD[61])))
    own = np.concatenate((owner[valid], short))
    order = np.argsort(key)
    order = order[np.argsort(own[order], kind="stable")]
    key, own = key[order], own[order]
    new = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))[: len(key)]
    return key[new], own[new], np.bincount(own[new], minlength=count)


def digests(key: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set, as two longs; sums of mixed hashes."""
    ends = np.cumsum(size)
    out = []
    for salt in (tv._ODD[50], tv._ODD[51]):
        sums = np.concatenate((np.zeros(1, tv.U64), np.cumsum(tv.mix(key ^ salt), dtype=tv.U64)))
        out.append((sums[ends] - sums[ends - size]).view(np.int64))
    return out[0], out[1]


def _least_overlap(size: np.ndarray, percent: int) -> np.ndarray:
    return (percent * size + 99) // 100


def _class(size: np.ndarray) -> np.ndarray:
    """Number of the bitmap length for each set size."""
    return np.searchsorted([most for most, _ in BITMAP_WORDS], size)


def _words(size: np.ndarray) -> np.ndarray:
    return np.array([words for _, words in BITMAP_WORDS])[_class(size)]


def bitmaps(key: np.ndarray, size: np.ndarray) -> pa.Array:
    """A bitmap for each set: each bit is the parity of the members that hash to it."""
    words = _words(size)
    base = np.concatenate((np.zeros(1, np.int64), np.cumsum(words * 64)))
    flags = np.zeros(base[-1], np.uint8)
    own = np.repeat(np.arange(len(size)), size)
    np.add.at(flags, base[own] + (key >> tv.U64(40)).astype(np.int64) % (words * 64)[own], 1)
    packed = np.packbits(flags & 1)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(base // 8), pa.py_buffer(packed)]).cast(pa.binary())


class Bitmaps:
    """Bitmaps of many sets, by length; bounds the overlap of pairs from above."""

    def __init__(self, column: list[bytes], size: np.ndarray):
        self.size, self.kind = size, _class(size)
        self.at = np.zeros(len(size), np.int64)
        self.rows = []
        for number, (_, words) in enumerate(BITMAP_WORDS):
            own = np.flatnonzero(self.kind == number)
            self.at[own] = np.arange(len(own))
            self.rows.append(np.frombuffer(b"".join([column[i] for i in own]), np.uint64).reshape(-1, words))

    def _of(self, index: np.ndarray, number: int, words: int) -> np.ndarray:
        got = self.rows[number][self.at[index]]
        return np.bitwise_xor.reduce(got.reshape(len(got), -1, words), axis=1)

    def possible(self, percent: int, i: np.ndarray, other: Bitmaps, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether pairs (i here, j in `other`) may meet the threshold, and the least share of members of one set only: a bit that
        differs stands for such a member."""
        out, least = np.zeros(len(i), bool), np.zeros(len(i))
        for a in range(len(BITMAP_WORDS)):
            for b in range(len(BITMAP_WORDS)):
                at = np.flatnonzero((self.kind[i] == a) & (other.kind[j] == b))
                words = min(BITMAP_WORDS[a][1], BITMAP_WORDS[b][1])
                for part in np.array_split(at, -(-len(at) * words // (1 << 20)) or 1) if len(at) else []:
                    x, y = self._of(i[part], a, words), other._of(j[part], b, words)
                    n, m = self.size[i[part]], other.size[j[part]]
                    apart = np.maximum(np.bitwise_count(x ^ y).sum(1, dtype=np.int64), abs(n - m))
                    most = (n + m - apart) // 2
                    out[part], least[part] = 100 * most >= percent * (n + m - most), apart / (n + m)
        return out, least


def _survey(docs: DataFrame, k: int) -> DataFrame:
    """One row a document (doc_id, n, d1, d2, t: hash of the text), with a bitmap where the set is new in its task, and rows (bucket,
    load) of sketch counters that are heavy in a task."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type, id_arrow = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["doc_id", "n", "d1", "d2", "t", "bitmap", "bucket", "load"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, total, seen = np.zeros(SKETCH, np.int32), 0, Seen()
        for batch, texts in text_batches(batches, "text"):
            key, _, size = shingle_sets(texts, k)
            d1, d2 = digests(key, size)
            np.add.at(sketch, (key & tv.U64(SKETCH - 1)).astype(np.int64), 1)
            total += len(key)
            none = pa.nulls(len(size), pa.int64())
            fresh = seen.fresh(d1, d2, size)
            own = np.repeat(fresh, size)
            maps = bitmaps(key[own], np.where(fresh, size, 0))
            maps = pc.if_else(pa.array(fresh), maps, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(d1), pa.array(d2), batch.column(2), maps, none, none], names)
        mean = total / SKETCH
        heavy = np.flatnonzero(sketch > mean + 4 * np.sqrt(mean) + 3)
        none = pa.nulls(len(heavy), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(heavy), id_arrow), none, none, none, none, pa.nulls(len(heavy), pa.binary()), pa.array(heavy), pa.array(sketch[heavy].astype(np.int64))], names)

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    return hashed.mapInArrow(releasing(run), f"doc_id {id_type}, n long, d1 long, d2 long, t long, bitmap binary, bucket long, load long")


class Seen:
    """The digests that a task has met."""

    def __init__(self):
        self.names: set[tuple[int, int]] = set()

    def fresh(self, d1: np.ndarray, d2: np.ndarray, size: np.ndarray) -> np.ndarray:
        """True for the first of each set that isn't empty."""
        out = np.zeros(len(size), bool)
        for i in np.flatnonzero(size).tolist():
            name = int(d1[i]), int(d2[i])
            if name not in self.names:
                self.names.add(name)
                out[i] = True
        return out


def _prefixes(docs: DataFrame, k: int, percent: int, hot: np.ndarray) -> DataFrame:
    """(key, at, d) for the first shingles of each distinct set of a task; at: set size and place, d: the first half of the digest."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = np.zeros(SKETCH, bool), Seen()
        often[shared.value] = True
        for _, texts in text_batches(batches, "text"):
            key, owner, size = shingle_sets(texts, k)
            d1, d2 = digests(key, size)
            fresh = seen.fresh(d1, d2, size)
            own = fresh[owner]
            key, owner = key[own], owner[own]
            size = np.where(fresh, size, 0)
            order = np.lexsort((often[(key & tv.U64(SKETCH - 1)).astype(np.int64)], owner))  # stable: by hash inside
            key = key[order]
            place = np.arange(len(key)) - (np.cumsum(size) - size)[owner]
            take = place < (size - _least_overlap(size, percent) + 1)[owner]
            of = owner[take]
            at = (size[of].astype(np.int64) << 32) | place[take]
            yield pa.RecordBatch.from_arrays([pa.array(key[take].view(np.int64)), pa.array(at), pa.array(d1[of])], ["key", "at", "d"])

    return docs.mapInArrow(releasing(run), "key long, at long, d long")


def _fits(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of `n` and `m` members whose first common shingle stands at places `i` and `j` may meet the threshold."""
    need = (percent * (n + m) + 99 + percent) // (100 + percent)
    return np.minimum(n - i, m - j) >= need


class TileScan:
    """Cuts a sorted stream of (key, at, d) rows into tiles; keeps a few rows of the open tile, never the tile."""

    AHEAD = 4  # rows held back, so that it is known of each row whether its tile has four sets or more

    def __init__(self, percent: int):
        self.percent = percent
        self.context, self.held, self.count = np.zeros((0, 3), np.int64), np.zeros((0, 3), np.int64), 0

    def push(self, rows: np.ndarray | None) -> pa.RecordBatch | None:
        last = rows is None
        fresh = self.held if last else np.vstack([self.held, rows])
        fresh = fresh[np.append(True, (np.diff(fresh, axis=0) != 0).any(1))[: len(fresh)]]
        upto = len(fresh) if last else max(0, len(fresh) - self.AHEAD)
        self.held = fresh[upto:]
        if not upto:
            return None
        lead = len(self.context)
        rows, upto = np.vstack([self.context, fresh]), upto + lead
        key, n, place, d = rows[:, 0], rows[:, 1] >> 32, rows[:, 1] & 0xFFFFFFFF, rows[:, 2]
        number = np.arange(len(rows))
        # only sets whose place leaves enough for an equally large partner can be the smaller one of a pair
        index = _fits(n, place, n, place, self.percent)
        latest = np.maximum.accumulate(np.where(index, number, -1))
        before = np.append(-1, latest[:-1])
        has = (before >= 0) & (key[before] == key) & (100 * n[before] >= self.percent * n)
        if lead == 2:
            has[1] = True  # of the same tile, by rows that are gone
        start = index & ~has
        tile = np.cumsum(start) - 1
        pivot = np.maximum.accumulate(np.where(start, number, 0))
        live = has | (index & np.append(has[1:] & (before[1:] == number[:-1]), False))
        mine = live & (number >= lead)
        sizes = np.bincount(tile[mine], minlength=int(tile[-1]) + 1 if len(tile) else 1)
        if lead:
            sizes[0] += self.count
        keep = np.flatnonzero(mine & (number < upto))
        near = has & _fits(n[before], place[before], n, place, self.percent)
        far = has & (pivot != before) & (100 * n[pivot] >= self.percent * n) & _fits(n[pivot], place[pivot], n, place, self.percent)
        name = tv.mix(key.view(tv.U64) ^ (n[pivot].astype(tv.U64) * tv._ODD[52])).view(np.int64)
        out = pa.RecordBatch.from_arrays(
            [pa.array(name[keep]), pa.array(n[keep].astype(np.int32)), pa.array(d[keep]), pa.array(d[before][keep], mask=~near[keep]), pa.array(d[pivot][keep], mask=~far[keep]), pa.array(sizes[tile[keep]] > 3)],
            ["tile", "n", "d", "u", "v", "wide"],
        )
        ahead = latest[upto - 1]
        if ahead >= 0:
            own = int(((tile == tile[ahead]) & mine & (number < upto)).sum())
            self.count = own + (self.count if lead and tile[ahead] == 0 else 0)
            self.context = rows[[pivot[ahead], ahead]] if pivot[ahead] != ahead else rows[[ahead]]
        else:
            self.context, self.count = rows[:0], 0
        return out


def _tiles(prefixes: DataFrame, percent: int) -> DataFrame:
    """Members of tiles of two sets at least (tile, n, d), with the nearest smaller set (u) and the pivot (v) that each may link with,
    and whether the tile has four sets or more (wide). A set of half a digest stands for all sets that share the half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = TileScan(percent)
        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            if (out := scan.push(rows)) is not None and len(out):
                yield out
        if (out := scan.push(None)) is not None and len(out):
            yield out

    ordered = prefixes.repartition("key").sortWithinPartitions("key", "at", "d")
    return ordered.mapInArrow(releasing(run), "tile long, n int, d long, u long, v long, wide boolean")


class TextFilter:
    """A bit map of hashes; too many hashes for its greatest length only make it pass more."""

    def __init__(self, hashes: DataFrame):
        self.bits = 1 << min(max(16 * hashes.count(), 1 << 16).bit_length(), FILTER_BITS.bit_length() - 1)
        place = hashes.select(F.col("t").bitwiseAND(self.bits - 1).alias("x"))
        words = place.groupBy(F.shiftright("x", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(x & 63 as int))) as bits")).toPandas()
        self.words = np.zeros(self.bits // 64, np.int64)
        self.words[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)

    def __call__(self, t: np.ndarray) -> np.ndarray:
        x = t & (self.bits - 1)
        return ((self.words[x >> 6] >> (x & 63)) & 1).astype(bool)


def _members(docs: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """(d1, d2, members) for each set in `names` (d1, d2, t): its sorted hashes, 64 bits each. A filter of text hashes spares most
    other documents the cutting into shingles and the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(TextFilter(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        asked = (b.filter(pa.array(shared.value(b.column(1).to_numpy()))) for b in batches)
        for _, texts in text_batches(asked, "text"):
            key, _, size = shingle_sets(texts, k)
            d1, d2 = digests(key, size)
            at, ends = np.flatnonzero(seen.fresh(d1, d2, size)), np.cumsum(size)
            members = pa.array([key[ends[i] - size[i] : ends[i]].tobytes() for i in at.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(d1[at]), pa.array(d2[at]), members], ["d1", "d2", "members"])

    found = docs.select("text", F.xxhash64("text").alias("t")).mapInArrow(releasing(run), "d1 long, d2 long, members binary")
    return found.join(names.select("d1", "d2"), ["d1", "d2"], "left_semi").dropDuplicates(["d1", "d2"])


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y: half digests) as (a1, a2, b1, b2) that sizes and bitmaps don't rule out."""
    left = nodes.select(F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("n").alias("na"), F.col("bitmap").alias("p"))
    right = nodes.select(F.col("d1").alias("b1"), F.col("d2").alias("b2"), F.col("n").alias("nb"), F.col("bitmap").alias("q"))
    both = pairs.join(left, pairs["x"] == left["a1"]).join(right, F.col("y") == right["b1"]).where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (Bitmaps(batch.column(c).to_pylist(), batch.column(c + 1).to_numpy().astype(np.int64)) for c in (4, 6))
            every = np.arange(len(batch))
            may, _ = p.possible(percent, every, q, every)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(4)], ["a1", "a2", "b1", "b2"]).filter(pa.array(may))

    return both.select("a1", "a2", "b1", "b2", "p", "na", "q", "nb").mapInArrow(releasing(run), "a1 long, a2 long, b1 long, b2 long")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b: structs of d1 and d2) among the pairs (a1, a2, b1, b2), by exact intersections of sorted arrays."""
    pairs = durable(pairs)
    names = durable(pairs.select(F.col("a1").alias("d1"), F.col("a2").alias("d2")).union(pairs.select("b1", "b2")).distinct().join(nodes.select("d1", "d2", "t"), ["d1", "d2"]))
    sets = durable(_members(docs, names, k))
    left = sets.select(F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("members").alias("x"))
    right = sets.select(F.col("d1").alias("b1"), F.col("d2").alias("b2"), F.col("members").alias("y"))
    both = pairs.join(left, ["a1", "a2"]).join(right, ["b1", "b2"]).select("a1", "a2", "b1", "b2", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int((q[at] == p).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(4)], ["a1", "a2", "b1", "b2"]).filter(pa.array(keep, pa.bool_()))

    linked = both.mapInArrow(releasing(run), "a1 long, a2 long, b1 long, b2 long")
    out = durable(linked.select(F.struct(F.col("a1").alias("d1"), F.col("a2").alias("d2")).alias("a"), F.struct(F.col("b1").alias("d1"), F.col("b2").alias("d2")).alias("b")))
    discard(pairs, names, sets)
    return out


def _group_pairs(cells: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs of sets of different components inside a cell (h, x, y) that their sizes and bitmaps don't rule out; only the one with the
    `nearest` partner for each set that isn't of the hub's component, if so asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        while True:  # rows come sorted; a cell is complete when the next one begins
            batch = next(batches, None)
            if batch is not None:
                fresh = pa.Table.from_batches([batch])
                held = fresh if held is None else pa.concat_tables([held, fresh])
            if held is not None and len(held):
                name = np.column_stack([held.column(c).to_numpy() for c in ("h", "x", "y")])
                change = (np.flatnonzero((np.diff(name, axis=0) != 0).any(1)) + 1).tolist()
                whole = [0, *change] + ([len(held)] if batch is None else [])
                for begin, end in zip(whole, whole[1:], strict=False):
                    yield from _cell_pairs(held.slice(begin, end - begin), int(name[begin, 1]), percent, nearest)
                held = held.slice(whole[-1])
            if batch is None:
                return

    ordered = cells.repartition("h", "x", "y").sortWithinPartitions("h", "x", "y", "n")
    return ordered.mapInArrow(releasing(run), "a1 long, a2 long, b1 long, b2 long")


def _ranges(who: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(who[k], each number from low[k] to high[k] - 1), in steps of about STEP pairs."""
    many = np.maximum(high - low, 0)
    total, begin = np.cumsum(many), 0
    while begin < len(who):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + STEP, "right")))
        part = many[begin:end]
        offset = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
        yield np.repeat(who[begin:end], part), np.repeat(low[begin:end], part) + offset
        begin = end


def _cell_pairs(part: pa.Table, x: int, percent: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    part = part.combine_chunks()
    n, comp, minor, block, d1, d2 = (part.column(c).to_numpy(zero_copy_only=False) for c in ("n", "comp", "minor", "block", "d1", "d2"))
    n = n.astype(np.int64)
    if len(n) < 2 or (comp == comp[0]).all():
        return
    maps, tiles = Bitmaps(part.column("bitmap").to_pylist(), n), part.column("tiles").combine_chunks()
    # both ways give each pair that shares a tile: all of the size band, or tile by tile
    who = np.flatnonzero(minor)
    low, high = np.searchsorted(n, (percent * n[who] + 99) // 100), np.searchsorted(n, 100 * n[who] // percent, "right")
    lengths = pc.list_value_length(tiles).to_numpy(zero_copy_only=False).astype(np.int64)
    row, tile = np.repeat(np.arange(len(n)), lengths), tiles.flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((row, tile))
    row, tile = row[order], tile[order]
    asks = np.flatnonzero(minor[row])
    first, beyond = np.searchsorted(tile, tile[asks]), np.searchsorted(tile, tile[asks], "right")
    banded = (high - low).sum() <= 2 * (beyond - first).sum()
    found, best, chosen = [], np.full(len(n), 2.0), np.full(len(n), -1, np.int64)
    for i, j in _ranges(who, low, high) if banded else _ranges(row[asks], first, beyond):
        j = j if banded else row[j]
        ask = (comp[i] != comp[j]) & ((i < j) | ~minor[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        if x < 0:
            ask &= ~minor[j]
        elif len(np.unique(block)) > 1:
            ask &= block[i] != block[j]
        code = i[ask] * len(n) + j[ask]
        code = code if banded else np.unique(code)
        i, j = code // len(n), code % len(n)
        may, apart = maps.possible(percent, i, maps, j)
        if not nearest:
            found.append(code[may])
            continue
        for end in (i, j):  # the least share of each set wins, as it is written last
            at = np.flatnonzero(may & (apart < best[end]))
            at = at[np.argsort(-apart[at], kind="stable")]
            best[end[at]], chosen[end[at]] = apart[at], code[at]
    code = np.unique(np.concatenate([*found, chosen[minor & (chosen >= 0)]]))
    for begin in range(0, len(code), 10_000):
        i, j = code[begin : begin + 10_000] // len(n), code[begin : begin + 10_000] % len(n)
        swap = (d1[i] > d1[j]) | ((d1[i] == d1[j]) & (d2[i] > d2[j]))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (d1[i], d2[i], d1[j], d2[j])], ["a1", "a2", "b1", "b2"])


def _known(label: DataFrame) -> DataFrame:
    """(d, comp) of linked sets, by half digests."""
    return label.select(F.col("node.d1").alias("d"), F.col("component.d1").alias("comp"))


def _roles(rows: DataFrame, label: DataFrame) -> DataFrame:
    """The rows (h: hub, d: set, ...) with the set's component and whether it is another one than the hub's (minor)."""
    known = _known(label)
    hubs = rows.select("h").distinct().join(known.select(F.col("d").alias("h"), F.col("comp").alias("c")), "h", "left").select("h", F.coalesce("c", "h").alias("hub_comp"))
    return rows.join(known, "d", "left").withColumn("comp", F.coalesce("comp", "d")).join(hubs, "h").withColumn("minor", F.col("comp") != F.col("hub_comp")).drop("hub_comp")


def _cells(group: DataFrame, cell: int) -> DataFrame:
    """Deals each hub's group to cells: sets of the hub's component (not minor) meet the others, and those meet one another.

    A group of up to `cell` sets of either role is one cell, in which each set stands once.
    """
    sizes = group.groupBy("h").agg(F.ceil(F.sum(F.col("minor").cast("long")) / cell).cast("int").alias("few"), F.ceil(F.sum((~F.col("minor")).cast("long")) / cell).cast("int").alias("many")).where("few > 0")
    placed = group.join(sizes, "h").withColumn("block", F.pmod(F.xxhash64("d"), F.when(F.col("minor"), F.col("few")).otherwise(F.col("many"))).cast("int"))
    single = F.expr("array(named_struct('x', 0, 'y', 0))")
    major = F.expr("transform(sequence(0, few - 1), j -> named_struct('x', -1 - block, 'y', j))")
    minor = F.expr(
        "concat(transform(sequence(0, few - 1), j -> named_struct('x', least(block, j), 'y', greatest(block, j))),"
        " case when many > 0 then transform(sequence(0, many - 1), i -> named_struct('x', -1 - i, 'y', block)) else cast(array() as array<struct<x: int, y: int>>) end)"
    )
    dealt = placed.withColumn("cell", F.explode(F.when((F.col("few") == 1) & (F.col("many") <= 1), single).when(F.col("minor"), minor).otherwise(major)))
    return dealt.select("h", "cell.x", "cell.y", "n", "d", "comp", "minor", F.when((F.col("few") == 1) & (F.col("many") <= 1), 0).otherwise(F.col("block")).alias("block"), "tiles")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id.

    n_shingles: distinct shingles of `k` words (A-Z in lower case, words split at space and U+0009..U+000D). component_id: the least
    doc_id reachable over links of 100 * intersection >= `percent` * union. A null, empty or blank text has no shingles, links with
    nothing and is its own component. Equal sets always link. Ids may be of any type that can be ordered. A row with a null id links
    like any other and gets the component of its links, null if none of them has an id. Repeated rows stay. Other columns aren't read;
    an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    survey = durable(_survey(docs, k))
    heavy = survey.where("bucket is not null").groupBy("bucket").agg(F.sum("load").alias("load")).orderBy(F.desc("load"), "bucket").limit(SKETCH // 8)
    hot = heavy.select("bucket").toPandas()["bucket"].to_numpy(np.int64)

    tiles = durable(_tiles(_prefixes(docs, k, percent, hot), percent))
    names = tiles.select(F.col("d").alias("d1")).distinct()
    nodes = durable(survey.where("bitmap is not null").select("d1", "d2", F.col("n").cast("int").alias("n"), "t", "bitmap").join(names, "d1", "left_semi").dropDuplicates(["d1", "d2"]))

    either = lambda x, y: tiles.where(F.col(y).isNotNull()).select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    first = _possible(either("d", "u").union(either("d", "v")).distinct(), nodes, percent)
    label = components(_verified(first, docs, nodes, k, percent))

    wide = tiles.where("wide").select("tile", "n", "d")
    shares = wide.groupBy("d").agg(F.count("*").alias("share")).join(_known(label).withColumn("linked", F.lit(True)), "d", "left")
    ranked = shares.select("d", F.coalesce("comp", "d").alias("comp"), F.when(F.col("linked"), F.col("share")).otherwise(0).alias("share"))
    members = wide.join(ranked, "d").withColumn("share", F.col("share") / F.col("n"))
    unsettled = members.groupBy("tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("share", F.col("d").alias("h"), F.col("comp").alias("hub_comp"), F.col("n").alias("hub_n"))).alias("hub")).where("lo <> hi").select("tile", "hub")
    open_tiles = durable(members.join(unsettled, "tile").select("tile", "n", "d", "comp", "share", "hub.h", "hub.hub_comp", "hub.hub_n", F.col("hub.share").alias("hub_share")))
    to_hub = open_tiles.where(f"hub_share > 0 and comp <> hub_comp and 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").select(F.least("d", "h").alias("x"), F.greatest("d", "h").alias("y")).distinct()
    edges = lambda known: known.select(F.col("node").alias("a"), F.col("component").alias("b"))
    label = components(edges(label).union(_verified(_possible(to_hub, nodes, percent), docs, nodes, k, percent)))

    sides = open_tiles.select("tile", "n", "d", "h")
    group = durable(_roles(sides, label).join(_roles(sides, label).where("minor").select("tile").distinct(), "tile").groupBy("h", "d").agg(F.first("n").alias("n"), F.collect_list("tile").alias("tiles")))
    for nearest in (True, False):
        cells = _cells(_roles(group, label), cell).join(nodes.select(F.col("d1").alias("d"), "d1", "d2", "bitmap"), "d")
        label = components(edges(label).union(_verified(_group_pairs(cells, percent, nearest).distinct(), docs, nodes, k, percent)))
    discard(tiles, nodes, open_tiles, group)

    rows = survey.where("bucket is null").select("doc_id", "n", "d1", "d2")
    sets = rows.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    linked = label.select("node.d1", "node.d2", "component").distinct().join(sets, ["d1", "d2"])
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = durable(linked.join(least, "component").select("d1", "d2", "component_id"))
    classed = sets.join(classes, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("component_id", "rep").alias("component_id"))
    some = rows.where("n > 0").join(classed, ["d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id")))


def _passing(docs: DataFrame, id_col: str, asked: TextFilter, wanted: bool) -> DataFrame:
    """The rows of `docs` whose id passes the filter, or those whose id doesn't."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = shared.value(batch.column(batch.num_columns - 1).to_numpy())
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(passed == wanted))

    return docs.select(*docs.columns, F.xxhash64(id_col).alias("id hash")).mapInArrow(releasing(run), docs.schema)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the least of its component; of repeated rows with such an id and equal texts one stays. Rows with a
    null id stay."""
    found = durable(jaccard_components(docs, k, percent, id_col, text_col))
    gone = durable(found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct())
    # a filter of fixed size tells most rows that stay, so their texts aren't shuffled
    asked = TextFilter(gone.select(F.xxhash64(id_col).alias("t")))
    kept = _passing(docs, id_col, asked, False).union(_passing(docs, id_col, asked, True).join(gone, id_col, "left_anti").select(*docs.columns))
    twice = durable(found.where("doc_id = component_id and n_shingles > 0").groupBy(F.col("doc_id").alias(id_col)).agg(F.count("*").alias("rows")).where("rows > 1").select(id_col))
    if twice.isEmpty():
        return kept
    single = kept.join(twice, id_col, "left_semi").select(*docs.columns).dropDuplicates([id_col, text_col])
    return kept.join(twice, id_col, "left_anti").select(*docs.columns).union(single)
