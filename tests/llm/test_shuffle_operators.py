"""Operators that shuffle: against plain versions, and on odd rows."""

import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from morphogrid.llm import chat_preference, jaccard_join, jump_shards, license_scan, registry
from morphogrid.llm.components import components

from .conftest import EDGE, SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def base_of(text):
    words, found = WORD.findall(lower(text)), []
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_license_scan(spark, edge, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id >= 20").union(edge.select("doc_id", "text"))
    got = license_scan.license_scan(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr) == sorted(((r.doc_id, *base_of(r.text)) for r in docs.collect()), key=repr)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert license_scan.license_scan(nothing).count() == 0


def test_license_passages_with_edits(spark):
    text = next(t for t, label in license_scan.PARAGRAPHS if label == "bsd-text")
    words = text.split()
    texts = [text, " ".join(words[:6] + ["really"] + words[6:]), " ".join(words[:8] + words[9:]), "prose before " + " ".join(words[:4]), " ".join(reversed(words))]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(5)] == ["bsd-text", "bsd-text", "bsd-text", "", ""]
    assert got[0].score == 1.0 and 0 < got[3].score < 0.7


def plain_labels(text, gap=3, least=0.7):
    """Labels and score by comparing every template's pairs at every offset."""
    words, labels, best = WORD.findall(lower(text)), set(), 0.0
    for t in license_scan.TEMPLATES:
        pairs = {k: (a, b) for k, a, b in t.pairs()}
        hits = sorted((i, i - k, k) for i, p in enumerate(zip(words, words[1:], strict=False)) for k, q in pairs.items() if p == q)
        diagonals = defaultdict(list)
        for i, d, k in hits:
            diagonals[d].append((i, k))
        if t.phrase:
            if any(len(v) == len(pairs) for v in diagonals.values()):
                labels.add(t.label)
                best = 1.0
            continue
        spans, before = [], None
        for first, d, v in sorted((v[0][0], d, v) for d, v in diagonals.items()):
            if before is None or abs(d - before[1]) > gap or first - before[0] > len(t.words) + gap:
                spans.append(set())
            spans[-1] |= {k for _, k in v}
            before = first, d
        for s in spans:
            best = max(best, len(s) / len(pairs))
            if len(s) >= least * len(pairs):
                labels.add(t.label)
    return ",".join(sorted(labels)), best


def test_license_labels_against_every_offset(spark):
    import random

    rng, texts = random.Random(3), [None, "", "I took the cc by the hand", "mit"]
    for text, _ in license_scan.PARAGRAPHS:
        words = text.split()
        texts += [text, " ".join(w for w in words if rng.random() > 0.1), " ".join(x for w in words for x in ([w, "odd"] if rng.random() < 0.1 else [w])), f"prose {text} and {text}"]
    texts += [" ".join(t for t, _ in rng.sample(license_scan.PARAGRAPHS, 5)) + " " + rng.choice([*license_scan.BASE, *(t for t, _ in license_scan.NAMES)]) for _ in range(20)]
    got = license_scan.license_scan(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, label string, score string")).collect()
    want = {i: plain_labels(t) for i, t in enumerate(texts)}
    for r in got:
        assert (r.labels, round(r.score, 9)) == (want[r.doc_id][0], round(want[r.doc_id][1], 9)), texts[r.doc_id]
    assert want[2] == ("", 0.0)


def classes(pairs):
    """(size, component) of (id, text) pairs with distinct ids, by comparing all pairs that share a shingle."""
    sets = []
    for _, text in pairs:
        w = SPACED.findall(lower(text))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    holders, parent = defaultdict(list), list(range(len(pairs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in holders[g]).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for g in s:
            holders[g].append(i)
    least = {}
    for i, (name, _) in enumerate(pairs):
        least[root(i)] = min(least.get(root(i), name), name)
    return sorted((name, len(sets[i]), least[root(i)]) for i, (name, _) in enumerate(pairs))


def near_copies():
    """A hot group of near copies, a passage that many texts share, and chains of copies each near the next only."""
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, passage, out = [word() for _ in range(120)], " ".join(word() for _ in range(60)), []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    out += [f"{passage} {' '.join(word() for _ in range(rng.randint(5, 60)))}" for _ in range(150)]
    chain = [word() for _ in range(100)]
    for _ in range(30):
        chain = [*chain[3:], *(word() for _ in range(3))]
        out.append(" ".join(chain))
    out += ["a b", "A b", "a b c", "", " "]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("cell", [7, 20_000])
def test_jaccard_components(spark, cell):
    pairs = near_copies()
    got = jaccard_join.jaccard_components(spark.createDataFrame(pairs, "doc_id long, text string").repartition(5), cell=cell)
    assert sorted(map(tuple, got.collect())) == classes(pairs)


def test_jaccard_on_odd_rows(spark, edge, nothing):
    got = jaccard_join.jaccard_components(edge).collect()
    assert len(got) == len(EDGE)
    found = {r.doc_id: r.component_id for r in got}
    assert found[1] == 1 and found[2] == 2 and found[5] == 4 and found[None] is None
    assert jaccard_join.jaccard_components(nothing).count() == 0
    kept = jaccard_join.keep_one(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 5").count() == 0 and kept.where("doc_id is null").count() == 1


def test_links_through_rows_without_an_id(spark):
    words = [f"w{i}" for i in range(64)]
    a, between, b = ([f"{x}{i}" for i in range(k)] + words[k:] for x, k in (("x", 5), ("y", 0), ("z", 5)))
    b = words[:-5] + ["q1", "q2", "q3", "q4", "q5"]
    for ids in ((1, None, 2), ("a", None, "b")):
        frame = spark.createDataFrame([(i, " ".join(t)) for i, t in zip(ids, (a, between, b), strict=True)], f"doc_id {'long' if ids[0] == 1 else 'string'}, text string")
        assert {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(frame).collect()} == {(i, ids[0]) for i in ids}


def test_tiles_in_pieces(spark):
    """Tiles are alike however the sorted rows are cut into batches, and hold every pair within the band whose smaller set is indexed."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = np.unique(np.column_stack([rng.integers(0, 6, 600), (rng.integers(5, 60, 600) << 32) | rng.integers(0, 4, 600), rng.integers(0, 200, 600)]), axis=0)
    out = []
    for step in (1, 3, 17, 1000):
        scan = jaccard_join.TileScan(80)
        got = [scan.push(rows[i : i + step]) for i in range(0, len(rows), step)] + [scan.push(None)]
        out.append([tuple(r.values()) for b in got if b is not None for r in b.to_pylist()])
    assert out[0] == out[1] == out[2] == out[3]
    tiles = defaultdict(list)
    for tile, n, d, *_ in out[0]:
        tiles[tile].append((n, d))
    together = {(p, q) for t in tiles.values() for p in t for q in t}
    for k in range(6):
        mine = [(int(at) >> 32, int(at) & 0xFFFFFFFF, int(d)) for key, at, d in rows if key == k]
        for x, (n, i, d) in enumerate(mine):
            for m, j, e in mine[x + 1 :]:
                need = -(-80 * (n + m) // 180)
                if n - i >= need and m - j >= need:
                    assert ((n, d), (m, e)) in together


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 3), (70, 71)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {i: 0 for i in range(61)} | {70: 70, 71: 70}
    assert components(edges.where("false")).count() == 0


def published_jump(key, shards):
    key, b, j = key % (1 << 64), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(spark, edge, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(edge.select("doc_id", "text")).union(spark.createDataFrame([(-5, "x"), (1 << 62, "y")], "doc_id long, text string"))
    got = jump_shards.shard(docs, buckets=5).collect()
    for r in got:
        key = -1 if r.doc_id is None else r.doc_id
        assert (r.shard, r.grown_shard) == (published_jump(key, 24), published_jump(key, 25)) and r.law == "key"
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((r.doc_id, len((r.text or "").encode()) + 8, crc32((r.text or "").encode())) for r in docs.collect()), key=repr)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert jump_shards.shard(nothing).count() == 0
    again = jump_shards.shard(docs.repartition(7).select(F.lit("x").alias("shard"), F.lit(1).alias("rows"), "*"), buckets=5, most=1).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)  # slots hang on contents, not on the partitioning


def test_preference_rows(spark):
    turns = [
        (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "good"),
        (2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 2, "user", "else"),
        (3, 0, "user", "same"), (4, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "user", "same"),
        (5, None, None, None), (6, 0, "user", "x"), (None, 0, "user", "lost"),
    ]
    frame = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, part string")
    pairs = spark.createDataFrame([(10, 1, 2), (11, 3, 4), (12, 5, 6), (13, 98, 99)], "pair_id long, chosen long, rejected long")
    got = sorted((r.pair_id, r.part, r.turn, r.rendered, r["mask"], r.copies, r.prompt_turns) for r in chat_preference.preference_rows(frame, pairs).collect())
    show = lambda role, text: f"<|{role}|>\n{text}\n<|end|>\n"
    assert got == [
        (10, "chosen", 2, show("user", "more"), 0, 1, 2), (10, "chosen", 3, show("assistant", "good"), 1, 1, 2), (10, "prompt", 0, show("user", "q"), 0, 1, 2), (10, "prompt", 1, show("assistant", "a"), 0, 1, 2), (10, "rejected", 2, show("user", "else"), 0, 1, 2),
        (11, "prompt", 0, show("user", "same"), 0, 2, 1),
        (12, "chosen", -1, show("unknown", ""), 0, 1, 0), (12, "rejected", 0, show("user", "x"), 0, 1, 0),
    ]
    assert chat_preference.preference_rows(frame.where("false"), pairs).count() == 0


def test_cut_replies_have_prompts(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "abc"), (1, 2, "user", "after"), (2, 0, "user", "no reply"), (3, 0, "assistant", ""), (None, 0, "assistant", "lost"), (4, 0, "system", "s"), (4, 1, "user", "q"), (4, 2, "assistant", "x"), (4, 3, "user", "r"), (4, 4, "assistant", "\U0001f600b")]
    frame = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, pair_id int")
    got = sorted((r.pair_id, r.part, r.turn, r.rendered.split("\n")[1], r["mask"], r.prompt_turns) for r in chat_preference.preference_rows(*chat_preference.cut_replies(frame)).collect())
    assert got == [
        (1, "chosen", 1, "abc", 1, 1), (1, "prompt", 0, "q", 0, 1), (1, "rejected", 1, "a", 1, 1), (3, "prompt", 0, "", 0, 1),
        (4, "chosen", 4, "\U0001f600b", 1, 4), (4, "prompt", 0, "s", 0, 4), (4, "prompt", 1, "q", 0, 4), (4, "prompt", 2, "x", 0, 4), (4, "prompt", 3, "r", 0, 4), (4, "rejected", 4, "\U0001f600", 1, 4),
    ]
    found = registry.queries()["op9_chat_preference"](spark, SF).groupBy("part").count().collect()
    assert {r.part for r in found} == {"prompt", "chosen", "rejected"}


def test_preferences_of_repeated_pairs_and_none(spark):
    frame = spark.createDataFrame([(1, 0, "user", "q"), (2, 0, "user", "p")], "conv_id long, turn long, role string, text string")
    none = spark.createDataFrame([], "pair_id long, chosen long, rejected long")
    assert chat_preference.preference_rows(frame, none).count() == 0
