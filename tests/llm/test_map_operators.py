"""Operators that map rows: against plain versions, and on odd rows."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pyarrow as pa
import pytest
from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

import public_tokenizers
from morphogrid.llm import bpe_prefix, fm_decontam, quality_ranker, repetition_rules, toxic_crf, unigram_count
from morphogrid.llm.common import default_spec

from .conftest import EDGE, SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark, edge):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id >= 20").union(edge.select("doc_id", "text"))


def rows(df):
    return sorted(df.collect(), key=repr)


def rules(text):
    text = text or ""
    words, seen, lines, cover = SPACED.findall(text), set(), 0, set()
    for line in text.split("\n"):
        if SPACED.search(line):
            lines += line in seen
            seen.add(line)
    count = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    for i in range(len(words) - 2):
        if count[tuple(words[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(cover)


def test_repetition_rules(docs, nothing):
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(rules(r.text))
    got = repetition_rules.repetition_rules(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in texts[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert repetition_rules.repetition_rules(nothing).count() == 0


def test_bpe_matches_the_tokenizers_library(docs, nothing):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

    def expected(text):
        ids = plain.encode(text or "", add_special_tokens=False).ids
        return len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids

    want = sorted(((r.doc_id, *expected(r.text)) for r in docs.collect()), key=repr)
    assert sorted((tuple(r) for r in bpe_prefix.bpe_encode(docs, default_spec()).collect()), key=repr) == want
    assert bpe_prefix.bpe_encode(nothing, default_spec()).count() == 0


def test_suffix_automaton_against_endswith():
    tokens = ["a", "b", "ab", "bab", "abab", "ba", "c", "cab", "bb"]
    auto = bpe_prefix.SuffixAutomaton((t, k) for k, t in enumerate(tokens))
    text, state, length = "ababcabbabxbab", 0, 0
    for end, c in enumerate(text, 1):
        while state and c not in auto.step[state]:
            state, length = auto.link[state], auto.size[auto.link[state]]
        if c not in auto.step[state]:
            continue
        state, length = auto.step[state][c], length + 1
        at = state if auto.name[state] >= 0 and length == auto.size[state] else auto.marked[state]
        found = []
        while at > 0:
            found.append(tokens[auto.name[at]])
            at = auto.marked[at]
        assert found == sorted((t for t in tokens if text[:end].endswith(t)), key=len, reverse=True)


def test_bpe_round_trip():
    bpe = bpe_prefix.PrefixBpe(default_spec())
    symbols = {c: b for b, c in enumerate(bpe.bytes)}
    for text, words in (("hello Worlds, it's 12", ["hello", "worlds", ",", "it", "'s", "1", "2"]), ("aaaa  b", ["aaaa", "b"]), ("\xc9t\xe9 \u65e5\u672c", ["\xe9t\xe9", "\u65e5\u672c"]), ("a<|endoftext|>", ["a", "<|endoftext|>"])):
        ids = bpe.encode(text)
        pieces = bpe.decode(ids).replace(" ", "").replace("<|endoftext|>", "<|endoftext|></w>").split("</w>")[:-1]
        assert [bytes(symbols[c] for c in p).decode() for p in pieces] == words


def test_unigram_counts_match_the_tokenizers_library(docs, nothing):
    vocabulary = unigram_count.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    plain = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0, byte_fallback=False))
    plain.normalizer = normalizers.Sequence([normalizers.Replace(Regex(r"\s+"), " "), normalizers.Strip()])
    plain.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    want = sorted(((r.doc_id, len(plain.encode(r.text or "").ids)) for r in docs.collect()), key=repr)
    got = unigram_count.token_counts(docs, vocabulary)
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=repr) == want
    assert unigram_count.token_counts(nothing, vocabulary).count() == 0


def test_unigram_ties_and_unknowns():
    counter = unigram_count.Counter([("▁a", -1.0), ("b", -1.0), ("▁ab", -2.0), ("▁", -5.0)])
    assert counter.text("ab")[0] == 1  # equal scores: the earlier start stays
    assert counter.text("a??b") == (3, 1, 1, -1.0 + 2 * (-5.0 - 10.0) - 1.0)
    assert counter.text("") == counter.text(" \n") == (0, 0, 0, 0.0)


def plain_windows(texts, items):
    windows = defaultdict(set)
    for name, text in items:
        words = WORD.findall(lower(text))
        for k in range(max(1, len(words) - 7) if words else 0):
            windows[tuple(words[k : k + 8])].add(str(name))
    sizes, out = {len(w) for w in windows}, []
    for doc, text in texts:
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if named := windows.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= named
        out.append((doc, len(words), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 4000])
def test_decontamination(spark, docs, nothing, block):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").union(spark.createDataFrame([(900, "MIT license"), (901, None), (None, "no id here"), (902, "")], "item_id long, text string"))
    items = [(r.item_id, r.text) for r in benchmark.collect() if r.item_id is not None and r.text is not None]
    marked = fm_decontam.mark_benchmark(docs, benchmark, block_bytes=block)
    assert rows(fm_decontam.digest(marked)) == plain_windows([tuple(r) for r in docs.collect()], items)
    cut = fm_decontam.remove_passages(docs, benchmark, block_bytes=block).cache()
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert fm_decontam.digest(fm_decontam.mark_benchmark(cut, benchmark)).where("n_hit > 0").count() == 0
    hit = {r.doc_id for r in fm_decontam.digest(marked).where("n_hit > 0").collect()}
    old, new = ({(r.doc_id, r.text) for r in d.collect() if r.doc_id not in hit} for d in (docs, cut))
    assert old == new
    assert fm_decontam.digest(fm_decontam.mark_benchmark(nothing, benchmark)).count() == 0
    assert fm_decontam.digest(fm_decontam.mark_benchmark(docs, benchmark.where("false"))).where("n_hit > 0").count() == 0


def test_cut_until_nothing_is_left(spark):
    frame = spark.createDataFrame([(1, "so mit mit license license it ends", "7", 34), (2, None, None, None), (3, "clean", "x", 5), (None, "MIT License", "y", 11)], "doc_id long, text string, items string, n_chars int")
    benchmark = spark.createDataFrame([(1, "mit license")], "item_id long, text string")
    got = {r.doc_id: (r.text, r["items"], r.n_chars) for r in fm_decontam.remove_passages(frame, benchmark).collect()}
    assert got == {1: ("so  it ends", "7", 11), 2: (None, None, None), 3: ("clean", "x", 5), None: ("", "y", 0)}


def test_fm_index_against_str_find():
    text = [1, 2, 1, 2, 1, 0, 2, 2, 1, 0]
    import numpy as np

    index = fm_decontam.FmIndex(np.array(text), 3)
    for phrase in ([1], [2], [1, 2], [2, 1], [1, 2, 1], [2, 2], [2, 2, 2]):
        low, high = index.search(np.array([phrase]), np.array([len(phrase)]))
        found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert found == [i for i in range(len(text)) if text[i : i + len(phrase)] == phrase]


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_classifiers_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for mark, scored, least in (("quality", quality_ranker.quality_scores(docs, quality_ranker.train(docs, labels)), 0.95), ("toxic", toxic_crf.toxicity(docs, toxic_crf.train(docs, labels)), 0.8)):
        held = scored.join(labels, "doc_id").where("held_out").select("score", mark, "doc_id").collect()
        assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
        assert auc([(r.score, r[mark]) for r in held]) >= least
        assert all(0 <= r.score <= 1 for r in held)


def test_classifiers_on_odd_rows(spark, edge, nothing):
    labels = spark.createDataFrame([(4, 1, 0), (5, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    ranking, tagger = quality_ranker.train(edge, labels), toxic_crf.train(edge, labels)
    for scored in (quality_ranker.quality_scores(edge, ranking), toxic_crf.toxicity(edge, tagger)):
        assert scored.count() == len(EDGE)
        assert scored.where("score is null or predicted is null or held_out is null").count() == 0
    assert quality_ranker.quality_scores(nothing, quality_ranker.train(nothing, labels)).count() == 0
    assert toxic_crf.toxicity(nothing, toxic_crf.train(nothing, labels.where("false"))).count() == 0


def test_chain_marginals_against_enumeration():
    from itertools import product

    import numpy as np

    emission, start, t01, t10, t11 = np.array([0.3, -1.0, 2.0, 0.1]), 0.2, -0.5, 0.4, 0.9
    total, each = 0.0, np.zeros(4)
    for y in product((0, 1), repeat=4):
        score = sum(e * s for e, s in zip(emission, y, strict=True)) + start * y[0] + sum({(0, 1): t01, (1, 0): t10, (1, 1): t11}.get(p, 0.0) for p in zip(y, y[1:], strict=False))
        total += np.exp(score)
        each += np.exp(score) * np.array(y)
    assert np.allclose(toxic_crf.chain(emission, np.zeros(4, int), start, t01, t10, t11)[2], each / total)


def test_texts_cut_into_kernel_batches():
    from morphogrid.llm.common import text_batches

    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "b" * 50, "", "cc"])], ["text"])
    assert [t.to_pylist() for _, t in text_batches([batch], "text", 4)] == [["aa", ""], ["b" * 50], ["", "cc"]]


def test_a_task_of_another_kernel_drops_what_was_kept():
    from pyspark import cloudpickle

    from morphogrid.llm import common

    common._kept.clear()
    travelled = cloudpickle.loads(cloudpickle.dumps((common.releasing(iter, "mine"), common.releasing(iter))))
    common.kept("mine", list)
    list(travelled[0](iter([])))
    assert "mine" in common._kept
    list(travelled[1](iter([])))
    assert not common._kept


def test_encoders_are_small_and_texts_encoded_at_once_are_as_one_by_one():
    import pickle
    import tracemalloc

    made = pickle.dumps(bpe_prefix.PrefixBpe(default_spec()))
    tracemalloc.start()
    bpe = pickle.loads(made)
    small = tracemalloc.get_traced_memory()[0] < 50 << 20
    tracemalloc.stop()
    assert small
    texts = ["cut off", "", "a  b\n\tc ", "x<|endoftext|> y <|endoftext|>", "Hello, HELLO hello\x1c\x1f \xa0w\xf6rter 日本 é it's 12", " ", "<|startoftext|>", "\xc3\xa9 \xe9 Ġ", "a b a b"]
    got, begins = bpe.encode_all(pa.array(texts, pa.large_string())[1:])
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts[1:]]
    assert [got[a:b].tolist() for a, b in zip(begins, begins[1:], strict=False)] == want == [bpe.encode(t).tolist() for t in texts[1:]]
    assert bpe.decode(want[2]) == plain.decode(want[2], skip_special_tokens=False)
    assert [len(x) for x in bpe.encode_all(pa.array([], pa.large_string()))] == [0, 1]


def test_workers_hand_memory_back_while_a_task_goes_on(monkeypatch):
    from morphogrid.llm import common

    times, trimmed = iter(range(100)), []
    monkeypatch.setattr(common.time, "monotonic", lambda: next(times))
    monkeypatch.setattr(common, "trim_memory", lambda: trimmed.append(1))
    assert list(common.releasing(iter)(iter([1, 2, 3]))) == [1, 2, 3] and len(trimmed) == 4
