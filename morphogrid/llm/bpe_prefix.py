"""BPE encoding by dynamic programming over prefixes, and decoding.

An encoding of a text by merges has one last token for each of its prefixes, and a token can be that last token exactly if merging
would leave it and the last token before it apart. The suffix automaton of the vocabulary reads a word symbol by symbol; its state is the
longest suffix that stands inside any token, and suffix links lead from there to the tokens that end at this place, longest first. The
first one compatible with the stored last token before it is stored, and back-pointers give the ids. Work is linear in the text,
whatever the merges. Words end in a marked last symbol, as the vocabulary has it.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import kept, map_texts

#: Words and pairs of tokens of a generation that a worker remembers; greatest length of a word. When a generation is full the one
#: before it is forgotten, but for what was met again since; so rare words don't drive out common ones.
REMEMBERED, PAIRS, LONGEST = 250_000, 100_000, 64
#: Stands after the last symbol of a word inside the automaton; no byte symbol.
END = "\x00"
#: White space as the tokenizer's patterns see it; str.split() also splits at U+001C..U+001F.
SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
FOREVER = 1 << 60
#: Chunks of characters below U+0180, all of them composed, whose lower case stays there; the tokenizer's split on those.
LATIN = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u017f]+")
LATIN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff\u0101-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(free)) for b in range(256)]


class SuffixAutomaton:
    """The suffix automaton of a set of strings.

    A state stands for the substrings that end at the same places. A whole string is the longest of its state, as nothing stands
    before it where it is whole; so the strings that end at a place are marked states on the chain of suffix links.
    """

    def __init__(self, named: Iterable[tuple[str, int]]):
        step: list[dict[str, int]] = [{}]
        link, size, name = [-1], [0], [-1]

        def add(length: int, out: dict[str, int], suffix: int) -> int:
            step.append(out)
            link.append(suffix)
            size.append(length)
            name.append(-1)
            return len(step) - 1

        def split(state: int, c: str) -> int:
            """The state of `state`'s longest substring and `c`, taken out of the state that holds it among longer ones."""
            long = step[state][c]
            if size[long] == size[state] + 1:
                return long
            own = add(size[state] + 1, dict(step[long]), link[long])
            link[long] = own
            while state >= 0 and step[state].get(c) == long:
                step[state][c] = own
                state = link[state]
            return own

        for text, number in named:
            last = 0
            for c in text:
                if c in step[last]:
                    last = split(last, c)
                    continue
                new, state = add(size[last] + 1, {}, 0), last
                while state >= 0 and c not in step[state]:
                    step[state][c] = new
                    state = link[state]
                if state >= 0:
                    link[new] = split(state, c)
                last = new
            name[last] = number
        none: dict[str, int] = {}
        self.step = [out or none for out in step]
        self.link, self.size, self.name = (array("i", x) for x in (link, size, name))
        self.marked = array("i", [-1]) * len(link)  # the longest marked state on the chain beyond a state
        for state in sorted(range(1, len(link)), key=size.__getitem__):
            above = link[state]
            self.marked[state] = above if name[above] >= 0 else self.marked[above]


class Recent(dict):
    """A dict of what was met lately: two generations of `most` entries at most."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def __missing__(self, key):
        """What the older generation knows of `key`, which then belongs to this one; None where it knows nothing."""
        found = self.older.pop(key, None)
        if found is not None:
            self[key] = found
        return found

    def __reduce__(self):
        return Recent, (self.most,)

    def add(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value


class PrefixBpe:
    """An encoder for one tokenizer file with a BPE model, and its decoder."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        described = json.loads(spec)
        model = described["model"]
        if model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE models over whole byte alphabets are supported")
        self.suffix = model.get("end_of_word_suffix") or ""
        rules = described | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None, "decoder": None}
        self.rules = Tokenizer.from_str(json.dumps(rules))  # normaliser and splitter only
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        vocabulary = model["vocab"]
        names = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        many = max(names, default=-1) + 1
        self.names = pa.array([names.get(i) for i in range(many)], pa.large_string())
        self.decimals = pa.array(map(str, range(many)), pa.large_string())
        self.rank: dict[int, int] = {}  # by the two ids in one number
        self.parts = [array("i", [-1]) * many for _ in range(3)]  # of each token made by a merge: left, right, rank
        for number, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            made = vocabulary.get(a + b)
            if a in vocabulary and b in vocabulary and made is not None:
                left, right = vocabulary[a], vocabulary[b]
                self.rank[left << 32 | right] = number
                if self.parts[0][made] < 0:
                    for part, value in zip(self.parts, (left, right, number), strict=True):
                        part[made] = value
        symbols: dict[int, str] = {}
        for token, i in vocabulary.items():
            ended = bool(self.suffix) and token.endswith(self.suffix)
            text = (token[: -len(self.suffix)] + END) if ended else token
            if self.parts[0][i] >= 0 or len(text) == 1 + ended:  # others can't be made by merges
                symbols[i] = text
        self.automaton = SuffixAutomaton((text, i) for i, text in symbols.items())
        self.apart: Recent = Recent(PAIRS)
        self.whole: dict[int, bool] = {}
        self.words: Recent = Recent(REMEMBERED)
        self.bytes = byte_symbols()
        # the short way for Latin text holds for this pipeline of normaliser and splitter only
        stages = described.get("normalizer") or {}
        splitter = described.get("pre_tokenizer") or {}
        kinds = [x["type"] for x in stages.get("normalizers", [])], [x["type"] for x in splitter.get("pretokenizers", [])]
        self.latin = kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and splitter["pretokenizers"][0]["pattern"].get("Regex") == LATIN_SPLIT

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols at the token's right (1) or left (0) edge while it is made: (symbol, rank of the merge that takes it away)."""
        out, inner, ranks = [(token, FOREVER)], self.parts[1 if side else 0], self.parts[2]
        while inner[token] >= 0:
            gone, token = ranks[token], inner[token]
            out.append((token, gone))
        return out[::-1]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the symbols of both tokens leaves the two apart."""
        key = left << 32 | right
        if (known := self.apart[key]) is None:
            known = self.alone(right) and self._apart(left, right)
            self.apart.add(key, known)
        return known

    def _apart(self, left: int, right: int) -> bool:
        a, b = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while True:  # the pair at the border at a time; each is there until one of the two is merged away
            rank = self.rank.get(a[i][0] << 32 | b[j][0])
            # of equal merges the left one comes first: before the border's on the left side, after it on the right
            if rank is not None and rank < a[i][1] and rank <= b[j][1]:
                return False
            if i == len(a) - 1 and j == len(b) - 1:
                return True
            if a[i][1] <= b[j][1]:
                i += 1
            else:
                j += 1

    def alone(self, token: int) -> bool:
        """Whether merging the token's own symbols gives it back."""
        if (known := self.whole.get(token)) is None:
            left, right, rank = (part[token] for part in self.parts)
            known = left < 0
            if not known:
                known = self.alone(left) and self.alone(right) and self._meets(left, right, rank)
            self.whole[token] = known
        return known

    def _meets(self, left: int, right: int, rank: int) -> bool:
        """Whether nothing crosses the border of the two before they merge at `rank`."""
        a, b = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while (i, j) != (len(a) - 1, len(b) - 1):
            found = self.rank.get(a[i][0] << 32 | b[j][0])
            if found is not None and found < a[i][1] and found <= b[j][1]:
                return False
            if a[i][1] <= b[j][1]:
                i += 1
            else:
                j += 1
        return True

    def word(self, symbols: str) -> list[int]:
        """Ids of one word in byte symbols."""
        text = symbols + END if self.suffix else symbols
        n = len(text)
        tokens: list[int] = [-1] * (n + 1)
        before = [0] * (n + 1)
        apart, auto = self.apart, self.automaton
        step, size, name, link, marked = auto.step, auto.size, auto.name, auto.link, auto.marked
        state = length = end = 0
        for c in text:
            end += 1
            while (to := step[state].get(c)) is None and state:
                state = link[state]
                length = size[state]
            if to is None:
                continue
            state, length = to, length + 1
            at = state if name[state] >= 0 and length == size[state] else marked[state]
            while at > 0:  # tokens that end here, the longest first
                token, start = name[at], end - size[at]
                if start:
                    left = tokens[start]
                    if left >= 0:
                        fits = apart.get(left << 32 | token)
                        if self.compatible(left, token) if fits is None else fits:
                            tokens[end], before[end] = token, start
                            break
                elif self.alone(token):
                    tokens[end] = token
                    break
                at = marked[at]
        out = []
        while n:
            if tokens[n] < 0:
                raise ValueError(f"a symbol of {symbols!r} isn't in the vocabulary")
            out.append(tokens[n])
            n = before[n]
        return out[::-1]

    def remembered(self, symbols: str) -> str:
        """Ids of one word in byte symbols, a code point for each."""
        got = self.words[symbols]
        if got is None:
            got = "".join(map(chr, self.word(symbols)))
            if len(symbols) <= LONGEST:
                self.words.add(symbols, got)
        return got

    def chunk(self, text: str) -> str:
        """The same of a text without special tokens: normalised, split into words, each encoded."""
        if self.latin and LATIN.fullmatch(text):
            words = LATIN_WORDS.findall(text.lower())
            if not text.isascii():
                words = ["".join(map(self.bytes.__getitem__, w.encode())) for w in words]
        else:
            normal = self.rules.normalizer.normalize_str(text) if self.rules.normalizer else text
            words = [w for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(normal)]
        if len(words) == 1:
            return self.remembered(words[0])
        return "".join([self.remembered(w) for w in words])

    def encode_plain(self, text: str) -> list[str]:
        """Ids of each chunk between white space, a code point for each id."""
        return list(map(self.chunk, SPACE.split(text) if ODD_SPACE.search(text) else text.split()))

    def coded(self, text: str) -> str:
        """Ids of a whole text, a code point for each."""
        special = self.cut is not None and self.cut.search(text)
        return "".join(self._around_special(text) if special else self.encode_plain(text))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return _numbers(self.coded(text))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all `texts`, a null-free large_string array, and where those of each begin (one more at the end).

        A piece between spaces is looked up once, however often it stands in `texts`. Texts with special tokens are one piece.
        """
        odd = np.zeros(len(texts), bool)
        for token in self.special:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(odd)
        whole = [self.coded(texts[i].as_py()) for i in odd.tolist()]
        if len(odd):
            texts = pc.if_else(pa.array(np.isin(np.arange(len(texts)), odd)), pa.scalar("", pa.large_string()), texts)
        split = pc.split_pattern(texts, " ")
        begins = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        pieces = split.flatten().dictionary_encode()
        at = pieces.indices.to_numpy().astype(np.int64)
        at[begins[odd]] = len(pieces.dictionary) + np.arange(len(odd))  # an empty text is one empty piece
        codes = ["".join(self.encode_plain(piece)) for piece in pieces.dictionary.to_pylist()] + whole
        size = np.fromiter(map(len, codes), np.int64, len(codes))
        first, size = (np.cumsum(size) - size)[at], size[at]
        ends = np.concatenate(([0], np.cumsum(size)))
        return _numbers("".join(codes))[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])], ends[begins]

    def _around_special(self, text: str) -> list[str]:
        out, at = [], 0
        for found in self.cut.finditer(text):
            out += self.encode_plain(text[at : found.start()])
            out.append(chr(self.special[found[0]]))
            at = found.end()
        return out + self.encode_plain(text[at:])

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one space, as a tokenizer without a decoder does; special tokens stay."""
        return " ".join(self.names.take(pa.array(ids, pa.int64())).to_pylist())


def _numbers(code: str) -> np.ndarray:
    """The ids that the code points of `code` stand for."""
    return np.frombuffer(code.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)


def _digests(names: pa.Array, ids: np.ndarray, begins: np.ndarray) -> pa.Array:
    """SHA-256 of the names of each list of ids, joined by one space."""
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(begins), names.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))
    return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in joined], pa.string())


def bpe_encode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids (`keep_ids`).

    The digests are of the decimal ids joined by a space, and of the decoded text in UTF-8. Null and empty texts have no ids and the
    digests of an empty string. Repeated rows and null ids stay. `spec` is the tokenizer file's text, read by the caller; the encoder
    made of it travels once to each executor, and a worker's copy and what it remembers go when a task of another kernel comes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(PrefixBpe(spec)))
    name = f"bpe {hashlib.sha256(spec.encode()).hexdigest()}"

    def digested(bpe: PrefixBpe, texts: pa.Array) -> dict:
        ids, begins = bpe.encode_all(texts)
        out = {"n_tokens": pa.array(np.diff(begins)), "ids_sha256": _digests(bpe.decimals, ids, begins), "decoded_sha256": _digests(bpe.names, ids, begins)}
        return out | ({"ids": pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids))} if keep_ids else {})

    def kernel():
        bpe = kept(name, lambda: pickle.loads(shared.value))
        return lambda texts: digested(bpe, texts)

    return map_texts(docs, kernel, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids, id_col, text_col, keep=name)
