"""Byte-level BPE over whole columns: vectorised splitting into pieces, and a prefix dynamic program that counts tokens.

A byte-level BPE first cuts a text into pieces (contractions, words, numbers, signs, white space) and encodes each on its own,
so a text's tokens are those of its pieces in order, and equal pieces need encoding once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
LETTER, NUMBER, SPACE, OTHER = range(4)
#: Code points with the Unicode property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """A file's place; a name without a slash is one of the public tokenizers installed on every node."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(None)
def char_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        major = unicodedata.category(chr(cp))[0]
        if major == "L":
            out[cp] = LETTER
        elif major == "N":
            out[cp] = NUMBER
    out[list(WHITE_SPACE)] = SPACE
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = char_classes()
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead]
        size = 2 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        cp = (first & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))).astype(np.int64)
        for k in (1, 2, 3):
            here = size > k
            cp[here] = cp[here] << 6 | (data[lead[here] + k] & 0x3F)
        kind = table[cp]
        for k in range(4):
            here = size > k
            out[lead[here] + k] = kind[here]
    return out


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte positions where pieces start, in concatenated texts; no piece crosses one of the bounds (the texts' own starts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= edge[:n]
    # The last character of white space before a text goes alone, or with what follows if it is a blank.
    ends = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n])
    wide = data[ends] >= 0x80
    lead = ends - np.where(wide, np.where(data[ends - 1] >= 0xC0, 1, 2), 0)
    start[lead] = True
    start[ends[data[ends] == 0x20] + 1] = False
    # 's 't 'm 'd 're 've 'll at a piece's start are pieces of their own.
    marks = np.flatnonzero((data == 0x27) & start)
    if len(marks):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        inside = np.concatenate([~edge[:n], np.zeros(2, bool)])
        a, b = padded[marks + 1], padded[marks + 2]
        one = inside[marks + 1] & np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = inside[marks + 1] & inside[marks + 2] & (((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C))
        start[marks[one | two] + 1] = False
        after = np.concatenate([marks[one] + 2, marks[two] + 3])
        start[after[after < n]] = True
    return np.flatnonzero(start)


class Vocabulary:
    """The tokens of a byte-level BPE file as bytes; a merged token's id is also its rank."""

    def __init__(self, name: str = DEFAULT_TOKENIZER) -> None:
        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.ids = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token.encode() not in self.special}
        #: By rank: the two tokens that a merge joins, and what they give.
        pairs = (x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"])
        self.parts = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in pairs}
        self.merge = {pair: i for i, pair in self.parts.items()}
        self.longest = max(map(len, self.ids))
        self.special_pattern = re.compile(b"|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) or rb"(?!)")


class PrefixCounter:
    """Exact token count at every byte prefix of a piece.

    The encoding of a prefix is the encoding of a shorter prefix plus one token: the token ends at the prefix's end and, merged
    with the shorter prefix's last token, stays apart. Exactly one token fits, so each prefix needs its count and last token only.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.token_of = {i: t for t, i in vocabulary.ids.items()}
        self.apart: dict[tuple[int, int], bool] = {}

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens are what merging their joint bytes gives.

        Seen backwards in time: the later of the two merges is undone, and the two tokens that then touch must not have
        merged with each other earlier than that. Of equal merges the left one comes first.
        """
        merge, parts = self.vocabulary.merge, self.vocabulary.parts
        before = 1 << 40
        while merge.get((left, right), 1 << 40) >= before:
            if left > right and left in parts:
                before, left = left, parts[left][1]
            elif right in parts:
                before, right = right + 1, parts[right][0]
            elif left in parts:
                before, left = left, parts[left][1]
            else:
                return True
        return False

    def table(self, word: bytes, count: list[int] | None = None, last: list[int] | None = None) -> tuple[list[int], list[int]]:
        """(count, last token) for each prefix, the empty one first. Lists that are given hold a shorter prefix's and go on from there."""
        ids, longest, apart = self.vocabulary.ids, self.vocabulary.longest, self.apart
        if len(apart) > 1_000_000:
            apart.clear()
        if count is None:
            count, last = [0], [-1]
        for end in range(len(count), len(word) + 1):
            for begin in range(max(0, end - longest), end):
                token = ids.get(word[begin:end])
                if token is not None:
                    if not begin:
                        break
                    fits = apart.get((last[begin], token))
                    if fits is None:
                        fits = apart[last[begin], token] = self.stay_apart(last[begin], token)
                    if fits:
                        break
            count.append(count[begin] + 1)
            last.append(token)
        return count, last

    def counts(self, words: list[bytes]) -> list[int]:
        """Each word's count. Taken in order, a word goes on from the prefix that it shares with the one before."""
        out, before, count, last = {}, b"", [0], [-1]
        for word in sorted(words):
            same = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                same += 1
            del count[same + 1 :], last[same + 1 :]
            self.table(word, count, last)
            out[word], before = count[-1], word
        return [out[w] for w in words]

    def encode(self, word: bytes) -> list[int]:
        _, last = self.table(word)
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= len(self.token_of[last[at]])
        return out[::-1]


class Pieces:
    """The pieces of some concatenated texts: each piece's place in a list of the different ones, and the texts' bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> None:
        bounds, inside = offsets, []
        if vocabulary.special and vocabulary.special_pattern.search(data):
            raw = data.tobytes()
            found = [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in vocabulary.special_pattern.finditer(raw, a, b)]
            bounds = np.unique(np.concatenate([offsets, np.array(found, np.int64).ravel()]))
            inside = found
        self.starts = piece_starts(data, bounds)
        if inside:
            drop = np.zeros(len(data) + 1, bool)
            for a, b in inside:
                drop[a + 1 : b] = True
            self.starts = self.starts[~drop[self.starts]]
        ends = np.append(self.starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = words.dictionary_encode()
        self.index = coded.indices.to_numpy()
        _, at, raw = coded.dictionary.buffers()
        at, raw = np.frombuffer(at, np.int32)[: len(coded.dictionary) + 1].tolist(), raw.to_pybytes() if raw else b""
        self.words: list[bytes] = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.text_bounds = np.searchsorted(self.starts, offsets)  # of text i: pieces from [i] to [i + 1]


class WordCache:
    """What `of` gives for a word, for each different word once; forgets all beyond `limit` words or `limit_bytes` of their bytes."""

    def __init__(self, of: Callable[[list[bytes]], list], limit: int = 400_000, limit_bytes: int = 16 << 20) -> None:
        self.of, self.limit, self.limit_bytes, self.size, self.known = of, limit, limit_bytes, 0, {}

    def get(self, words: list[bytes]) -> list:
        if len(self.known) > self.limit or self.size > self.limit_bytes:
            self.known.clear()
            self.size = 0
        known = self.known
        new = [w for w in words if w not in known]
        known.update(zip(new, self.of(new), strict=True))
        self.size += sum(map(len, new))
        return [known[w] for w in words]


@lru_cache(4)
def vocabulary(name: str = DEFAULT_TOKENIZER) -> Vocabulary:
    return Vocabulary(name)


@lru_cache(4)
def counter(name: str = DEFAULT_TOKENIZER) -> PrefixCounter:
    return PrefixCounter(vocabulary(name))


@lru_cache(4)
def count_cache(name: str = DEFAULT_TOKENIZER) -> WordCache:
    """Token counts by the prefix program; kept by each Python worker between its tasks."""
    own = counter(name)
    special = own.vocabulary.special

    def of(words: list[bytes]) -> list[int]:
        return [1 if w in special else n for w, n in zip(words, own.counts(words), strict=True)]

    return WordCache(of)


@lru_cache(4)
def id_cache(name: str = DEFAULT_TOKENIZER) -> WordCache:
    """Unsigned 32-bit ids of a word, as bytes in this machine's (little-endian) order."""
    import tiktoken

    known = vocabulary(name)
    encode = tiktoken.Encoding(name, pat_str=r"(?s:.+)", mergeable_ranks=known.ids, special_tokens={}).encode_ordinary
    return WordCache(lambda words: [array("I", [known.special[w]] if w in known.special else encode(w.decode())).tobytes() for w in words])
