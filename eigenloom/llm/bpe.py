"""Byte-level BPE, exact to the published vocabulary file, with a compiled lexicon of frequent words.

The lexicon is a minimal acyclic transducer: words that end alike share their states, and numbers on the
arcs add up to a word's row in a table of id sequences. It is one file, which all workers of an executor map.
Words that it lacks are merged by the vocabulary's ranks. A text's words come from a pattern whose character
classes are spelled out for code points below `SAFE_END`; texts with any other character are split by the
tokenizers library itself, so the words never depend on a Unicode version of ours.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import struct
import unicodedata
from collections.abc import Iterable
from itertools import chain

import numpy as np

SAFE_END = 0x250
_WHITE = "\\t-\\r \\x85\\xa0"


def _char_class(kind: str) -> str:
    """The code points below SAFE_END of one general category, as ranges of a character class."""
    codes = [c for c in range(SAFE_END) if unicodedata.category(chr(c))[0] == kind]
    spans: list[list[int]] = []
    for c in codes:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\u{a:04x}" if a == b else f"\\u{a:04x}-\\u{b:04x}" for a, b in spans)


_L, _N = _char_class("L"), _char_class("N")
WORDS = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_WHITE}{_L}{_N}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
UNSAFE = re.compile(f"[^\\u0000-\\u{SAFE_END - 1:04x}]")


def byte_alphabet() -> dict[str, int]:
    """The visible character that stands for each byte in a byte-level vocabulary file, and the byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and added tokens of a byte-level BPE file, given as its JSON text."""

    def __init__(self, source: str):
        self.source = source
        spec = json.loads(source)
        self.alphabet = byte_alphabet()
        as_bytes = lambda token: bytes(self.alphabet[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.tokens: dict[int, bytes] = {i: as_bytes(t) for t, i in vocab.items()}
        self.byte_id = [vocab[c] for c, _ in sorted(self.alphabet.items(), key=lambda x: x[1])]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens |= {i: t.encode() for t, i in self.added.items()}
        self.size = max(self.tokens) + 1
        self._library = self._fast = None
        self._in_order = all(new == 256 + rank for rank, new in self.pairs.values())

    def library(self):
        """The tokenizers library's own object, for texts whose characters the pattern does not spell out."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.source)
        return self._library

    def merger(self):
        """A function from a word to its ids: compiled code where ids are numbered in the order of merges, else `merge`."""
        if self._fast is None and self._in_order:
            try:
                import tiktoken
            except ModuleNotFoundError:
                return self.merge
            ranks = {t: i for i, t in self.tokens.items() if i not in self.added.values()}
            self._fast = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        return self._fast or self.merge

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank merges first, the leftmost of equals."""
        ids, pairs = [self.byte_id[b] for b in word], self.pairs
        if len(ids) > 48:
            return self._merge_long(ids)
        while len(ids) > 1:
            best, at, new = 1 << 60, -1, -1
            for i in range(len(ids) - 1):
                found = pairs.get(ids[i] << 32 | ids[i + 1])
                if found is not None and found[0] < best:
                    (best, new), at = found, i
            if at < 0:
                break
            ids[at : at + 2] = [new]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs over a linked list: n log n for a word of any length."""
        n, pairs = len(ids), self.pairs
        after, before, heap = [*range(1, n), -1], [*range(-1, n - 1)], []
        for i in range(n - 1):
            if found := pairs.get(ids[i] << 32 | ids[i + 1]):
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (found := pairs.get(ids[left] << 32 | ids[right])):
                    heapq.heappush(heap, (found[0], left, ids[left], ids[right], found[1]))
        return [x for x in ids if x >= 0]


class Lexicon:
    """A memory-mapped minimal acyclic transducer from words (bytes) to id sequences.

    Block layout, little-endian: magic, then counts of states, arcs, words and ids; first[states + 1] u32;
    label[arcs] u8 padded to 4; target[arcs] u32; output[arcs] u32; final[states] u8 padded to 4;
    start[words + 1] u32; ids[ids] u32. Arcs of a state lie together, by label.
    """

    MAGIC = b"LEXT0001"

    def __init__(self, block: bytes | mmap.mmap):
        if block[:8] != self.MAGIC:
            raise ValueError("not a lexicon block")
        states, arcs, words, _ = struct.unpack_from("<4I", block, 8)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(block, kind, n, at)
            at += -(-out.nbytes // 4) * 4
            return out

        self.first, self.label, self.target = take("<u4", states + 1), take("u1", arcs), take("<u4", arcs)
        self.output, self.final = take("<u4", arcs), take("u1", states)
        self.start, self._ids_at, self._block = take("<u4", words + 1), at, block
        source = np.repeat(np.arange(states, dtype=np.int64), np.diff(self.first.astype(np.int64)))
        self._keys = source * 256 + self.label  # ascending: arcs are stored by state, then label
        self.words, self.states = words, states

    @classmethod
    def build(cls, entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
        """Compile words (each once, in any order). States are merged as soon as no later word can change them."""
        entries = sorted(entries)
        nodes: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        known: dict[tuple, int] = {}
        below: list[int] = []  # words that each state accepts

        def close(final: bool, arcs: list[tuple[int, int]]) -> int:
            node = (final, tuple(arcs))
            if node not in known:
                known[node] = len(nodes)
                nodes.append(node)
                below.append(final + sum(below[t] for _, t in arcs))
            return known[node]

        path: list[list] = [[False, []]]  # open states along the last word
        last = b""
        for word, _ in entries:
            same = os.path.commonprefix((last, word))
            while len(path) > len(same) + 1:
                closed = close(*path.pop())
                path[-1][1].append((last[len(path) - 1], closed))
            path += [[False, []] for _ in range(len(word) - len(same))]
            path[-1][0] = True
            last = word
        while len(path) > 1:
            closed = close(*path.pop())
            path[-1][1].append((last[len(path) - 1], closed))
        root = close(*path[0])
        number = {root: 0} | {n: i + 1 for i, n in enumerate(x for x in range(len(nodes)) if x != root)}
        first, label, target, output, final = [0], [], [], [], []
        for n in sorted(number, key=number.get):
            total = int(nodes[n][0])
            for b, t in nodes[n][1]:
                label.append(b)
                target.append(number[t])
                output.append(total)
                total += below[t]
            first.append(len(label))
            final.append(nodes[n][0])
        ids = [i for _, seq in entries for i in seq]
        start = np.cumsum([0, *(len(s) for _, s in entries)])
        pad = lambda raw: raw + b"\0" * (-len(raw) % 4)
        u4 = lambda x: np.asarray(x, "<u4").tobytes()
        u1 = lambda x: pad(np.asarray(x, "u1").tobytes())
        head = cls.MAGIC + struct.pack("<4I", len(nodes), len(label), len(entries), len(ids))
        return head + u4(first) + u1(label) + u4(target) + u4(output) + u1(final) + u4(start) + u4(ids)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """Map a block's file; processes that map the same file share its pages."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Row of each word, -1 if it is not in the lexicon; all words take each step together."""
        n = len(words)
        rows = np.full(n, -1, np.int64)
        if not n or not len(self._keys):
            return rows
        size = np.fromiter(map(len, words), np.int64, n)
        offset = np.concatenate(([0], np.cumsum(size)[:-1]))
        data = np.frombuffer(b"".join(words) or b"\0", np.uint8)
        state, out, alive = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        step = 0
        while len(alive):
            done = size[alive] == step
            if done.any():
                ended = alive[done]
                ok = self.final[state[ended]] == 1
                rows[ended[ok]] = out[ended[ok]]
                alive = alive[~done]
            key = state[alive] * 256 + data[offset[alive] + step]
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            hit = self._keys[at] == key
            alive, at = alive[hit], at[hit]
            out[alive] += self.output[at]
            state[alive] = self.target[at]
            step += 1
        return rows

    def sequences(self, rows: np.ndarray) -> list[bytes]:
        """The ids of each row as little-endian 32-bit integers."""
        begin, end = self._ids_at + 4 * self.start[rows].astype(np.int64), self._ids_at + 4 * self.start[rows + 1].astype(np.int64)
        block = self._block
        return [block[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


class Encoder:
    """Encodes texts to ids as little-endian 32-bit integers.

    With a lexicon, the distinct words of a batch of texts are looked up in it together, and only the words that
    it lacks are merged. The ids of up to `memo_words` merged words are kept; beyond that they start afresh.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, memo_words: int = 300_000):
        self.vocabulary, self.lexicon, self.memo_words = vocabulary, lexicon, memo_words
        self.memo: dict[str, bytes] = {}
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.added, key=len, reverse=True)))) if vocabulary.added else None
        self.asked = self.found = self.merged = 0

    def split(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        if text.isascii() or not UNSAFE.search(text):
            return WORDS.findall(text)
        spans = [s for _, s in self.vocabulary.library().pre_tokenizer.pre_tokenize_str(text)]
        return [text[a:b] for a, b in spans]

    def learn(self, words: Iterable[str]) -> None:
        """Merge those of the words that the memo lacks."""
        new = [w for w in set(words) if w not in self.memo]
        if len(self.memo) + len(new) > self.memo_words:
            self.memo.clear()
            new = list(set(words))
        memo, merge, pack = self.memo, self.vocabulary.merger(), struct.pack
        for w in new:
            ids = merge(w.encode())
            memo[w] = pack(f"<{len(ids)}I", *ids)
        self.merged += len(new)

    def look_up(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each distinct word: from the lexicon where it has the word, else merged."""
        distinct = list(dict.fromkeys(words))
        rows = self.lexicon.find([w.encode() for w in distinct])
        held = np.flatnonzero(rows >= 0)
        out = dict(zip([distinct[i] for i in held.tolist()], self.lexicon.sequences(rows[held]), strict=True))
        rare = [w for w in distinct if w not in out]
        self.learn(rare)
        out.update((w, self.memo[w]) for w in rare)
        self.asked, self.found = self.asked + len(distinct), self.found + len(held)
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text, by the lexicon."""
        cut = [self._cut(t) for t in texts]
        ids = self.look_up(chain.from_iterable(part for parts in cut for part in parts if not isinstance(part, bytes)))
        return [b"".join(chain.from_iterable((part,) if isinstance(part, bytes) else map(ids.__getitem__, part) for part in parts)) for parts in cut]

    def _cut(self, text: str) -> list[list[str] | bytes]:
        """Words of the stretches between added tokens, and the added tokens' ids."""
        if self.special is None or not (m := self.special.search(text)):
            return [self.split(text)]
        out, at = [], 0
        while m:
            out += [self.split(text[at : m.start()]), struct.pack("<I", self.vocabulary.added[m[0]])]
            at = m.end()
            m = self.special.search(text, at)
        return [*out, self.split(text[at:])]

    def _plain(self, text: str) -> bytes:
        return self._words(self.split(text))

    def _words(self, words: list[str]) -> bytes:
        try:
            return b"".join(map(self.memo.__getitem__, words))
        except KeyError:
            self.learn(words)
            return b"".join(map(self.memo.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, without a lexicon; strings of added tokens become their ids, as in the library."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return b"".join(part if isinstance(part, bytes) else self._words(part) for part in self._cut(text))


_made: dict[tuple[int, str | None], Encoder] = {}


def worker_encoder(source: str, lexicon: str | None = None) -> Encoder:
    """The encoder of this Python worker; made once for a vocabulary and the path of a lexicon."""
    key = (hash(source), lexicon)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(Vocabulary(source), Lexicon.mapped(lexicon) if lexicon else None)
    return _made[key]
