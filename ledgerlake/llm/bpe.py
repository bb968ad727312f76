"""BPE encoding and decoding by a tokenization automaton.

The automaton is compiled from the merge list by one gadget per merge, in rank
order.  Its states are "the last token emitted" (and a start state); its arcs
are labelled with tokens.  An arc t1 -> t2 exists unless some merge would have
joined a part at the right edge of t1 with a part at the left edge of t2 before
either part was used up inside its own token.  So the gadget of a merge
(u, v) -> w does two things:

* it opens the state of w, whose right edge is v's and whose left edge is u's,
  with the new part w alive from this rank on, and
* it ends the life of v at w's right edge and of u at w's left edge, which
  closes, from this rank on, the arcs that those parts would have blocked.

Tokens whose right edges block the same arcs are one state, tokens whose left
edges are blocked by the same states are one label, and the arcs between them
are a table of bits, filled once on the driver (some 20 MB for 49,000 tokens)
and broadcast with the arcs of the trie that spells the tokens.

Every string of base symbols has exactly one accepted path, and that path is
its BPE encoding.  A prefix of a word has a path of its own, so one state
stands at each position: words are encoded by stepping through the tables, all
words of a batch together, position after position.  Decoding emits the labels
of the arcs.

Only the pre-split (normalizer, word pattern) is taken from the tokenizer's own
definition: as tables of the characters under U+0300, read from the library on
the driver, and from the library itself for chunks with any other character.
"""

from __future__ import annotations

import hashlib
import json
import os
import pickle
import re
import subprocess
import sys
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import ASCII_SPACE, bytes_of, named, runs_of, slices, values_of

NEVER = 1 << 60
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Text that a worker encodes at a time; a longer text is taken by itself.
SLICE_ROWS, SLICE_BYTES = 4_000, 2 << 20
#: Symbols that the automaton steps through together; a longer word is taken by itself.
BLOCK = 1 << 18
#: Characters that the pre-split tables cover.
TABLED = 0x300

#: White space of the tokenizer's patterns beyond ASCII, as UTF-8 (fixed values).
WIDE_SPACE = [c.encode() for c in "\x85\xa0                　"]
_SPACE2 = np.array([int.from_bytes(c) for c in WIDE_SPACE if len(c) == 2])
_SPACE3 = np.array([int.from_bytes(c) for c in WIDE_SPACE if len(c) == 3])
LETTER, DIGIT, OTHER, UNSAFE = range(4)


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], extra = chr(0x100 + extra), extra + 1
    return out


# --- the automaton --------------------------------------------------------------------------


class Part(NamedTuple):
    """A token at the edge of another one, alive for ranks in (born, used)."""

    token: int
    born: int
    used: int


class _Gadgets:
    """The states made merge by merge, with the parts at their edges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], alphabet: list[str], end_mark: str | None):
        symbol = {c: k for k, c in enumerate(alphabet)}
        made = {u + v for u, v in merges}
        self.spelled: dict[int, tuple[int, ...]] = {}
        for label, i in vocab.items():
            if label in symbol:
                self.spelled[i] = (symbol[label],)
            elif end_mark and label.endswith(end_mark) and label[: -len(end_mark)] in symbol and label not in made:
                self.spelled[i] = (symbol[label[: -len(end_mark)]], len(alphabet))
        self.rank: dict[tuple[int, int], int] = {}
        self.right = {i: (Part(i, -1, NEVER),) for i in self.spelled}
        self.left = dict(self.right)
        for rank, (u, v) in enumerate(merges):
            self._gadget(vocab[u], vocab[v], vocab[u + v], rank)

    def _gadget(self, u: int, v: int, w: int, rank: int) -> None:
        self.rank.setdefault((u, v), rank)
        if w in self.right or u not in self.right or v not in self.right or not self._open(u, v, rank):
            return  # w has its state already, or u and v are never neighbours at this rank
        self.spelled[w] = self.spelled[u] + self.spelled[v]
        new = Part(w, rank, NEVER)
        self.right[w] = (*self.right[v][:-1], self.right[v][-1]._replace(used=rank), new)
        self.left[w] = (*self.left[u][:-1], self.left[u][-1]._replace(used=rank), new)

    def _open(self, t1: int, t2: int, before: int) -> bool:
        """Whether no merge ranked under ``before`` joins the facing edges of t1 and t2."""
        for a in self.right[t1]:
            for b in self.left[t2]:
                m = self.rank.get((a.token, b.token), NEVER)
                # On a tie the leftmost pair goes first: inside t1 that is t1's own merge, inside t2 it is this one.
                if m < before and a.born < m < a.used and b.born < m <= b.used:
                    return False
        return True


def _classes(edges: dict[int, tuple[Part, ...]], ranks: dict[int, list[int]], alive: Callable[[list[int], int], int], size: int) -> tuple[np.ndarray, int, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Each token's class; their number; for each part the classes that have it and how many of its merges find it alive there."""
    numbers: dict[tuple, int] = {}
    of = np.zeros(size, np.int32)
    for token, parts in edges.items():
        blocks = tuple((p.token, k) for p in parts if (k := alive(ranks.get(p.token, []), p.used)))
        of[token] = numbers.setdefault(blocks, len(numbers))
    members: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for blocks, number in numbers.items():
        for part, k in blocks:
            members[part].append((number, k))
    return of, len(numbers), {part: tuple(np.array(m).T) for part, m in members.items()}


class Automaton:
    """Compiled from ``vocab`` (label -> id) and ``merges`` (pairs of labels, best first), as arrays only.

    Words are sequences of symbol numbers, ``alphabet`` giving each symbol's
    label; with an ``end_mark`` the number ``len(alphabet)`` closes each word.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], alphabet: list[str], end_mark: str | None = None):
        made, size = _Gadgets(vocab, merges, alphabet, end_mark), max(vocab.values(), default=-1) + 1
        self.width = len(alphabet) + 1
        # Merges that come before one of their parts is there never apply.
        born = {t: parts[-1].born for t, parts in made.right.items()}
        rank = {(u, v): m for (u, v), m in made.rank.items() if u in born and v in born and m > max(born[u], born[v])}
        as_left, as_right = defaultdict(list), defaultdict(list)
        for (u, v), m in sorted(rank.items(), key=lambda x: x[1]):
            as_left[u].append(m)
            as_right[v].append(m)
        self.state, n_states, on_right = _classes(made.right, as_left, bisect_left, size)
        self.label, n_labels, on_left = _classes(made.left, as_right, bisect_right, size)
        self.closed = np.zeros((n_states, -(-n_labels // 8)), np.uint8)
        for (u, v), m in rank.items():
            if u in on_right and v in on_left:
                states, labels = on_right[u], on_left[v]
                mask = np.zeros(n_labels, bool)
                mask[labels[0][labels[1] > bisect_left(as_right[v], m)]] = True
                self.closed[states[0][states[1] > bisect_left(as_left[u], m)]] |= np.packbits(mask, bitorder="little")
        self._spell(made.spelled)

    def _spell(self, spelled: dict[int, tuple[int, ...]]) -> None:
        """The trie of all tokens' symbols, its arcs in one open-addressed table."""
        arcs: dict[int, int] = {}
        ends = [-1]
        for token, symbols in spelled.items():
            node = 0
            for s in symbols:
                key = node * self.width + s
                if key not in arcs:
                    arcs[key] = len(ends)
                    ends.append(-1)
                node = arcs[key]
            ends[node] = token
        self.ends = np.array(ends, np.int32)
        self.bits = max(4, (2 * len(arcs)).bit_length())
        self.keys, self.next = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        key, node = np.array(list(arcs), np.int64), np.array(list(arcs.values()), np.int32)
        at = self._slot(key)
        while len(key):
            free = self.keys[at] < 0
            first = np.zeros(len(key), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = np.flatnonzero(free & first)
            self.keys[at[put]], self.next[at[put]] = key[put], node[put]
            rest = self.keys[at] != key
            key, node, at = key[rest], node[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The trie's nodes after ``symbol`` (-1: none)."""
        key = node.astype(np.int64) * self.width + symbol
        at = self._slot(key)
        seen = self.keys[at]
        out = np.where(seen == key, self.next[at], -1)
        ask = np.flatnonzero((seen != key) & (seen >= 0))
        key, at = key[ask], at[ask]
        while len(ask):
            at = (at + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at]
            hit = seen == key
            out[ask[hit]] = self.next[at[hit]]
            on = ~hit & (seen >= 0)
            ask, key, at = ask[on], key[on], at[on]
        return out

    def encode(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words, and where each word's tokens start (one more than words); ``starts`` cuts ``symbols`` likewise."""
        parts, lo = [(np.zeros(0, np.int32), np.zeros(1, np.int64))], 0
        while lo < len(starts) - 1:
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + BLOCK, "right")) - 1)
            parts.append(self._encode_block(symbols[starts[lo] : starts[hi]], (starts[lo : hi + 1] - starts[lo]).astype(np.int32)))
            lo = hi
        ends = np.cumsum([0, *(len(ids) for ids, _ in parts)])
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([[0], *(cut[1:] + end for (_, cut), end in zip(parts, ends[:-1], strict=True))])

    def _encode_block(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, size = len(starts) - 1, np.diff(starts)
        first, stop = np.repeat(starts[:-1], size), np.repeat(starts[1:], size)
        # All tokens that stand anywhere in a word, by their length.
        at, node = np.arange(len(symbols), dtype=np.int32), np.zeros(len(symbols), np.int32)
        begins, ends, tokens, depth = [], [], [], 0
        while len(at):
            node = self._step(node, symbols[at + depth])
            depth += 1
            on = node >= 0
            at, node = at[on], node[on]
            token = self.ends[node]
            hit = token >= 0
            begins.append(at[hit])
            ends.append(at[hit] + depth)
            tokens.append(token[hit])
            on = at + depth < stop[at]
            at, node = at[on], node[on]
        begin, end, token = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, ends, tokens))
        # One state stands at each position: the last token of the path that the prefix up to there has.
        place = end - first[begin]
        if len(place) and place.max() < 1 << 15:
            place = place.astype(np.int16)
        order = np.argsort(place, kind="stable")
        begin, end, token, place = begin[order], end[order], token[order], place[order]
        last, back = np.full(len(symbols) + 1, -1, np.int32), np.zeros(len(symbols) + 1, np.int32)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(place)]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            b, e, t = begin[lo:hi], end[lo:hi], token[lo:hi]
            state, label = last[b], self.label[t]
            shut = (self.closed[self.state[state], label >> 3] >> (label & 7).astype(np.uint8)) & 1
            go = (b == first[b]) | ((state >= 0) & (shut == 0))
            last[e[go]], back[e[go]] = t[go], b[go]
        # Back along the paths.
        at, word = starts[1:].copy(), np.arange(words)
        count, steps = np.zeros(words, np.int64), []
        while len(word):
            t = last[at]
            if (t < 0).any():
                raise ValueError("a symbol is not in the vocabulary")
            steps.append((word, t))
            count[word] += 1
            at = back[at]
            on = at > starts[word]
            word, at = word[on], at[on]
        cut = np.concatenate(([0], np.cumsum(count)))
        out = np.zeros(cut[-1], np.int32)
        for k, (word, t) in enumerate(steps):
            out[cut[word + 1] - 1 - k] = t
        return out, cut


# --- texts ----------------------------------------------------------------------------------


def _lists(cut: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), values)


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs between white space of all ``texts``, and where each text's runs start."""
    data, cut = bytes_of(texts.fill_null("").cast(pa.string()))
    space = ASCII_SPACE[data]
    lead = np.flatnonzero(data[:-1] == 0xC2)
    lead = lead[np.isin((data[lead].astype(np.int64) << 8) | data[lead + 1], _SPACE2)]
    space[lead] = space[lead + 1] = True
    lead = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
    lead = lead[np.isin((data[lead].astype(np.int64) << 16) | (data[lead + 1].astype(np.int64) << 8) | data[lead + 2], _SPACE3)]
    for k in range(3):
        space[lead + k] = True
    return runs_of(data, cut, space, pa.string())


class Encoded(NamedTuple):
    """Token ids of all texts, where each text's ids start, and the decoded texts."""

    ids: np.ndarray
    cut: np.ndarray
    decoded: pa.Array


class Codec:
    """Encodes and decodes whole texts; ``from_file`` reads a tokenizer's definition.

    Built for tokenizers whose normalizer is NFC and lower case, whose
    pre-tokenizer keeps the matches of a pattern that never spans white space,
    and whose words end in a mark; others are refused.
    """

    PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, spec: dict):
        model, steps = spec["model"], [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or (split["type"], split["behavior"], split["invert"], byte_level["type"]) != ("Split", "Removed", True, "ByteLevel") or split["pattern"].get("Regex") != self.PATTERN or spec["decoder"] or spec["post_processor"] or model["dropout"] or model["ignore_merges"]:
            raise ValueError("this codec handles lower-casing, word-end BPE without a decoder only")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, byte_symbols(), model["end_of_word_suffix"])
        labels = {i: label for label, i in model["vocab"].items()} | {i: label for label, i in self.special.items()}
        self.labels = pa.array([labels.get(i, "") for i in range(max(labels) + 1)], pa.string())
        #: The pre-split alone, for the characters that are not in the tables.
        self.rules = json.dumps({"version": "1.0", "added_tokens": [], "normalizer": spec["normalizer"], "pre_tokenizer": spec["pre_tokenizer"], "model": {"type": "BPE", "vocab": {}, "merges": []}})
        self._tables()

    @classmethod
    def from_file(cls, path: str) -> Codec:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "library"}

    def _library(self):
        if "library" not in self.__dict__:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.rules)
        return self.library

    def _tables(self) -> None:
        """Lower case and kind of each character under TABLED; UNSAFE where normalizing gives anything but one such character."""
        library = self._library()
        self.lower, self.kind = np.zeros(TABLED, np.uint16), np.full(TABLED, UNSAFE, np.uint8)
        for c in range(TABLED):
            low = library.normalizer.normalize_str(chr(c))
            if len(low) == 1 and ord(low) < 0x800 and low != " ":
                cut = library.pre_tokenizer.pre_tokenize_str
                joined, twice = len(cut("a" + low + "a")) == 1, len(cut(low + low))
                self.lower[c], self.kind[c] = ord(low), LETTER if joined else DIGIT if twice == 2 else OTHER

    def _words(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of chunks all of whose characters are in the tables: their bytes, where each word starts, and where each chunk's words start."""
        data, cut = bytes_of(chunks)
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        begin = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[cut]
        low, kind = self.lower[chars], self.kind[chars]
        fresh = kind == DIGIT
        fresh[1:] |= kind[1:] != kind[:-1]
        fresh[begin[:-1]] = True
        # An apostrophe that starts a run takes s, t, m, d, re, ve or ll with it.
        at = np.flatnonzero((low == ord("'")) & fresh)
        stop = begin[np.searchsorted(begin, at, "right")]
        one = np.where(at + 1 < stop, low[np.minimum(at + 1, len(low) - 1)], 0)
        two = np.where(at + 2 < stop, low[np.minimum(at + 2, len(low) - 1)], 0)
        takes = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for pair in ("re", "ve", "ll"):
            takes[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
        at, stop, takes = at[takes > 0], stop[takes > 0], takes[takes > 0]
        fresh[at + 1] = False
        after = at + 1 + takes
        fresh[after[after < stop]] = True
        starts = np.flatnonzero(fresh)
        # UTF-8 of one or two bytes.
        wide = low >= 0x80
        to = np.arange(len(low)) + np.concatenate(([0], np.cumsum(wide)))[:-1].astype(np.int64)
        out = np.zeros(len(low) + int(wide.sum()), np.uint8)
        out[to] = np.where(wide, 0xC0 | (low >> 6), low)
        out[to[wide] + 1] = 0x80 | (low[wide] & 0x3F)
        return out, np.append(to[starts], len(out)), np.searchsorted(starts, begin)

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, cut = bytes_of(words)
        n, size = len(words), np.diff(cut)
        symbols = np.full(len(data) + n, 256, np.int16)
        symbols[np.arange(len(data)) + np.repeat(np.arange(n), size)] = data
        return self.automaton.encode(symbols, cut + np.arange(n + 1))

    def _by_library(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of chunks with special strings or characters beyond the tables."""
        library, cut = self._library(), re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        byte = {c: b for b, c in enumerate(byte_symbols())}
        words: dict[bytes, int] = {}
        rows: list[list[int]] = []  # of each chunk: the numbers of its words, special ids as -1 - id
        for chunk in chunks:
            row: list[int] = []
            for part in cut.split(chunk) if cut else (chunk,):
                if part in self.special:
                    row.append(-1 - self.special[part])
                elif part:
                    for word, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part)):
                        row.append(words.setdefault(bytes([byte[c] for c in word]), len(words)))
            rows.append(row)
        ids, at = self._encode_words(pa.array(list(words), pa.binary()))
        return [np.concatenate([ids[at[w] : at[w + 1]] if w >= 0 else np.array([-1 - w], np.int32) for w in row]) if row else np.zeros(0, np.int32) for row in rows]

    def _encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different chunks, and where each chunk's ids start."""
        data, cut = bytes_of(chunks)
        # UTF-8 under U+0300 has lead bytes up to 0xCB; of those characters few are not in the tables.
        odd = np.logical_or.reduceat(data >= 0xCC, cut[:-1])
        for text in [*self.special, *(chr(c) for c in np.flatnonzero(self.kind == UNSAFE) if c > 0x20)]:
            odd |= pc.match_substring(chunks, text).to_numpy(zero_copy_only=False)
        plain = chunks.filter(pa.array(~odd))
        if len(plain):
            pieces, at, of = self._words(plain)
            words = values_of(pieces, at, pa.binary()).dictionary_encode()
            ids, starts = self._encode_words(words.dictionary)
            taken = _lists(starts, pa.array(ids)).take(words.indices)
            ids, starts = taken.flatten().to_numpy(), np.asarray(taken.offsets)[of]
        else:
            ids, starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        if not odd.any():
            return ids, starts
        rest = self._by_library(chunks.filter(pa.array(odd)).to_pylist())
        size = np.zeros(len(chunks), np.int64)
        size[~odd], size[odd] = np.diff(starts), [len(x) for x in rest]
        both = np.concatenate((ids, *rest))
        begin = np.zeros(len(chunks), np.int64)
        begin[~odd], begin[odd] = starts[:-1], len(ids) + np.cumsum([0, *map(len, rest[:-1])])
        cut = np.concatenate(([0], np.cumsum(size)))
        return both[np.arange(cut[-1]) + np.repeat(begin - cut[:-1], size)], cut

    def encode(self, texts: pa.Array) -> Encoded:
        """Each different chunk of the batch is encoded and decoded once; texts are put together from them."""
        chunks, of = chunks_of(texts)
        if not len(chunks):
            return Encoded(np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), pa.array([""] * len(texts), pa.string()))
        coded = chunks.dictionary_encode()
        ids, cut = self._encode_chunks(coded.dictionary)
        taken = _lists(cut, pa.array(ids)).take(coded.indices)
        shown = pc.binary_join(_lists(cut, self.labels.take(pa.array(ids))), " ").take(coded.indices)
        # A chunk without tokens adds no space either.
        full = np.asarray(pc.binary_length(shown)) > 0
        if not full.all():
            shown, of = shown.filter(pa.array(full)), np.concatenate(([0], np.cumsum(full)))[of]
            taken = taken.filter(pa.array(full))
        return Encoded(taken.flatten().to_numpy(), np.asarray(taken.offsets)[of], pc.binary_join(_lists(of, shown), " "))


_codecs: dict[str, Codec] = {}


#: What a process of its own runs, so that the driver keeps the tables and not what compiling them took.
COMPILE = "import pickle, sys; from ledgerlake.llm.bpe import Codec; sys.stdout.buffer.write(pickle.dumps(Codec.from_file(sys.argv[1])))"


def codec(path: str) -> Codec:
    """The compiled codec of a file; it is compiled once, beside the driver, which broadcasts it."""
    if path not in _codecs:
        env = os.environ | {"PYTHONPATH": os.pathsep.join([str(Path(__file__).resolve().parents[2]), os.environ.get("PYTHONPATH", "")])}
        _codecs[path] = pickle.loads(subprocess.run([sys.executable, "-c", COMPILE, path], env=env, check=True, stdout=subprocess.PIPE).stdout)
    return _codecs[path]


def encode(docs: DataFrame, model_path: str, *, text: str = "text") -> DataFrame:
    """``docs`` with the columns ids array<int> and decoded string in place of any of these names.

    Null or empty text: no ids and an empty string.  Every other column and
    every row, repeated ones too, stays as it is.
    """
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    rows = docs.select(F.struct(*named(kept)).alias("row") if kept else F.lit(1).alias("row"), *named([text], ["t"]))
    shared = docs.sparkSession.sparkContext.broadcast(codec(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_ROWS, SLICE_BYTES, 1):
            got = shared.value.encode(batch.column(1))
            ids = pa.ListArray.from_arrays(pa.array(got.cut, pa.int32()), pa.array(got.ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, got.decoded], names=["row", "ids", "decoded"])

    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kind}, ids array<int>, decoded string")
    return out.select(*([F.col("row")[c].alias(c) for c in kept]), "ids", "decoded")


def digests(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row; hashed where the text is encoded, so no ids travel."""
    shared = docs.sparkSession.sparkContext.broadcast(codec(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_ROWS, SLICE_BYTES, 1):
            got = shared.value.encode(batch.column(1))
            ids = got.ids.astype("<u4").view(np.uint8)
            a = [hashlib.sha256(ids[4 * i : 4 * j]).hexdigest() for i, j in zip(got.cut[:-1].tolist(), got.cut[1:].tolist(), strict=True)]
            b = [hashlib.sha256(x.as_buffer()).hexdigest() for x in got.decoded.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(got.cut), pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(*named([id_col, text], ["id", "t"]))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
