"""Byte-level BPE encoding by speculation and verification, and decoding.

A text is cut into words as the tokenizer cuts it. For each distinct word of a batch:

1. Speculate: from the left, the longest token that the rest of the word starts with, by a trie.
2. Verify: a sequence of tokens is the one that merging gives if each pair of neighbours is what merging
   gives for the two of them together. Whether a pair is compatible follows from undoing its merges, the
   latest first: at no time may the pair at the border have a merge that comes before those still done.
   All distinct pairs of a batch are tested at once.
3. Words with a failing pair are merged exactly, lowest rank first, all words of a batch at once.

Words, tokens and pairs are numpy arrays; only words of more than ``SHORT`` bytes are taken one by one, in
time n log n. Nothing is kept from batch to batch. A text of any length is taken in parts of about
``PART`` characters, cut where a word ends whatever follows; only a text without any such place, as one
endless word, is taken whole, with memory in proportion to it.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.common import table, texts

TOKENIZER = "byte_bpe_50k.json"
#: Characters that are taken at a time.
PART = 1 << 20
#: Bytes of a word up to which it is encoded together with the others.
SHORT = 64
NONE = np.int64(2**62)
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
#: A place where a word ends, whatever comes before and after.
_BREAK = re.compile(r"(?<=[A-Za-z0-9.,;:!?])[ \n]")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + at): b for at, b in enumerate(rest)}


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class _Lookup:
    """Values of distinct keys, none negative, in a table with open places: a key stands at its hash or after it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int) -> None:
        bits = max(4, int(len(keys) * 4).bit_length())
        self._shift, self._mask, self._missing = np.uint64(64 - bits), (1 << bits) - 1, missing
        self._keys = np.full(1 << bits, -1, np.int64)
        self._values = np.full(1 << bits, missing, np.int64)
        at = self._place(keys)
        while len(keys):
            free = self._keys[at] < 0
            self._keys[at[free]] = keys[free]  # of several at one place the last stays
            stays = self._keys[at] == keys
            self._values[at[stays]] = values[stays]
            keys, values, at = keys[~stays], values[~stays], (at[~stays] + 1) & self._mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        there = self._keys[at]
        found = np.where(there == keys, self._values[at], self._missing)
        later = np.flatnonzero((there != keys) & (there >= 0))
        while len(later):
            at[later] = (at[later] + 1) & self._mask
            there, wanted = self._keys[at[later]], keys[later]
            same = there == wanted
            found[later[same]] = self._values[at[later[same]]]
            later = later[~same & (there >= 0)]
        return found


class ByteBpe:
    """Encodes and decodes as the tokenizer in a file does, special tokens in a text included."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model, cut = parts["model"], parts["pre_tokenizer"] or {}
        odd = [
            parts["normalizer"], parts["post_processor"], model.get("dropout"), model.get("byte_fallback"),
            model.get("ignore_merges"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"),
            cut.get("type") != "ByteLevel", cut.get("add_prefix_space"), not cut.get("use_regex", True),
            (parts["decoder"] or {}).get("type") != "ByteLevel",
            any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts["added_tokens"]),
        ]
        if any(odd):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        self._path, self._cut = path, None
        letters = _byte_letters()
        self._special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        vocabulary = {token: number for token, number in model["vocab"].items() if token not in self._special}
        self.size = max([*vocabulary.values(), *self._special.values()]) + 1
        spelled = {number: bytes(letters[c] for c in token) for token, number in vocabulary.items()}
        self._ids = {raw: number for number, raw in spelled.items()}
        self._longest = max(map(len, spelled.values()))
        self._set_merges(vocabulary, model["merges"])
        self._set_trie(spelled)
        raw = [spelled.get(number, b"") for number in range(self.size)]
        for content, number in self._special.items():
            raw[number] = content.encode()
        self._raw = np.frombuffer(b"".join(raw), np.uint8)
        self._raw_length = np.asarray([len(r) for r in raw])
        self._raw_start = np.cumsum(self._raw_length) - self._raw_length
        longest_first = sorted(self._special, key=len, reverse=True)
        self._special_pattern = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        self._classes = np.full(0x110000, UNKNOWN, np.uint8)
        chance = np.random.default_rng(1)
        self._byte_values = chance.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _set_merges(self, vocabulary: dict[str, int], merges: list) -> None:
        self._left, self._right = np.arange(self.size), np.arange(self.size)
        self._rank = np.full(self.size, -1, np.int64)  # of the merge that makes a token
        keys, ranks, made = [], [], []
        ways = np.zeros(self.size, np.int64)
        for rank, pair in enumerate(merges):
            first, second = pair if isinstance(pair, list) else pair.split(" ")
            a, b, token = vocabulary[first], vocabulary[second], vocabulary[first + second]
            keys.append(a * self.size + b)
            ranks.append(rank)
            made.append(token)
            ways[token] += 1
            self._left[token], self._right[token], self._rank[token] = a, b, rank
        self._pairs = dict(zip(keys, zip(ranks, made, strict=True), strict=True))
        known = np.asarray(keys, np.int64)
        self._merge_rank = _Lookup(known, np.asarray(ranks, np.int64), NONE)
        self._merge_token = _Lookup(known, np.asarray(made, np.int64), -1)
        # Tokens that merging cannot give for their own bytes, or in more than one way, or out of parts
        # that come later, are never taken as proposed.
        parts = np.flatnonzero(self._rank >= 0)
        early = np.ones(self.size, bool)
        early[parts] = np.maximum(self._rank[self._left[parts]], self._rank[self._right[parts]]) < self._rank[parts]
        single = np.asarray([len(t) == 1 for t in sorted(vocabulary, key=vocabulary.get)])
        numbers = np.asarray(sorted(vocabulary.values()))
        self.sound = np.zeros(self.size, bool)
        self.sound[numbers] = single | (ways[numbers] == 1)
        self.sound &= early
        whole = np.flatnonzero(self.sound & (self._rank >= 0))
        self.sound[whole] = self._apart(self._left[whole], self._right[whole], np.full(len(whole), True))
        for token in whole[np.argsort(self._rank[whole])]:  # and so down to all parts of a token
            self.sound[token] &= self.sound[self._left[token]] & self.sound[self._right[token]]

    def _set_trie(self, spelled: dict[int, bytes]) -> None:
        nodes: dict[int, int] = {}
        ids = [-1]
        for number, raw in spelled.items():
            node = 0
            for byte in raw:
                key = node << 8 | byte
                child = nodes.get(key)
                if child is None:
                    child = nodes[key] = len(ids)
                    ids.append(-1)
                node = child
            ids[node] = number
        self._node_id = np.asarray(ids)
        self._step = _Lookup(
            np.fromiter(nodes.keys(), np.int64, len(nodes)), np.fromiter(nodes.values(), np.int64, len(nodes)), -1
        )
        self._root = np.asarray([nodes.get(byte, -1) for byte in range(256)])
        self._byte_ids = self._node_id[self._root]
        if (self._root < 0).any() or (self._byte_ids < 0).any():
            raise ValueError("a byte has no token")

    # --- pairs -------------------------------------------------------------------------------------

    def _apart(self, first: np.ndarray, second: np.ndarray, made: np.ndarray | None = None) -> np.ndarray:
        """Whether merging leaves the border between two sound tokens, for each pair.

        ``made``: the pairs whose merge makes the token itself; it is not held against them.
        """
        left, right = first.astype(np.int64), second.astype(np.int64)
        fine = np.ones(len(left), bool)
        limit = np.full(len(left), NONE)
        if made is not None:
            whole = self._merge_rank(left * self.size + right)
            limit = np.where(made, whole, limit)
        active = np.arange(len(left))
        while len(active):
            a, b = left[active], right[active]
            crossed = self._merge_rank(a * self.size + b) < limit[active]
            fine[active[crossed]] = False
            # Undo the later merge; of equal ones the right one, for merging goes from left to right.
            ranks_a, ranks_b = self._rank[a], self._rank[b]
            goes_on = ~crossed & (np.maximum(ranks_a, ranks_b) >= 0)
            active, a, b = active[goes_on], a[goes_on], b[goes_on]
            ranks_a, ranks_b = ranks_a[goes_on], ranks_b[goes_on]
            of_left = ranks_a > ranks_b
            # What is at the border when a merge on the right is undone was there before it, and an equal
            # merge over the border, further left, would have come first.
            limit[active] = np.where(of_left, ranks_a, ranks_b + 1)
            left[active] = np.where(of_left, self._right[a], a)
            right[active] = np.where(of_left, b, self._left[b])
        return fine

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of two tokens gives these two tokens, for each pair."""
        keys, back = np.unique(first.astype(np.int64) * self.size + second, return_inverse=True)
        a, b = keys // self.size, keys % self.size
        return (self.sound[a] & self.sound[b] & self._apart(a, b))[back]

    # --- words -------------------------------------------------------------------------------------

    def _classes_of(self, codes: np.ndarray) -> np.ndarray:
        """The class of each character; a new character's is what the tokenizer joins it with."""
        found = self._classes[codes]
        if (found == UNKNOWN).any():
            if self._cut is None:
                from tokenizers import Tokenizer

                self._cut = Tokenizer.from_file(self._path).pre_tokenizer.pre_tokenize_str
            cut = self._cut
            for code in np.unique(codes[found == UNKNOWN]).tolist():
                kinds = [kind for kind, c in ((LETTER, "a"), (NUMBER, "1"), (OTHER, ".")) if len(cut(c + chr(code))) == 1]
                self._classes[code] = kinds[0] if kinds else SPACE
            found = self._classes[codes]
        return found

    def words(self, codes: np.ndarray, opening: np.ndarray) -> np.ndarray:
        """Whether a word starts at each character. ``opening``: where a separate text starts."""
        kind = self._classes_of(codes)
        space, blank = kind == SPACE, codes == 32
        change = np.r_[True, kind[1:] != kind[:-1]] | opening
        start = change.copy()
        closing = np.r_[opening[1:], True]
        # White space before something else: its last character is apart, and a blank joins what follows.
        last = np.zeros(len(codes), bool)
        last[:-1] = space[:-1] & ~space[1:] & ~closing[:-1]
        start |= last
        joined = np.zeros(len(codes), bool)
        joined[1:] = (last & blank)[:-1]
        start &= ~joined
        # A contraction: an apostrophe at the start of a word, and what belongs to it.
        for at in np.flatnonzero((codes == 39) & start & ~closing).tolist():
            after = codes[at + 1 : at + 3].tolist()
            if len(after) == 2 and opening[at + 2]:
                after.pop()
            # s t m d; re ve ll
            if after[0] in (115, 116, 109, 100):
                end = at + 2
            elif after in ([114, 101], [118, 101], [108, 108]):
                end = at + 3
            else:
                continue
            start[at + 1] = False
            if end < len(codes):
                start[end] = True
        return start

    def _distinct(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first occurrence of each distinct word, the distinct word of each word)."""
        longest = int(length.max())
        powers = np.cumprod(np.full(longest, 0x9E3779B97F4A7C15, np.uint64))
        mixed = self._byte_values[raw] * powers[np.arange(len(raw)) - np.repeat(start, length)]
        mixed ^= mixed >> np.uint64(29)
        hashes = np.add.reduceat(mixed, start) * np.uint64(0xD6E8FEB86659FD93) + length.astype(np.uint64)
        _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        # Equal hashes are held against the bytes; a word that differs is its own.
        model = first[back]
        odd = length != length[model]
        same = np.where(odd, np.arange(len(length)), model)
        differs = raw != raw[_ragged(start[same], length)]
        odd |= np.add.reduceat(differs, start).astype(bool)
        if odd.any():
            extra = np.flatnonzero(odd)
            back[extra] = len(first) + np.arange(len(extra))
            first = np.r_[first, extra]
        return first, back

    def _proposed(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of the longest matches from the left, in order."""
        words, tokens = [], []
        active, at, end = np.arange(len(start)), start.copy(), start + length
        while len(active):
            node = self._root[raw[at]]
            best, taken = self._node_id[node], np.ones(len(active), np.int64)
            alive, depth = np.arange(len(active)), 1
            while True:
                alive = alive[at[alive] + depth < end[alive]]
                step = self._step(node[alive] << 8 | raw[at[alive] + depth])
                alive, step = alive[step >= 0], step[step >= 0]
                if not len(alive):
                    break
                node[alive] = step
                depth += 1
                found = self._node_id[step]
                whole = alive[found >= 0]
                best[whole], taken[whole] = found[found >= 0], depth
            words.append(active)
            tokens.append(best)
            at = at + taken
            left = at < end
            active, at, end = active[left], at[left], end[left]
        word, token = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def _merged(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) by merging, in order: in each round one merge in each word."""
        word = np.repeat(np.arange(len(start)), length)
        token = self._byte_ids[raw[_ragged(start, length)]]
        done_words, done_tokens = [], []
        while len(word):
            paired = np.r_[word[1:] == word[:-1], False]
            key = token * self.size + np.r_[token[1:], 0]
            rank = np.where(paired, self._merge_rank(key), NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(word)])
            ended = np.repeat(least == NONE, sizes)
            done_words.append(word[ended])
            done_tokens.append(token[ended])
            # The leftmost of the least in each word.
            hit = np.flatnonzero((rank == np.repeat(least, sizes)) & ~ended)
            hit = hit[np.r_[True, word[hit][1:] != word[hit][:-1]]] if len(hit) else hit
            token[hit] = self._merge_token(key[hit])
            stays = ~ended
            stays[hit + 1] = False
            word, token = word[stays], token[stays]
        word, token = np.concatenate(done_words), np.concatenate(done_tokens)
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def _long_proposed(self, raw: bytes) -> list[int]:
        tokens, at = [], 0
        while at < len(raw):
            for size in range(min(self._longest, len(raw) - at), 0, -1):
                found = self._ids.get(raw[at : at + size])
                if found is not None:
                    break
            tokens.append(found)
            at += size
        return tokens

    def _long_merged(self, raw: bytes) -> list[int]:
        """Merging one word with a heap of its pairs."""
        token = self._byte_ids[np.frombuffer(raw, np.uint8)].tolist()
        size, pairs = self.size, self._pairs
        after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        heap = []

        def push(at: int) -> None:
            other = after[at]
            if other < len(token):
                found = pairs.get(token[at] * size + token[other])
                if found:
                    heapq.heappush(heap, (found[0], at, token[at], token[other], found[1]))

        for at in range(len(token) - 1):
            push(at)
        while heap:
            _, at, a, b, made = heapq.heappop(heap)
            other = after[at]
            if token[at] != a or other >= len(token) or token[other] != b:
                continue
            token[at], token[other] = made, -1
            after[at] = after[other]
            if after[at] < len(token):
                before[after[at]] = at
            if before[at] >= 0:
                push(before[at])
            push(at)
        return [t for t in token if t >= 0]

    def _encoded_words(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all distinct words one after the other, number of tokens of each)."""
        short = np.flatnonzero(length <= SHORT)
        word, token = self._proposed(raw, start[short], length[short]) if len(short) else (short, short)
        word = short[word]
        spans = [(at, raw[start[at] : start[at] + length[at]].tobytes()) for at in np.flatnonzero(length > SHORT).tolist()]
        long_tokens = [self._long_proposed(span) for _, span in spans]
        if spans:
            word = np.r_[word, np.repeat([at for at, _ in spans], [len(t) for t in long_tokens])]
            token = np.r_[token, np.concatenate(long_tokens)]
        # Verify every pair of neighbours, and words of one token by that token.
        neighbours = np.flatnonzero(word[1:] == word[:-1])
        failing = np.zeros(len(start), bool)
        failing[word[~self.sound[token]]] = True
        wrong = ~self.compatible(token[neighbours], token[neighbours + 1])
        failing[word[neighbours[wrong]]] = True
        good = ~failing[word]
        words, tokens = [word[good]], [token[good]]
        again = np.flatnonzero(failing & (length <= SHORT))
        if len(again):
            redone, exact = self._merged(raw, start[again], length[again])
            words.append(again[redone])
            tokens.append(exact)
        for at, span in spans:
            if failing[at]:
                exact = self._long_merged(span)
                words.append(np.full(len(exact), at))
                tokens.append(np.asarray(exact))
        word, token = np.concatenate(words), np.concatenate(tokens)
        return token[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(start))

    # --- texts -------------------------------------------------------------------------------------

    def _segments(self, text: str) -> Iterator[str | int]:
        """Ordinary parts of a text, and the ids of special tokens between them."""
        end = 0
        if self._special_pattern:
            for match in self._special_pattern.finditer(text):
                yield text[end : match.start()]
                yield self._special[match[0]]
                end = match.end()
        yield text[end:]

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PART:
            found = _BREAK.search(text, at + PART)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def _encode_parts(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of parts that are not empty."""
        joined = "".join(parts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        places = np.flatnonzero((raw & 0xC0) != 0x80)
        sizes = np.asarray([len(p) for p in parts])
        openings = np.cumsum(sizes) - sizes
        opening = np.zeros(len(codes), bool)
        opening[openings] = True
        at = np.flatnonzero(self.words(codes, opening))
        start = places[at]
        length = np.diff(np.r_[start, len(raw)])
        first, back = self._distinct(raw, start, length)
        tokens, counts = self._encoded_words(raw, start[first], length[first])
        begins = np.cumsum(counts) - counts
        each = counts[back]
        ids = tokens[_ragged(begins[back], each)].astype(np.uint32)
        ends = np.cumsum(each)
        bounds = np.r_[0, ends][np.searchsorted(at, np.r_[openings, len(codes)])]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, texts_: Iterable[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, ids): one or more pieces for each text, in order; none for an empty one."""
        waiting: list[tuple[int, str | int]] = []
        size = 0
        for number, text in enumerate(texts_):
            for segment in self._segments(text):
                for part in [segment] if isinstance(segment, int) else self._parts(segment):
                    if part == "":
                        continue
                    waiting.append((number, part))
                    size += 1 if isinstance(part, int) else len(part)
                    if size >= PART:
                        yield from self._flushed(waiting)
                        waiting, size = [], 0
        yield from self._flushed(waiting)

    def _flushed(self, waiting: list[tuple[int, str | int]]) -> Iterator[tuple[int, np.ndarray]]:
        plain = [part for _, part in waiting if isinstance(part, str)]
        made = iter(self._encode_parts(plain) if plain else [])
        for number, part in waiting:
            yield number, next(made) if isinstance(part, str) else np.asarray([part], np.uint32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        return self._raw[_ragged(self._raw_start[ids], self._raw_length[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, special ones included; bytes that are no text become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@cache
def _tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def _gathered(tokenizer: ByteBpe, values: list[str]) -> Iterator[list[np.ndarray]]:
    """The pieces of each text, one text at a time."""
    number, pieces = 0, []
    for at, ids in tokenizer.encode(values):
        while number < at:
            yield pieces
            number, pieces = number + 1, []
        pieces.append(ids)
    while number < len(values):
        yield pieces
        number, pieces = number + 1, []


def encoded(docs: DataFrame, path: str | None = None, text_column: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text, special tokens in it included.

    A null or empty text has no ids. Texts may be of any length; the ids of one text are one array.
    Repeated rows get the same ids each; a null id stays null; an empty table gives no rows; further
    columns are ignored.
    """
    path = path or tokenizer_path()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            for part in _rows(batch):
                ids = [
                    np.concatenate([np.zeros(0, np.uint32), *own]).astype(np.int32)
                    for own in _gathered(tokenizer, list(part["text"]))
                ]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": ids})

    return texts(docs, text_column=text_column).mapInPandas(encode, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str | None = None, ids_column: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with ids; null or no ids give an empty text, and null ids in them nothing.

    Bytes that are no text become U+FFFD. An id outside the vocabulary raises IndexError.
    """
    path = path or tokenizer_path()

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            made = [tokenizer.decode(np.asarray(own, np.int64)) for own in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": made})

    given = F.filter(ids[ids_column].cast("array<long>"), lambda x: x.isNotNull())
    rows = ids.select(
        ids["doc_id"].cast("long").alias("doc_id"), F.coalesce(given, F.array().cast("array<long>")).alias("ids")
    )
    return rows.mapInPandas(decode, "doc_id long, text string")


def _rows(batch: pd.DataFrame, rows: int = 1000) -> Iterator[pd.DataFrame]:
    """The same rows, fewer at a time."""
    for first in range(0, len(batch), rows):
        yield batch.iloc[first : first + rows]


def round_trip(docs: DataFrame, path: str | None = None, text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): texts encoded, and decoded from these ids.

    Digests of the ids as little-endian unsigned 32-bit integers, and of the decoded text in UTF-8. Ids
    and texts do not leave the task, and of a long text only a part's are held at a time. Cases as in
    ``encoded``: a null or empty text has no tokens, and the digests of nothing.
    """
    path = path or tokenizer_path()

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            for part in _rows(batch):
                out, made = [], [(0, hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace"), hashlib.sha256()) for _ in range(len(part))]
                for number, ids in tokenizer.encode(part["text"]):
                    count, of_ids, decoder, of_text = made[number]
                    of_ids.update(ids.astype("<u4").tobytes())
                    of_text.update(decoder.decode(tokenizer.decode_bytes(ids)).encode())
                    made[number] = (count + len(ids), of_ids, decoder, of_text)
                for count, of_ids, decoder, of_text in made:
                    of_text.update(decoder.decode(b"", True).encode())
                    out.append((count, of_ids.hexdigest(), of_text.hexdigest()))
                found = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
                found.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy())
                yield found

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return texts(docs, text_column=text_column).mapInPandas(digests, schema)


def op13_bpe_encoding_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
