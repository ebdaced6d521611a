"""Best-fit packing of tokenized documents into sequences of a fixed length.

Documents longer than a sequence are cut; every other piece stays whole. What is packed is the histogram
of piece lengths, at most one row for each length: large lengths are put into groups of equal cardinality
and rounded up to the largest of their group (linear grouping), configurations of the few rounded sizes
are chosen by knapsack, the actual lengths are substituted rank by rank, and the small ones go to the
fullest sequence that still holds them (best fit). The result is a plan of runs: "pieces of this length
with these ranks go to these sequences at this offset". Its size depends on the number of lengths, not
of documents; Spark ranks the pieces within their length and looks the runs up.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.llm.common import stored, table, texts, width

SEQUENCE = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Lengths above this share of a sequence count as large; groups of equal cardinality they are put into.
LARGE_SHARE, GROUPS = 1 / 8, 96
#: Words whose ids a Python worker keeps.
CACHED_WORDS = 600_000


class _Known(dict):
    """Ids by word. A word that is not there is noted in ``asked`` and has no ids for now."""

    def __init__(self) -> None:
        super().__init__()
        self.asked: list[str] = []

    def __missing__(self, word: str) -> bytes:
        self.asked.append(word)
        return b""


class WordTokenizer:
    """Ids of a tokenizer whose pieces never cross white space, kept by word.

    The tokenizer normalises and splits at white space, so a text's ids are those of its words one
    after the other. A word made of lower-case letters and closing stops is looked up as the letters and
    the stops, which the tokenizer separates as well. ``ids`` equals the tokenizer's own answer.
    """

    _STOPS = ".,"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_padding()
        self._tokenizer.no_truncation()
        self._known = _Known()
        self._is_end = np.zeros(self._tokenizer.get_vocab_size(), bool)
        for token, number in self._tokenizer.get_vocab().items():
            self._is_end[number] = token.endswith("</w>")

    def _encode(self, words: list[str]) -> None:
        for word, got in zip(
            words, self._tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True
        ):
            self._known[word] = array("I", got.ids).tobytes()

    def _encode_stems(self, stems: list[str]) -> None:
        """Letters only: 64 at a time with spaces between. The last id of each word is a word end."""
        parts = [stems[at : at + 64] for at in range(0, len(stems), 64)]
        joined = [" ".join(part) for part in parts]
        encoded = self._tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        for part, got in zip(parts, encoded, strict=True):
            ids = np.asarray(got.ids, "<u4")
            ends = (np.flatnonzero(self._is_end[ids]) + 1).tolist()
            if len(ends) != len(part) or ends[-1] != len(ids):
                self._encode(part)
                continue
            raw, begin = ids.tobytes(), 0
            for stem, end in zip(part, ends, strict=True):
                self._known[stem] = raw[4 * begin : 4 * end]
                begin = end

    def _learn(self, words: list[str]) -> None:
        """Make all ``words`` known."""
        known, later, stems, plain = self._known, [], {}, {}
        for word in words:
            if word.isalpha() and word.islower() and word == word.lower():
                stems[word] = None
                continue
            stem = word.rstrip(self._STOPS)
            # A run of stops after letters is a piece of its own. Capital sigma lowers by its context.
            if stem.isalpha() and "Σ" not in stem:
                lowered, stops = stem.lower(), word[len(stem) :]
                if not lowered.isalpha():
                    plain[word] = None
                    continue
                later.append((word, lowered, stops))
                if lowered not in known:
                    stems[lowered] = None
                if stops and stops not in known:
                    plain[stops] = None
            else:
                plain[word] = None
        self._encode(list(plain))
        self._encode_stems(list(stems))
        for word, stem, stops in later:
            if word != stem:
                known[word] = known[stem] + known[stops] if stops else known[stem]

    @staticmethod
    def _words(text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split alone
            return re.split(r"[ \t-\r]+", text)
        return text.split()

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text, end token excluded.

        Each word is looked up once; only texts with a word that was not known are looked up again.
        """
        known = self._known
        if len(known) > CACHED_WORDS:
            known.clear()
        get, out, again = known.__getitem__, [], []
        for at, text in enumerate(texts):
            words, noted = self._words(text), len(known.asked)
            out.append(b"".join(map(get, words)))
            if len(known.asked) > noted:
                again.append((at, words))
        if again:
            missing = list(dict.fromkeys(known.asked))
            known.asked.clear()
            self._learn(missing)
            for at, words in again:
                out[at] = b"".join(map(get, words))
        return iter(out)


@cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row for each piece of a document's ids: (doc_id, piece, start, length, ids_crc32)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, end = _tokenizer(path), np.asarray([END], "<u4").tobytes()
        for batch in batches:
            for first in range(0, len(batch), 256):  # a bounded number of texts' words at a time
                part = batch.iloc[first : first + 256]
                rows = []
                for doc_id, ids in zip(part["doc_id"], tokenizer.ids(list(part["text"])), strict=True):
                    ids += end
                    for number, at in enumerate(range(0, len(ids), 4 * sequence)):
                        own = ids[at : at + 4 * sequence]
                        rows.append((doc_id, number, at // 4, len(own) // 4, zlib.crc32(own)))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield out.astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.mapInPandas(cut, schema)


# --- the plan -------------------------------------------------------------------------------------


@dataclass
class Bins:
    """``count`` sequences from number ``first`` on that hold the same ``used`` tokens."""

    first: int
    count: int
    used: int


@dataclass
class Run:
    """Ranks ``rank`` to ``rank + count`` of ``length`` go to sequences ``bins + i`` at ``offset``."""

    length: int
    rank: int
    count: int
    bins: int
    offset: int


def grouped(histogram: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths in falling order cut into groups of equal cardinality: lists of (length, count)."""
    total = sum(histogram.values())
    out: list[list[tuple[int, int]]] = []
    room, made = 0, 0
    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            if not room:
                made += 1
                room = total * made // groups - total * (made - 1) // groups
                if not room:
                    continue
                out.append([])
            take = min(room, count)
            out[-1].append((length, take))
            room, count = room - take, count - take
    return out


def configurations(
    sizes: list[int], counts: list[int], sequence: int
) -> Iterator[tuple[list[int], int]]:
    """Patterns of group numbers and how often each is used, until no group has anything left.

    Each pattern holds the largest group left and fills the rest of the sequence as far as the groups
    left allow: a subset-sum over the few sizes. It is used as often as its groups last.
    """
    left = list(counts)
    for lead in range(len(sizes)):
        while left[lead]:
            room = sequence - sizes[lead]
            # reach[s]: a group whose last addition makes s; sizes fall, so fewest large ones first.
            came = np.full(room + 1, -1, np.int32)
            reached = np.zeros(room + 1, bool)
            reached[0] = True
            for group in range(lead, len(sizes)):
                size, most = sizes[group], left[group] - (group == lead)
                if size > room or most <= 0:
                    continue
                for _ in range(min(most, room // size)):
                    fresh = np.zeros_like(reached)
                    fresh[size:] = reached[:-size]
                    fresh &= ~reached
                    if not fresh.any():
                        break
                    came[fresh] = group
                    reached |= fresh
                if reached[room]:
                    break
            pattern, at = [lead], int(np.flatnonzero(reached)[-1])
            while at:
                group = int(came[at])
                pattern.append(group)
                at -= sizes[group]
            uses = {group: pattern.count(group) for group in set(pattern)}
            if any(left[g] < n for g, n in uses.items()):  # a way back may reuse a scarce group
                pattern, uses = [lead], {lead: 1}
            times = min(left[g] // n for g, n in uses.items())
            for group, n in uses.items():
                left[group] -= n * times
            yield pattern, times


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[Run]:
    """Runs that place every piece of the histogram; each sequence is filled without gaps."""
    runs: list[Run] = []
    opened: list[Bins] = []
    numbers = 0
    ranks = dict.fromkeys(histogram, 0)

    def place(length: int, count: int, first: int, offset: int) -> None:
        runs.append(Run(length, ranks[length], count, first, offset))
        ranks[length] += count

    large = {n: c for n, c in histogram.items() if n > sequence * LARGE_SHARE}
    groups = grouped(large, GROUPS)
    sizes = [group[0][0] for group in groups]
    at = [[0, 0] for _ in groups]  # the next actual length of each group: which, how many are used
    for pattern, times in configurations(sizes, [sum(c for _, c in g) for g in groups], sequence):
        while times:
            # Substitute actual lengths for as many sequences as they stay the same in every slot.
            uses: dict[tuple[int, int], int] = {}
            for group in pattern:
                uses[group, at[group][0]] = uses.get((group, at[group][0]), 0) + 1
            alike = times
            for (group, which), n in uses.items():
                alike = min(alike, (groups[group][which][1] - at[group][1]) // n)
            slots, step = list(pattern), max(1, alike)
            used = 0
            for group in slots:
                which, taken = at[group]
                length, there = groups[group][which]
                place(length, step, numbers, used)
                used += length
                at[group] = [which, taken + step] if taken + step < there else [which + 1, 0]
            opened.append(Bins(numbers, step, used))
            numbers += step
            times -= step

    # Best fit of the small lengths, largest first, into classes of equal room.
    by_used: list[list[Bins]] = [[] for _ in range(sequence + 1)]
    for bins in opened:
        by_used[bins.used].append(bins)
    for length in sorted((n for n in histogram if n not in large), reverse=True):
        count = histogram[length]
        used = sequence - length
        while count:
            while used >= 0 and not by_used[used]:
                used -= 1
            if used < 0:  # nothing open holds it: open what is needed
                each = sequence // length
                whole, rest = divmod(count, each)
                for size, n in ((each, whole), (rest, 1)):
                    if size and n:
                        for slot in range(size):
                            place(length, n, numbers, slot * length)
                        by_used[size * length].append(Bins(numbers, n, size * length))
                        numbers += n
                break
            bins = by_used[used].pop()
            take = min(count, bins.count)
            place(length, take, bins.first, used)
            by_used[used + length].append(Bins(bins.first, take, used + length))
            if take < bins.count:
                by_used[used].append(Bins(bins.first + take, bins.count - take, used))
            count -= take
            used = sequence - length  # what was just filled may hold another one, and fits best
    return runs


# --- ranks and lookup -----------------------------------------------------------------------------


def ranked(frame: DataFrame) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each length, in any fixed order.

    A length may hold a third of all pieces, so it is split by a hash of the piece; the sizes of the
    splits, at most lengths times splits rows, give each its first rank.
    """
    slices = width(frame.sparkSession)
    frame = frame.withColumn(
        "slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)).cast("int")
    )
    own = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        frame.groupBy("length", "slice")
        .count()
        .select("length", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    )
    return (
        frame.withColumn("own", F.row_number().over(own) - 1)
        .join(sizes, ["length", "slice"])
        .withColumn("rank", F.col("first") + F.col("own"))
        .drop("slice", "own", "first")
    )


def assigner(runs: list[Run], sequence: int) -> Callable:
    """A function of batches with length and rank that adds ``sequence_id`` and ``offset``."""
    runs = sorted(runs, key=lambda r: (r.length, r.rank))
    length, rank, first, offset = (
        np.asarray([getattr(r, name) for r in runs], np.int64)
        for name in ("length", "rank", "bins", "offset")
    )
    span = np.int64(2**48)
    starts = length * span + rank

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.searchsorted(starts, batch["length"] * span + batch["rank"], side="right") - 1
            batch["sequence_id"] = first[at] + batch["rank"].to_numpy() - rank[at]
            batch["offset"] = offset[at]
            yield batch.drop(columns="rank")

    return assign


def packed(
    docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, text_column: str = "text"
) -> DataFrame:
    """Where each piece of each document goes; one row for each piece.

    A null or empty text is the end token alone. Repeated rows are packed each; a null id stays null; an
    empty table gives no rows; further columns of ``docs`` are ignored.
    """
    cut = stored(pieces(texts(docs, text_column=text_column), path or tokenizer_path(), sequence))
    histogram = {int(r["length"]): r["count"] for r in cut.groupBy("length").count().collect()}
    assign = assigner(plan(histogram, sequence), sequence)
    schema = (
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    if not histogram:
        return cut.sparkSession.createDataFrame([], schema)
    return ranked(cut).select(*columns).mapInPandas(assign, schema)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
