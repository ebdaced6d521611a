"""Removal of every byte of a string of 200 bytes that also starts anywhere else in the corpus.

1. Anchors. Every window of 200 bytes picks one of its 64-byte substrings, that of least hash. Equal
   windows pick equal substrings at equal places, so only windows with one anchor need be compared. The
   windows of a text that pick the same anchor follow each other; their union is a context of some 270
   bytes. Anchors that occur once, most of them, are dropped by counting hashes.
2. Equal contexts are repeated throughout. Distinct contexts with one anchor are brought together.
3. Search. Contexts of some anchors form a block; in its suffix array and Burrows-Wheeler transform,
   intervals of suffixes with a common prefix are extended backward, breadth first, which derives common
   prefixes by increasing value; it stops at 200, and suffixes not separated until then are repeated.
   An anchor with very many distinct contexts does not go to one task: hashes of its windows are counted.
4. What was found goes back to the texts by a hash of the context.

Equality of anchors, contexts and hot windows is that of 64-bit hashes; the search compares bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.llm.common import stored, table, texts

LENGTH, ANCHOR = 200, 64
#: Contexts of an anchor that are searched in one task, and contexts of a block of anchors.
HOT, BLOCK = 1000, 1500
#: Windows of a hot context whose common core is counted before the windows themselves.
PART = 8
#: Hashes of texts that are broadcast, 16 MB of them; more are joined.
SENT_TEXTS = 2_000_000
COVERED, SEARCH = 1, 2

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xC2B2AE3D27D4EB4F)
    return values ^ (values >> np.uint64(29))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(size, np.uint64(b)) for b in (_BASE, _INVERSE))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Hashes:
    """Hashes of any substrings of a text from sums of its prefixes."""

    def __init__(self, raw: bytes) -> None:
        octets = np.frombuffer(raw, np.uint8)
        up, self._down = _powers(max(1 << 16, 1 << len(raw).bit_length()))
        self._sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self._sums[ends] - self._sums[starts]) * self._down[starts])

    def every(self, length: int) -> np.ndarray:
        count = len(self._sums) - length
        return _mix((self._sums[length:] - self._sums[:count]) * self._down[:count])


def contexts(raw: bytes) -> tuple[np.ndarray, ...]:
    """(anchor, context, first, last, at) of the contexts of a text.

    Hashes of anchor and context, the context's first and last window, and where its anchor is.
    """
    if len(raw) < LENGTH:
        none = np.zeros(0, np.uint64)
        return (none, none, *(none.astype(np.int64),) * 3)
    hashes = Hashes(raw)
    grams = hashes.every(ANCHOR)
    # The least of the leading 32 bits; the leftmost of equals.
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = LENGTH - ANCHOR + 1
    padded = np.full(-(-len(keys) // span) * span, np.uint64(2**64 - 1))
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, span)
    after = np.minimum.accumulate(rows, axis=1).ravel()
    before = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(raw) - LENGTH + 1
    picked = (np.minimum(before[:windows], after[span - 1 : span - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, picked[1:] != picked[:-1]])
    last = np.r_[first[1:], windows] - 1
    at = picked[first]
    context = hashes.of(first, last + LENGTH)
    context = _mix(context + (at - first).astype(np.uint64) * np.uint64(_BASE) + (last - first).astype(np.uint64))
    return grams[at], context, first, last, at


# --- 1, 2: anchors ----------------------------------------------------------------------------------


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(anchor, context, node, number, known) of the contexts of each text, ``number`` in its text.

    What one batch shows is known at once: contexts that are equal, and anchors with several contexts.
    One row of each anchor keeps its hash; the others get a random value, so that no anchor has more
    rows than there are batches.
    """
    for batch in batches:
        seen: dict[int, bool] = {}
        parts = []
        counts = batch["node"].value_counts()
        for node, text in zip(batch["node"], batch["text"], strict=True):
            if node in seen:
                continue
            seen[node] = True
            anchor, context, first, _, _ = contexts(text.encode("utf-8", "surrogatepass"))
            copies = np.full(len(first), counts[node] > 1)
            parts.append((anchor, context, np.full(len(first), node), np.arange(len(first)), copies))
        if not parts:
            continue
        anchor, context, node, number, copies = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((context, anchor))
        anchor, context, node, number, copies = (x[order] for x in (anchor, context, node, number, copies))
        if not len(anchor):
            continue
        new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
        new_context = new_anchor | np.r_[True, context[1:] != context[:-1]]
        alike = ~new_context | np.r_[~new_context[1:], False] | copies
        group = np.cumsum(new_anchor) - 1
        mixed = (np.bincount(group, new_context) > 1)[group]
        known = alike * COVERED + (mixed & new_context) * SEARCH
        other = _mix(anchor + node.view(np.uint64) * np.uint64(_BASE) + number.astype(np.uint64))
        yield pd.DataFrame(
            {
                "anchor": np.where(new_anchor, anchor, other).view(np.int64),
                "context": context.view(np.int64),
                "node": node,
                "number": number.astype(np.int32),
                "known": known.astype(np.int32),
            }
        )


def _verdicts(docs: DataFrame) -> DataFrame:
    """(node, verdicts): for each text with repeated anchors what is known of them, by number."""
    index = docs.mapInPandas(_anchors, "anchor long, context long, node long, number int, known int")
    same = Window.partitionBy("anchor")
    mixed = F.min("context").over(same) != F.max("context").over(same)
    repeated = F.count("*").over(same) > 1
    flags = F.col("known").bitwiseOR(
        F.when(repeated & ~mixed, COVERED).when(repeated & mixed, SEARCH).otherwise(0)
    )
    return (
        index.withColumn("flags", flags)
        .where("flags > 0")
        .groupBy("node", "number", "context")
        .agg(F.bit_or("flags").alias("flags"))
        .groupBy("node")
        .agg(F.collect_list(F.struct("number", "flags", "context")).alias("verdicts"))
    )


# --- 3: search --------------------------------------------------------------------------------------


def suffix_array(symbols: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in the order of their first ``length`` symbols at least, by doubling from seven."""
    n = len(symbols)
    padded = np.r_[symbols.astype(np.int64), np.zeros(7, np.int64)]
    key = np.zeros(n, np.int64)
    for at in range(7):
        key = (key << 9) | padded[at : at + n]
    reach = 7
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        if reach >= length or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - reach] += rank[reach:] + 1
        reach *= 2


def repeated_starts(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """The starts in each piece of strings of ``length`` that start more than once in all pieces.

    Backward extension on the transform, breadth first: rows i - 1 and i, whose suffixes begin alike,
    share d + 1 symbols if the suffixes one further on, rows psi[i - 1] and psi[i], lie in one
    interval of those that share d. Each round derives all common prefixes of the value d.
    """
    sizes = np.asarray([len(p) for p in pieces])
    begins = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    for begin, piece in zip(begins, pieces, strict=True):
        text[begin : begin + len(piece)] = np.frombuffer(piece, np.uint8).astype(np.int64) + 1
    order = suffix_array(text, length)
    place = np.empty(len(text), np.int32)
    place[order] = np.arange(len(text), dtype=np.int32)
    psi = place[np.minimum(order + 1, len(text) - 1)]
    apart = np.ones(len(text), bool)
    apart[1:] = text[order[1:]] != text[order[:-1]]
    active = np.flatnonzero(~apart)
    active = active[(order[active] < len(text) - 1) & (order[active - 1] < len(text) - 1)]
    above, own = psi[active - 1], psi[active]
    for _ in range(1, length):
        interval = np.cumsum(apart, dtype=np.int32)
        differs = interval[above] != interval[own]
        if differs.any():
            apart[active[differs]] = True
            keep = ~differs
            active, above, own = active[keep], above[keep], own[keep]
        if not len(active):
            break
    found = np.zeros(len(text), bool)
    found[order[active]] = found[order[active - 1]] = True
    return [
        np.flatnonzero(found[b : b + max(0, s - length + 1)])
        for b, s in zip(begins, sizes, strict=True)
    ]


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as (first, last)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), starts[np.r_[cut, len(starts) - 1]].tolist(), strict=True))


RUNS = "context long, runs array<struct<first:int,last:int>>"


def _search(batch: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows of the contexts of a block; a context met twice is repeated throughout."""
    found = repeated_starts([bytes(p) for p in batch["piece"]])
    rows = []
    for context, piece, times, starts in zip(batch["context"], batch["piece"], batch["times"], found, strict=True):
        runs = [(0, len(piece) - LENGTH)] if times > 1 else _ranges(starts)
        if runs:
            rows.append((context, [{"first": a, "last": b} for a, b in runs]))
    return pd.DataFrame(rows, columns=["context", "runs"])


def _cores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(context, part, core, content, first, last) of hot contexts.

    A part are the windows that start ``PART * part`` to ``PART * part + PART - 1`` bytes before the
    anchor, whether the context has all of them or not; its core is what all of them contain, its
    content what the context's own ones, ``first`` to ``last``, cover.
    """
    names = ["context", "part", "core", "content", "first", "last"]
    for batch in batches:
        rows = []
        for context, piece, at in zip(batch["context"], batch["piece"], batch["at"], strict=True):
            windows = len(piece) - LENGTH + 1
            part = np.arange((at - windows + 1) // PART, at // PART + 1)
            start = at - PART * part
            hashes = Hashes(bytes(piece))
            core = hashes.of(start, start + LENGTH - PART + 1)
            first, last = np.maximum(start - PART + 1, 0), np.minimum(start, windows - 1)
            content = hashes.of(first, last + LENGTH)
            content = _mix(content + (at - first).astype(np.uint64) * np.uint64(_BASE) + (last - first).astype(np.uint64))
            rows.append((np.full(len(part), context), part, core.view(np.int64), content.view(np.int64), first, last))
        if rows:
            columns = dict(zip(names, map(np.concatenate, zip(*rows, strict=True)), strict=True))
            yield pd.DataFrame(columns).astype({"part": "int32", "first": "int32", "last": "int32"})


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(context, start, window) of the windows of the chosen parts."""
    for batch in batches:
        rows = []
        for context, piece, at, parts in zip(
            batch["context"], batch["piece"], batch["at"], batch["parts"], strict=True
        ):
            every = Hashes(bytes(piece)).every(LENGTH)
            start = np.arange(len(every))
            start = start[np.isin((at - start) // PART, np.asarray(parts))]
            rows.append((np.full(len(start), context), start, every[start].view(np.int64)))
        if rows:
            context, start, window = map(np.concatenate, zip(*rows, strict=True))
            yield pd.DataFrame({"context": context, "start": start.astype(np.int32), "window": window})


def _runs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        runs = [[{"first": a, "last": b} for a, b in _ranges(np.asarray(s))] for s in batch["starts"]]
        yield pd.DataFrame({"context": batch["context"], "runs": runs})


def _repeated_values(frame: DataFrame, value: str) -> DataFrame:
    """The rows of ``frame`` whose ``value`` another row has too."""
    times = frame.groupBy(value).agg(F.count("*").alias("times")).where("times > 1").select(value)
    return frame.join(times, value)


def _hot_runs(hot: DataFrame) -> DataFrame:
    """Repeated windows of the contexts of hot anchors by counting hashes; no group is gathered.

    A part with the content of another is repeated throughout. Of each content one part goes on, if
    its core is that of another content; the windows of those are counted one by one.
    """
    schema = "context long, part int, core long, content long, first int, last int"
    parts = stored(hot.mapInPandas(_cores, schema))
    contents = parts.groupBy("content").agg(
        F.count("*").alias("times"), F.min(F.struct("context", "part", "core")).alias("one")
    )
    covered = (
        parts.join(contents.where("times > 1").select("content"), "content")
        .groupBy("context")
        .agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    )
    distinct = _repeated_values(contents.select("one.*"), "core")
    wanted = distinct.groupBy("context").agg(F.collect_set("part").alias("parts"))
    windows = hot.join(wanted, "context").select("context", "piece", "at", "parts")
    windows = windows.mapInPandas(_windows, "context long, start int, window long")
    starts = F.sort_array(F.collect_set("start")).alias("starts")
    found = _repeated_values(windows, "window").groupBy("context").agg(starts)
    every = found.mapInPandas(_runs_of, RUNS).unionByName(covered)
    return every.groupBy("context").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(anchor, context, piece, at) of the contexts that are to be searched."""
    for batch in batches:
        rows = []
        for text, verdicts in zip(batch["text"], batch["verdicts"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            anchor, context, first, last, at = contexts(raw)
            for number in sorted({v["number"] for v in verdicts if v["flags"] & SEARCH}):
                a, b = int(first[number]), int(last[number])
                own = (int(anchor.view(np.int64)[number]), int(context.view(np.int64)[number]))
                rows.append((*own, raw[a : b + LENGTH], int(at[number]) - a))
        yield pd.DataFrame(rows, columns=["anchor", "context", "piece", "at"])


def _found_runs(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(context, runs): repeated windows of every context that is to be searched."""
    wanted = verdicts.where(F.exists("verdicts", lambda v: v["flags"].bitwiseAND(SEARCH) > 0))
    pieces = stored(
        _chosen(docs, wanted.select("node"))
        .join(wanted, "node")
        .select("text", "verdicts")
        .mapInPandas(_pieces, "anchor long, context long, piece binary, at int")
        .groupBy("context")
        .agg(
            F.min("anchor").alias("anchor"),
            F.min("piece").alias("piece"),
            F.min("at").alias("at"),
            F.count("*").alias("times"),
        )
    )
    sizes = pieces.groupBy("anchor").count()
    hot = sizes.where(F.col("count") > HOT).select("anchor")
    blocks = max(1, pieces.count() // BLOCK)
    cold = pieces.join(sizes.where(F.col("count") <= HOT).select("anchor"), "anchor")
    searched = (
        cold.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))
        .groupBy("block")
        .applyInPandas(_search, RUNS)
    )
    hot_pieces = stored(pieces.join(hot, "anchor"))
    twice = hot_pieces.where("times > 1").select(
        "context",
        F.array(
            F.struct(F.lit(0).alias("first"), (F.octet_length("piece") - LENGTH).alias("last"))
        ).alias("runs"),
    )
    return searched.unionByName(_hot_runs(hot_pieces)).unionByName(twice)


def _chosen(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts with a node among ``nodes``: looked up in every task up to a size, else left to the join."""
    if nodes.count() > SENT_TEXTS:
        return docs
    return docs.join(F.broadcast(nodes), "node", "left_semi")


# --- 4: removal -------------------------------------------------------------------------------------


def kept_bytes(raw: bytes, covered: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left without the covered ranges, the bytes removed, and the number of removed runs."""
    kept, at, removed, spans, reach = [], 0, 0, 0, -1
    for begin, end in sorted(covered):
        if begin > reach:
            spans += 1
            kept.append(raw[at:begin])
            removed += end - begin
            at = reach = end
        elif end > reach:
            removed += end - reach
            at = reach = end
    kept.append(raw[at:])
    return b"".join(kept), removed, spans


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text, marks in zip(batch["doc_id"], batch["text"], batch["marks"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            covered = []
            if marks is not None:
                _, _, first, last, _ = contexts(raw)
                for mark in marks:
                    a, b = int(first[mark["number"]]), int(last[mark["number"]])
                    if mark["runs"] is None:
                        covered.append((a, b + LENGTH))
                    else:
                        covered += [(a + r["first"], a + r["last"] + LENGTH) for r in mark["runs"]]
            kept, removed, spans = kept_bytes(raw, covered)
            rows.append((doc_id, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        yield out.astype({"doc_id": "Int64"})


def deduplicated(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each document; ``kept`` is bytes.

    A null text counts as empty; texts of less than 200 bytes keep all. Repeated rows are documents
    each, so a text of 200 bytes or more that occurs twice is removed from both. A null id stays null;
    an empty table gives no rows; further columns are ignored.
    """
    rows = texts(docs, text_column=text_column).withColumn("node", F.xxhash64("text"))
    verdicts = stored(_verdicts(rows))
    runs = _found_runs(rows, verdicts)
    each = verdicts.select("node", F.explode("verdicts").alias("v")).select("node", "v.*")
    covered = each.where(F.col("flags").bitwiseAND(COVERED) > 0).select(
        "node", "number", F.lit(None).cast("array<struct<first:int,last:int>>").alias("runs")
    )
    partly = each.where(F.col("flags") == SEARCH).join(runs, "context").select("node", "number", "runs")
    marks = stored(
        covered.unionByName(partly)
        .groupBy("node")
        .agg(F.collect_list(F.struct("number", "runs")).alias("marks"))
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    columns = ["doc_id", "text", "marks"]
    if marks.count() > SENT_TEXTS:
        return rows.join(marks, "node", "left").select(*columns).mapInPandas(_removed, schema)
    nodes = F.broadcast(marks.select("node"))
    changed = rows.join(nodes, "node", "left_semi").join(marks, "node").select(*columns)
    raw = F.col("text").cast("binary")
    whole = rows.join(nodes, "node", "left_anti").select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2(raw, 256).alias("kept_sha256"),
        raw.alias("kept"),
    )
    return changed.mapInPandas(_removed, schema).unionByName(whole)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("kept")
