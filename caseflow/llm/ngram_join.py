"""Exact join of documents whose sets of word 5-shingles overlap by 75 % or more, and its components.

A document's links are found by T-occurrence search: a partner must occur in at least T of the inverted
lists of its shingles. DivideSkip merges the short lists, keeps what occurs often enough there, and
probes the few long lists by binary search. Spark brings together what can share enough shingles:

1. Equal sets become one key; only the key goes on.
2. The first shingles of each set in a fixed order, its prefix, are counted over all documents. Two
   linked sets share a known number of prefix shingles, so a set with fewer repeated ones has no partner.
   What remains, the survivors, is a small part of most corpora.
3. Among survivors all shingles are counted, and sets without enough repeated ones dropped again. What
   shares a prefix shingle, rarest first, forms clusters. A cluster is searched in one task, or block
   by block if it is large: each pair of blocks is a task of bounded size.
4. The links of all tasks are joined to components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.llm.common import stored, table, texts
from caseflow.llm.graph import components

WORDS = 5
#: Documents of a cluster that are searched in one task; larger clusters are searched block by block.
BLOCK = 1500
#: Hashes of rows that are broadcast, 16 MB of them.
SENT_ROWS = 2_000_000
_FACTORS = [
    np.uint64(x)
    for x in (
        0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
    )
]


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; empty without words."""
    split = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII spaces only
    if not split:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
    size = min(words, len(split))
    count = len(split) - size + 1
    mixed = np.full(count, np.uint64(size))
    for at in range(size):
        mixed = mixed * _FACTORS[0] + each[at : at + count] * _FACTORS[at % len(_FACTORS)]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def set_key(hashes: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; None for the empty set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def needed(size: int) -> int:
    """Least overlap of a set of this size with any linked set: 75 % of it, rounded up."""
    return (3 * size + 3) // 4


def linked(overlap: int, first: int, second: int) -> bool:
    return 100 * overlap >= 75 * (first + second - overlap)


# --- which documents can have a partner -----------------------------------------------------------


def _parts(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """The same rows, fewer at a time."""
    for batch in batches:
        for first in range(0, len(batch), rows):
            yield batch.iloc[first : first + rows]


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _parts(batches):
        hashes = [shingle_hashes(text) for text in batch["text"]]
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"].astype("Int64"),
                "row": batch["row"],
                "n_shingles": [len(h) for h in hashes],
                "key": [set_key(h) for h in hashes],
            }
        )


def _prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(shingle, node) of the prefixes; node is the start of the key, its lowest bit a mark.

    A shingle that sets of one batch share is known to be repeated. One row of them keeps it, with the
    mark; the others get a random value in its place, so that no list is longer than there are batches.
    """
    for batch in batches:
        shingles, nodes = [], []
        seen: set[bytes] = set()
        for text in batch["text"]:
            hashes = shingle_hashes(text)
            key = set_key(hashes)
            if key is None or key in seen:
                continue
            seen.add(key)
            size = len(hashes)
            prefix = hashes[: size - needed(size) + 1 + size // 8]
            shingles.append(prefix)
            node = np.uint64(int.from_bytes(key[:8], "little")) & ~np.uint64(1)
            nodes.append(np.full(len(prefix), node))
        if not shingles:
            continue
        shingle, node = np.concatenate(shingles), np.concatenate(nodes)
        order = np.argsort(shingle, kind="stable")
        shingle, node = shingle[order], node[order]
        first = np.r_[True, shingle[1:] != shingle[:-1]]
        repeated = ~first | np.r_[~first[1:], False]
        random = (shingle ^ node) * np.uint64(0x9E3779B97F4A7C15)
        random ^= random >> np.uint64(29)
        shingle = np.where(first, shingle, random * np.uint64(0xC2B2AE3D27D4EB4F))
        node = node | repeated.astype(np.uint64)
        yield pd.DataFrame({"shingle": shingle.view(np.int64), "node": node.view(np.int64)})


def _survivors(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """One (row, key) for each set that has enough repeated prefix shingles to have a partner."""
    index = docs.mapInPandas(_prefixes, "shingle long, node long")
    times = F.count("*").over(Window.partitionBy("shingle"))
    repeated = (
        index.withColumn("times", times)
        .where("times > 1 or node & 1 = 1")
        .groupBy(F.expr("node & ~1L").alias("node"))
        .count()
    )
    keys = sets.where("key is not null").groupBy("key").agg(
        F.first("n_shingles").alias("n"), F.min("row").alias("row")
    )
    # The start of a key, little-endian, as a long with the lowest bit cleared.
    node = F.expr("cast(conv(hex(reverse_bytes), 16, -10) as bigint) & ~1L")
    swapped = F.concat(*[F.substring("key", at, 1) for at in range(8, 0, -1)])
    keys = keys.withColumn("reverse_bytes", swapped).withColumn("node", node)
    return (
        keys.join(repeated, "node")
        .where("count >= 1 + ((3 * n + 3) div 4) div 8")
        .select("row", "key")
    )


# --- search ---------------------------------------------------------------------------------------


class Links:
    """Union-find over the documents of a task."""

    def __init__(self, size: int) -> None:
        self.parent = list(range(size))

    def root(self, node: int) -> int:
        while self.parent[node] != node:
            self.parent[node] = self.parent[self.parent[node]]
            node = self.parent[node]
        return node

    def join(self, first: int, second: int) -> None:
        first, second = self.root(first), self.root(second)
        self.parent[max(first, second)] = min(first, second)


def divide_skip(sets: list[np.ndarray], sizes: np.ndarray) -> Links:
    """Components of the links among sets, given as their repeated shingles and full sizes.

    Shingles that no other set has are left out of ``sets``; they are the shortest lists and lead
    nowhere. Sets are queries in turn. A query's lists are ordered by length; the T - 1 longest are put
    aside, for whatever is in T lists is in one of the others. The short ones are merged into candidates
    with their counts; candidates already in the query's component, of an impossible size, or with too
    few lists left to reach T are dropped, and the rest probed in the long lists by binary search.
    """
    links = Links(len(sets))
    if len(sets) < 2:
        return links
    listed = np.asarray([len(s) for s in sets])
    owners = np.repeat(np.arange(len(sets)), listed)
    _, dense, lengths = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(dense, kind="stable")
    postings = owners[order]  # the lists one after the other, each in rising order
    starts = np.r_[0, np.cumsum(lengths)]
    ends = np.cumsum(listed)
    roots = np.arange(len(sets))
    for query in range(len(sets)):
        size = int(sizes[query])
        least = needed(size)
        if listed[query] < least:
            continue
        own = dense[ends[query] - listed[query] : ends[query]]
        own = own[np.argsort(lengths[own], kind="stable")]
        short = own[: len(own) - least + 1]
        short = short[lengths[short] > 1]
        if not len(short):
            continue
        merged = np.concatenate([postings[starts[s] : starts[s + 1]] for s in short])
        found, counts = np.unique(merged[merged > query], return_counts=True)
        fits = (4 * sizes[found] >= 3 * size) & (3 * sizes[found] <= 4 * size)
        fits &= roots[found] != roots[query]
        found, counts = found[fits], counts[fits]
        # T of each pair: overlap >= 75 % of the union, hence >= 3 / 7 of both sizes, rounded up.
        wanted = (3 * (sizes[found] + size) + 6) // 7
        long = own[len(own) - least + 1 :]
        for left, one in enumerate(long):
            alive = counts + (len(long) - left) >= wanted
            if not alive.all():
                found, counts, wanted = found[alive], counts[alive], wanted[alive]
            if not len(found):
                break
            inverted = postings[starts[one] : starts[one + 1]]
            at = np.minimum(np.searchsorted(inverted, found), len(inverted) - 1)
            counts = counts + (inverted[at] == found)
        for partner in found[counts >= wanted]:
            first, second = links.root(query), links.root(int(partner))
            if first != second:
                links.join(first, second)
                roots[roots == max(first, second)] = min(first, second)
    return links


def _search(batch: pd.DataFrame) -> pd.DataFrame:
    """Links of a task's documents as (a, b): each to the first of its component."""
    batch = batch.drop_duplicates("key")
    keys = list(batch["key"])
    links = divide_skip([np.asarray(s, np.int64) for s in batch["shingles"]], batch["n"].to_numpy())
    roots = [links.root(node) for node in range(len(keys))]
    pairs = [(keys[node], keys[root]) for node, root in enumerate(roots) if node != root]
    return pd.DataFrame(pairs, columns=["a", "b"])


def _arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _parts(batches):
        hashes = [shingle_hashes(text) for text in batch["text"]]
        yield pd.DataFrame(
            {"key": [set_key(h) for h in hashes], "shingles": [h.view(np.int64) for h in hashes]}
        )


def _read_again(docs: DataFrame, survivors: DataFrame) -> DataFrame:
    """The texts of the survivors. Up to ``SENT_ROWS`` hashes of rows go to every task; more are joined."""
    chosen = survivors.select("row")
    if survivors.count() <= SENT_ROWS:
        chosen = F.broadcast(chosen)
    return docs.join(chosen, "row", "left_semi").select("text")


def _repeated_shingles(arrays: DataFrame) -> DataFrame:
    """(key, n, shingles): shingles that another survivor has too, the rarest first.

    Sets in which they are fewer than any partner shares are dropped.
    """
    rows = arrays.select("key", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    times = rows.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
    return (
        rows.join(times, "shingle")
        .groupBy("key")
        .agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("s"))
        .where(F.size("s") >= F.expr("(3 * n + 3) div 4"))
        .select("key", "n", F.col("s.shingle").alias("shingles"))
    )


def _links(arrays: DataFrame) -> DataFrame:
    """Links (a, b) among the stored sets of ``_repeated_shingles``, enough to join each component.

    Unrepeated shingles come first in the order of a set's prefix, so that what is left of it are the
    rarest of the repeated ones.
    """
    least = F.expr("cast((3 * n + 3) div 4 as int)")
    rows = arrays.select(
        "key", F.explode(F.slice("shingles", F.lit(1), F.size("shingles") - least + 1)).alias("shingle")
    )
    # One row for each shingle, stored: so the join can split a shingle or a cluster with very many sets.
    hubs = rows.groupBy("shingle").agg(F.min("key").alias("hub"), F.max("key").alias("last"))
    hubs = stored(hubs.where("hub != last"))
    shared = (
        rows.join(hubs, "shingle").where("key != hub").select("key", "hub").distinct()
    )
    clusters = stored(components(shared.toDF("a", "b")).toDF("key", "cluster"))
    blocks = F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")
    large = stored(clusters.groupBy("cluster").count().select("cluster", blocks))
    buckets = max(1, clusters.count() // BLOCK)
    placed = (
        clusters.join(large, "cluster")
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key",
            F.when(F.col("blocks") > 1, F.col("cluster")).alias("cluster"),
            F.when(F.col("blocks") > 1, F.least("block", "other"))
            .otherwise(F.pmod(F.xxhash64("cluster"), F.lit(buckets)).cast("int"))
            .alias("low"),
            F.when(F.col("blocks") > 1, F.greatest("block", "other")).otherwise(-1).alias("high"),
        )
    )
    tasks = arrays.join(placed, "key").groupBy("cluster", "low", "high")
    return tasks.applyInPandas(_search, "a binary, b binary")


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, key, root) of rows (doc_id, text, row); root is null for empty sets."""
    sets = stored(docs.mapInPandas(_sets, "doc_id long, row long, n_shingles long, key binary"))
    survivors = stored(_survivors(docs, sets))
    again = stored(
        _read_again(docs, survivors)
        .mapInPandas(_arrays, "key binary, shingles array<long>")
        .dropDuplicates(["key"])
    )
    roots = components(_links(stored(_repeated_shingles(again)))).toDF("key", "root")
    return sets.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def _rows(docs: DataFrame, text_column: str) -> DataFrame:
    return texts(docs, text_column=text_column).withColumn("row", F.xxhash64("doc_id", "text"))


def near_duplicates(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document.

    A null or empty text has the empty set and is linked with nothing; its component is its own id. A text of
    any length gives its whole set, which one task holds.
    Repeated rows and equal texts have one component; a row whose id is null is linked like any other,
    and has a null component if no document of its component has an id. An empty table gives no rows;
    further columns are ignored.
    """
    grouped = stored(_grouped(_rows(docs, text_column)))
    least = stored(
        grouped.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    )
    own = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return grouped.join(least, "root", "left").select("doc_id", "n_shingles", own.alias("component_id"))


def one_of_each(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One document of each component, that of the least id, with all its columns; and all empty ones.

    Of repeated rows one stays, of ties that of the least id and hash. A row without an id stays only where
    no document of its component has one. An empty table gives no rows. What goes, and not what stays, is
    looked up, in every task up to a size.
    """
    rows = _rows(docs.withColumnRenamed(id_column, "doc_id"), text_column)
    grouped = stored(_grouped(rows).where("root is not null").select("root", "doc_id", "row"))
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "row")).alias("first")
    chosen = grouped.groupBy("root").agg(first).select(F.col("first.row").alias("row"), F.lit(True).alias("stays"))
    times = grouped.groupBy("row").agg(F.count("*").alias("times"))
    verdicts = stored(times.join(chosen, "row", "left").where("stays is null or times > 1"))
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    carried = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("document"),
        F.xxhash64(docs[id_column].cast("long"), text).alias("row"),
    )
    sent = F.broadcast if verdicts.count() <= SENT_ROWS else lambda frame: frame
    kept = carried.join(sent(verdicts.select("row")), "row", "left_anti")
    repeated = verdicts.where("stays and times > 1").select("row")
    if repeated.take(1):
        once = carried.join(sent(repeated), "row", "left_semi").dropDuplicates(["row"])
        kept = kept.unionByName(once)
    return kept.select("document.*")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
