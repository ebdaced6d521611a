"""Benchmark items inside documents: size-partitioned MinHash containment search, exactly verified.

The items are the query set. They are put into classes by their number of shingles, sizes doubling from
class to class. A class has its own number of hash values and its own threshold: of an item the shingles of
least hash are picked, as many as the class says, and a document is a candidate for the item if it holds at
least the threshold's number of them, however long the document. The threshold follows from the largest
size of the class: if three quarters of the item's shingles are present, fewer of the picked ones are
found with a probability below ``MISS``. Items that are picked entire, as all of the smallest class, are never
missed.

All of it is joins on shingles, in one pass over the documents however many items there are. A bitmap of
fixed size of the picked shingles goes to every task and keeps back nearly all shingles of a document; what
passes is joined with the picked ones and counted by document and item. Candidates are read again, and
their shingles joined and counted with those of the items, which gives the containment exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.common import stored, table
from caseflow.llm.ngram_join import SENT_ROWS, WORDS, shingle_hashes

CONTAINMENT = 75  # per cent
#: Shingles that are picked of an item of the smallest class, and how many more from class to class.
PICKED, MORE = 24, 8
#: Probability that an item with enough shingles in a document has too few picked ones there.
MISS = 1e-9
#: Bits of the bitmap that is broadcast: 4 MB.
BITS = 1 << 25
HITS = "array<struct<item_id:bigint,shared:bigint,size:bigint>>"


def wanted(size: int) -> int:
    """Least number of an item's shingles that make it contained."""
    return -(-CONTAINMENT * size // 100)


def size_class(size: int) -> int:
    """0 up to ``PICKED`` shingles; each further class holds sizes up to twice those of the one before."""
    return max(0, (size - 1) // PICKED).bit_length()


def class_plan(number: int) -> tuple[int, int]:
    """(shingles picked, least number found) of a class, from its largest size."""
    picked = PICKED + MORE * number
    size = PICKED << number
    present = wanted(size)
    ways, least, missed = comb(size, picked), 0, 0
    while least < picked:
        missed += comb(present, least) * comb(size - present, picked - least)
        if missed > MISS * ways:
            break
        least += 1
    return picked, max(1, least)


def picked_shingles(shingles: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` shingles of least hash of a set."""
    if len(shingles) <= count:
        return shingles
    mixed = shingles * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return shingles[np.argpartition(mixed, count)[:count]]


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    plans: dict[int, tuple[int, int]] = {}
    for batch in batches:
        out = []
        for item_id, text in zip(batch["item_id"], batch["text"], strict=True):
            shingles = shingle_hashes(text)
            if not len(shingles):
                continue
            number = size_class(len(shingles))
            if number not in plans:
                plans[number] = class_plan(number)
            count, least = plans[number]
            words = min(WORDS, len(text.encode("utf-8", "surrogatepass").split()))
            if len(shingles) <= count:  # all are picked, so the number that must be there is known
                least = wanted(len(shingles))
            picked = picked_shingles(shingles, count)
            out.append((item_id, words, len(shingles), least, picked.view(np.int64), shingles.view(np.int64)))
        yield pd.DataFrame(out, columns=["item_id", "words", "size", "least", "picked", "shingles"])


def item_sets(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words, size, least, picked, shingles) for each distinct text of each id, stored.

    ``words`` are those of a shingle, fewer than ``WORDS`` for an item of fewer; ``least`` is the number of
    picked shingles that makes a candidate. Items without words, or without an id, are left out.
    """
    rows = (
        benchmark.where(benchmark["item_id"].isNotNull())
        .select(benchmark["item_id"].cast("long").alias("item_id"), F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("text"))
        .distinct()
    )
    schema = "item_id long, words int, size long, least long, picked array<long>, shingles array<long>"
    made = rows.mapInPandas(_items, schema)
    return stored(made.withColumn("item", F.xxhash64("item_id", "shingles")).dropDuplicates(["item"]))


def bitmap(shingles: DataFrame, bits: int = BITS) -> np.ndarray:
    """One bit for each shingle, by its lowest bits: at most ``bits`` / 64 words come to the driver."""
    slot = F.col("shingle").bitwiseAND(F.lit(bits - 1).cast("long"))
    words = (
        shingles.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(shingle & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def probed(docs: DataFrame, shingles: DataFrame, sizes: list[int], bits: int = BITS) -> DataFrame:
    """Distinct (key, shingle) of rows (key, text): shingles of a text that the bitmap of ``shingles`` lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(shingles, bits))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there, mask = sent.value, np.uint64(bits - 1)
        for batch in batches:
            keys, found, seen = [], [], set()
            for key, text in zip(batch["key"], batch["text"], strict=True):
                if key in seen:
                    continue
                seen.add(key)
                for words in sizes:
                    if words < WORDS and words > len(text.encode("utf-8", "surrogatepass").split(None, words)):
                        continue  # a shorter text's only shingle stands for itself
                    own = shingle_hashes(text, words)
                    slot = own & mask
                    passes = (there[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
                    kept = own[passes.astype(bool)]
                    keys.append(np.full(len(kept), key))
                    found.append(kept.view(np.int64))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "shingle": np.concatenate(found)})

    return docs.select("key", "text").mapInPandas(probe, "key long, shingle long").distinct()


def candidates(docs: DataFrame, items: DataFrame, sizes: list[int], bits: int = BITS) -> DataFrame:
    """(key, item) where a text holds enough of an item's picked shingles, as its class wants."""
    picked = items.select("item", "least", F.explode("picked").alias("shingle"))
    return (
        probed(docs, picked, sizes, bits)
        .join(picked, "shingle")
        .groupBy("key", "item")
        .agg(F.count("*").alias("found"), F.first("least").alias("least"))
        .where("found >= least")
        .select("key", "item")
    )


def _sent(frame: DataFrame) -> DataFrame:
    """A stored table of few numbers a row: broadcast up to ``SENT_ROWS`` rows, else joined."""
    return F.broadcast(frame) if frame.count() <= SENT_ROWS else frame


def hits(docs: DataFrame, benchmark: DataFrame, bits: int = BITS) -> DataFrame:
    """(key, hits) of rows (key, text) with equal texts under one key: the items found in a text, by id; stored."""
    items = item_sets(benchmark)
    sizes = sorted(r["words"] for r in items.select("words").distinct().collect())
    likely = stored(candidates(docs, items, sizes, bits))
    again = docs.join(_sent(stored(likely.select("key").distinct())), "key", "left_semi")
    chosen = items.join(likely.select("item").distinct(), "item", "left_semi")
    parts = chosen.select("item", "item_id", "size", F.explode("shingles").alias("shingle"))
    best = F.struct((F.col("shared") / F.col("size")).alias("share"), "shared", "size")
    found = (
        probed(again, parts, sizes, bits)
        .join(parts, "shingle")
        .groupBy("key", "item", "item_id", "size")
        .agg(F.count("*").alias("shared"))
        .where(f"100 * shared >= {CONTAINMENT} * size")
        .join(likely, ["key", "item"], "left_semi")
        .groupBy("key", "item_id")
        .agg(F.max(best).alias("best"))
    )
    own = F.struct("item_id", "best.shared", "best.size")
    return stored(found.groupBy("key").agg(F.sort_array(F.collect_list(own)).alias("hits")))


def _keyed(text: str, docs: DataFrame, *columns) -> DataFrame:
    whole = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(*columns, whole.alias("text"), F.xxhash64(whole).alias("key"))


def contamination(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, contaminated, n_items, items, containment) for each document.

    ``items`` lists the ids found, rising and comma-joined; ``containment`` is the largest share of an
    item's shingles, 0 where none reaches the threshold. A null or empty text contains nothing, nor is
    an item without words found anywhere; an item of fewer than five words counts as one shingle, found
    where its words follow each other. Items that share an id count as one, found with any of their
    texts. A text of any length is searched whole. Repeated rows are judged each alike; a null id stays
    null; without items nothing is found; an empty table gives no rows; further columns are ignored.
    """
    rows = _keyed(text_column, docs, docs["doc_id"].cast("long").alias("doc_id"))
    joined = rows.select("doc_id", "key").join(_sent(hits(rows, benchmark, bits)), "key", "left")
    found = joined.select("doc_id", F.coalesce("hits", F.array().cast(HITS)).alias("hits"))
    ids = F.transform("hits", lambda h: h["item_id"].cast("string"))
    share = F.transform("hits", lambda h: h["shared"] / h["size"])
    return found.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_items"),
        F.array_join(ids, ",").alias("items"),
        F.coalesce(F.array_max(share), F.lit(0.0)).alias("containment"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns and nothing else.

    Cases as in ``contamination``: documents without text stay, repeated rows stay or go together, without
    items all stay, and an empty table gives no rows.
    """
    carried = _keyed(text_column, docs, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    found = _sent(hits(carried.select("key", "text"), benchmark).select("key"))
    return carried.select("row", "key").join(found, "key", "left_anti").select("row.*")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH raw AS (
    SELECT doc_id AS id, text, 0 AS item FROM documents
    UNION ALL SELECT item_id, text, 1 FROM benchmark
),
split AS (
    SELECT id, item, [x FOR x IN string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[ \t\n\x0B\f\r]+') IF x <> ''] AS words
    FROM raw
),
placed AS (SELECT id, item, words, unnest(range(1, len(words) - 3)) AS i FROM split WHERE len(words) >= 5),
shingles AS (SELECT DISTINCT id, item, array_to_string(words[i:i + 4], ' ') AS shingle FROM placed),
items AS (
    SELECT id AS item_id, shingle, count(*) OVER (PARTITION BY id) AS size FROM shingles WHERE item = 1
),
shared AS (
    SELECT s.id AS doc_id, i.item_id, i.size, count(*) AS shared
    FROM shingles s JOIN items i USING (shingle)
    WHERE s.item = 0
    GROUP BY ALL
    HAVING 100 * count(*) >= 75 * i.size
),
found AS (
    SELECT doc_id, count(*) AS n_items, max(shared / size) AS containment,
        string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items
    FROM shared GROUP BY doc_id
)
SELECT d.doc_id, f.doc_id IS NOT NULL AS contaminated, coalesce(f.n_items, 0) AS n_items,
    coalesce(f.items, '') AS items, coalesce(f.containment, 0.0) AS containment
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
"""
