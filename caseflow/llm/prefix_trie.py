"""The trie of conversation prefixes, by van Emde Boas recursion over depth.

A conversation is a sequence of turns; conversations that begin alike share nodes. The depths 0 to 2^K - 1 are
cut at half, and each half again, until single turns are left: K rounds, each over all sequences at once.

1. Blocks. Turns have a name, a hash of role and text. Names of two neighbouring blocks of 2^k turns make the
   name of the block of 2^(k+1).
2. Cut. A segment of a sequence is (name of the prefix before it, name of the prefix at its end). The round
   for k cuts each segment of 2^(k+1) turns: the prefix at the cut is named by the prefix before the segment
   and the block of its first half. The upper part stays under the old name, the lower part hangs under the
   new one; all upper tries and lower forests of a round are built side by side. Segments of one turn are
   the edges of the trie.
3. Graft. Totals of subtrees go up in the same halves: the total of a lower tree's root goes to the nodes above
   it in its upper trie, which are prefixes of any of its members. K rounds again.

No round gathers a conversation or a node's members in one task: a conversation's turns are numbered over range
partitions, joined in blocks of ``BLOCK`` turns at most, and members are only counted. The one thing that must
go in order is a digest of the ids that end at a node: ids are joined to strings by ranges of ``BLOCK`` ids,
and the strings of a node streamed through one task, which holds one at a time.

Names are 128-bit hashes of the turns and of pairs of names; texts are read once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.llm.common import stored, table, width

#: Conversations of this many ids in a row begin with turns of the first of them, at most of these many.
FAMILY, HEAD = 20, 4
BLOCK = 1024
WORDS = r"[^\x20\x09-\x0D]+"


def _name(*parts: Column) -> Column:
    """128 bits that stand for a sequence of names."""
    return F.unhex(F.md5(F.concat(*parts)))


def _root() -> Column:
    return F.unhex(F.md5(F.lit(b"")))


# --- sequences ------------------------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, name, words) of the rows that belong to a conversation."""
    c = conversations
    rows = c.select(
        c["conv_id"].cast("long").alias("conv_id"),
        c["turn"].cast("long").alias("turn"),
        F.coalesce(c["role"].cast("string"), F.lit("")).alias("role"),
        F.coalesce(c["text"].cast("string"), F.lit("")).alias("text"),
    )
    named = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    return rows.where("conv_id is not null").select(
        "conv_id", "turn", named.alias("name"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words")
    )


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, name, words) with ``at``: 0, 1, ... by turn, null first, then by name.

    Sorted over range partitions, so that a conversation of any length is spread over several; a row's
    place is that within its partition and the number of the conversation's rows in earlier ones.
    """
    slices = width(rows.sparkSession)
    order = [F.col("turn").asc_nulls_first(), "name", "tie"]
    ranged = stored(
        stored(rows.withColumn("tie", F.monotonically_increasing_id()))
        .repartitionByRange(slices, "conv_id", *order)
        .withColumn("slice", F.spark_partition_id())
    )
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        ranged.groupBy("conv_id", "slice")
        .count()
        .select("conv_id", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    )
    own = F.row_number().over(Window.partitionBy("conv_id", "slice").orderBy(*order)) - 1
    return (
        ranged.withColumn("own", own)
        .join(first, ["conv_id", "slice"])
        .select("conv_id", "name", "words", (F.col("first") + F.col("own")).alias("at"))
    )


def rebuilt(rows: DataFrame, family: int = FAMILY, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """(sequences, turns) of rows (conv_id, at, name, words) after their first turns are exchanged.

    Conversation c takes the first h = crc32(c) % ``head`` turns of conversation c - c % ``family`` in place of
    its own first h. Sequences are (conv_id, size), also those without turns; turns as before, with ``size``.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % head
    first = F.struct("at", "name", "words")
    heads = (
        rows.where((F.col("conv_id") == base) & (F.col("at") < head - 1))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(first)).alias("turns"))
        .withColumnRenamed("conv_id", "base")
    )
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("own"))
    none = F.array().cast("array<struct<at:bigint,name:binary,words:bigint>>")
    given = F.slice(F.coalesce("turns", none), F.lit(1), F.col("taken").cast("int"))
    sequences = stored(
        sizes.select("conv_id", "own", base.alias("base"), taken.alias("taken"))
        .join(heads, "base", "left")
        .select("conv_id", "own", "taken", given.alias("given"))
        .withColumn("size", F.size("given") + F.greatest(F.col("own") - F.col("taken"), F.lit(0)))
    )
    shared = sequences.select("conv_id", "size", F.explode("given").alias("turn")).select(
        "conv_id", "turn.at", "turn.name", "turn.words", "size"
    )
    blocks = sequences.select(
        "conv_id",
        "size",
        (F.size("given") - F.col("taken")).alias("shift"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(own - 1) div {BLOCK}"))).alias("block"),
    )
    kept = (
        rows.where(F.col("at") >= taken)
        .withColumn("block", F.expr(f"at div {BLOCK}"))
        .join(blocks, ["conv_id", "block"])
        .select("conv_id", (F.col("at") + F.col("shift")).alias("at"), "name", "words", "size")
    )
    return sequences.select("conv_id", "size"), kept.unionByName(shared)


# --- names of prefixes ----------------------------------------------------------------------------


def edges(rows: DataFrame, levels: int) -> DataFrame:
    """(conv_id, depth, parent, node, words, size): each turn with the names of the prefixes it extends and ends.

    ``rows`` are (conv_id, at, name, words, size), of sequences shorter than 2 to the power of ``levels``.
    """
    odd = F.col("at") % 2 == 1

    def halves(blocks: DataFrame, *columns: str) -> DataFrame:
        """Each two neighbouring blocks as one row; the second may be missing."""
        sides = [
            F.max(F.when(odd if side == "second" else ~odd, F.col(c))).alias(f"{side}_{c}")
            for side in ("first", "second")
            for c in columns
        ]
        return blocks.groupBy("conv_id", "size", F.shiftright("at", 1).alias("at")).agg(*sides)

    pairs = [stored(halves(rows, "name", "words"))]
    for _ in range(levels - 1):
        whole = pairs[-1].where("first_name is not null and second_name is not null")
        block = _name(F.col("first_name"), F.col("second_name")).alias("name")
        pairs.append(stored(halves(whole.select("conv_id", "size", "at", block), "name")))
    # A sequence never fills the highest segment, so the end of that needs no name.
    segments = (
        pairs[0]
        .where("at = 0")
        .select("conv_id", "size", "at", _root().alias("before"), F.lit(None).cast("binary").alias("end"))
    )
    for level in range(levels - 1, -1, -1):
        # Where the first half is not whole there is nothing to cut, and no second half.
        cut = segments.join(pairs[level].drop("size"), ["conv_id", "at"], "left").withColumn(
            "cut", F.when(F.col("first_name").isNotNull(), _name(F.col("before"), F.col("first_name")))
        )
        parts = [
            F.struct(
                (F.col("at") * 2 + number).alias("at"),
                F.col(before).alias("before"),
                F.col(end).alias("end"),
                (F.lit(None).cast("long") if level else F.col(f"{side}_words")).alias("words"),
            )
            for number, side, before, end in ((0, "first", "before", "cut"), (1, "second", "cut", "end"))
        ]
        segments = stored(
            cut.select("conv_id", "size", F.explode(F.array(*parts)).alias("part"))
            .where(F.shiftleft(F.col("part.at"), level) < F.col("size"))
            .select("conv_id", "size", "part.*")
        )
    return segments.select(
        "conv_id",
        (F.col("at") + 1).alias("depth"),
        F.col("before").alias("parent"),
        F.col("end").alias("node"),
        "words",
        "size",
    )


# --- totals ---------------------------------------------------------------------------------------

TOTALS = ("n_leaves", "saved_tokens")


def grafts(nodes: DataFrame, paths: DataFrame, levels: int) -> list[DataFrame]:
    """What each node (node, conv_id, depth, totals of its own) receives from below: (node, depth, totals).

    In the round for a level the roots of the lower trees, at odd multiples of 2^level, have the totals of
    their tree: their own and what earlier rounds gave them. They give them to the 2^level nodes above.
    ``paths`` are (conv_id, depth, node, size).
    """
    made: list[DataFrame] = []
    for level in range(levels):
        half = 1 << level
        is_root = F.col("depth") % (2 * half) == half
        totals = nodes.where(is_root).select("node", "conv_id", "depth", *TOTALS)
        for graft in made:
            empty = F.lit(None).cast("long").alias("conv_id")
            totals = totals.unionByName(graft.where(is_root).select("node", empty, "depth", *TOTALS))
        if made:
            totals = totals.groupBy("node", "depth").agg(
                F.max("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in TOTALS]
            )
        step = min(half, BLOCK)
        above = F.sequence(F.expr(f"(depth - {half}) div {step}"), F.expr(f"depth div {step} - 1"))
        given = totals.select("conv_id", *TOTALS, F.explode(above).alias("block"))
        upper = paths.where(f"depth div {half} % 2 = 0 and (depth div {half} + 1) * {half} <= size")
        received = (
            upper.select("conv_id", "depth", "node", F.expr(f"depth div {step}").alias("block"))
            .join(given, ["conv_id", "block"])
            .groupBy("node", "depth")
            .agg(*[F.sum(c).alias(c) for c in TOTALS])
        )
        made.append(stored(received))
    return made


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, ends_sha256) of rows (node, bucket, ids) that come sorted; one string of ids is held at a time."""
    node, state = None, hashlib.sha256()
    for batch in batches:
        nodes, digests = [], []
        for own, ids in zip(batch["node"], batch["ids"], strict=True):
            if own == node:
                state.update(b",")
            else:
                if node is not None:
                    nodes.append(node)
                    digests.append(state.hexdigest())
                node, state = own, hashlib.sha256()
            state.update(ids.encode())
        if nodes:
            yield pd.DataFrame({"node": nodes, "ends_sha256": digests})
    if node is not None:
        yield pd.DataFrame({"node": [node], "ends_sha256": [state.hexdigest()]})


def ends(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): digest of the ids of a node, rising and comma-joined."""
    bucket = F.shiftright("conv_id", BLOCK.bit_length() - 1).alias("bucket")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    strings = members.groupBy("node", bucket).agg(joined.alias("ids"))
    ordered = strings.repartition("node").sortWithinPartitions("node", "bucket")
    return ordered.mapInPandas(_digests, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, head: int = HEAD) -> DataFrame:
    """One row for each distinct sequence of first turns (role, text) of the rebuilt conversations.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest
    member and the depth stand for the node. Null roles and texts are empty ones, of no words. Turns stand in
    order of ``turn``, null first; rows of one turn in a fixed order, by a hash of role and text, and repeated
    rows are turns each. Rows without a conversation id are in none. A family's first conversation that is not
    there gives no turns; remainders have the sign of the id. A conversation left without turns is a member of
    the root, which is there unless the table is empty: that gives no rows. Texts of any length are hashed and
    counted whole where they are read; further columns are ignored.
    """
    sequences, rows = rebuilt(stored(numbered(turns(conversations))), family, head)
    longest = sequences.agg(F.max("size")).first()[0] or 0
    levels = int(longest).bit_length()
    whole = edges(rows, levels) if levels else None
    members = sequences.where("size = 0").select(_root().alias("node"), "conv_id")
    root = sequences.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nodes = root.select(
        _root().alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("words"), "conv_id", "n_convs",
    )
    if whole is not None:
        members = members.unionByName(whole.where("depth = size").select("node", "conv_id"))
        below = whole.groupBy("node", "parent", "depth", "words").agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")
        )
        nodes = nodes.unionByName(below)
    nodes = stored(nodes)
    children = (
        nodes.where("parent is not null")
        .groupBy(F.col("parent").alias("node"))
        .agg(F.count("*").alias("n_children"))
    )
    nodes = stored(
        nodes.join(children, "node", "left").select(
            "node", "parent", "conv_id", "depth", "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        )
    )
    below = nodes.where("depth > 0")
    received = grafts(below, whole.select("conv_id", "depth", "node", "size"), levels) if levels else []
    # The root is above all nodes.
    everything = below.agg(*[F.sum(c).alias(c) for c in TOTALS]).select(_root().alias("node"), *TOTALS)
    parts = [nodes, everything, ends(members), *[graft.drop("depth") for graft in received]]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part, allowMissingColumns=True)
    totals = together.groupBy("node").agg(
        *[F.max(c).alias(c) for c in ("parent", "conv_id", "depth", "n_convs", "n_children", "ends_sha256")],
        *[F.sum(c).alias(c) for c in TOTALS],
    )
    named = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # An empty table has sums of nothing, but no root.
    return totals.where("conv_id is not null").join(named, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *TOTALS,
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH own AS (
    SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn
    FROM conversations WHERE conv_id IS NOT NULL
),
placed AS (
    SELECT c, name, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, name) - 1 AS pos FROM own
),
heads AS (
    SELECT c, count(*) AS size, c - c % 20 AS base,
        xor(list_reduce(
            list_prepend(4294967295, [ascii(x) FOR x IN string_split(CAST(c AS VARCHAR), '')]),
            lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                lambda a, x: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 4 AS h
    FROM own GROUP BY c
),
rebuilt AS (
    SELECT heads.c, placed.name, placed.words, placed.pos
    FROM heads JOIN placed ON placed.c = heads.base WHERE placed.pos < heads.h
    UNION ALL
    SELECT heads.c, placed.name, placed.words, placed.pos + 4
    FROM heads JOIN placed ON placed.c = heads.c WHERE placed.pos >= heads.h
),
sequences AS (
    SELECT heads.c, coalesce(list(name ORDER BY pos) FILTER (name IS NOT NULL), []) AS names,
        coalesce(list(words ORDER BY pos) FILTER (name IS NOT NULL), []) AS words
    FROM heads LEFT JOIN rebuilt ON rebuilt.c = heads.c GROUP BY heads.c
),
prefixes AS (SELECT c, names, words, unnest(range(0, len(names) + 1)) AS depth FROM sequences),
nodes AS (
    SELECT array_to_string(names[1:depth], '') AS path, depth, min(c) AS conv_id, count(*) AS n_convs,
        (count(*) - 1) * coalesce(any_value(words[depth]), 0) AS saved,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(names) = depth), '')) AS ends_sha256
    FROM prefixes GROUP BY ALL
),
children AS (
    SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
),
grown AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
above AS (
    SELECT left(path, 32 * unnest(range(0, depth + 1))) AS path, saved, CAST(n_children = 0 AS BIGINT) AS leaf FROM grown
),
totals AS (SELECT path, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM above GROUP BY path)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, g.n_convs, g.n_children,
    CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, g.ends_sha256
FROM grown g JOIN totals t USING (path)
LEFT JOIN nodes p ON g.depth > 0 AND p.path = left(g.path, 32 * (g.depth - 1))
"""
