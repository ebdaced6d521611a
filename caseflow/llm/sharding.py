"""Balanced label propagation: equal texts move to one shard while all shards stay equal.

Documents with equal texts are linked. What moves are counts: the documents of a group that lie in one
shard are alike, so the state is (group, shard, n). Groups that matter for a shard's balance, of over a
tenth of a shard, are few; they are placed first and exactly: in their favourite shard with room for
them, or in as few shards as have room. All others move in rounds, a group as a whole, to the favourite
of the shards with room left. The numbers that want to move between shards, at most shards squared, give
each shard's quota: what leaves it plus what room it has. At the end a shard keeps as many documents of
its label as its equal share, and the rest, in the order of labels and groups, fills what other shards
lack. So fewer small groups than shards are cut, and of the large ones only those that no shard had room for.

DataFrame functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.llm.common import stored, table, texts, width

SHARDS = 40
ROUNDS = 4
SLACK = 0.05
#: A group of more than a shard's share over this is placed exactly: fewer than LARGE * shards groups.
LARGE = 10


def favourites(state: DataFrame, rooms: list[float]) -> DataFrame:
    """(group, best, total): of the shards with room, else of all, that with most of a group; ties by a hash."""
    open_ = F.get(F.array(*[F.lit(room > 0) for room in rooms]), F.col("shard"))
    rank = F.struct(open_.alias("open"), "n", F.xxhash64("group", "shard"))
    return state.groupBy("group").agg(F.max_by("shard", rank).alias("best"), F.sum("n").alias("total"))


def targets(total: int, shards: int) -> list[int]:
    """The sizes of the shards, at most one apart."""
    return [(at + 1) * total // shards - at * total // shards for at in range(shards)]


def large_parts(cells: dict[int, dict[int, int]], sizes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(group, from, upto, shard, slot): where the places of each large group (shard to n) go, exactly.

    A group goes to its favourite of the shards with room for all of it, else to those with most room.
    """
    rooms, parts = list(sizes), []
    for group, own in sorted(cells.items(), key=lambda item: (-sum(item[1].values()), item[0])):
        left, done = sum(own.values()), 0
        while left:
            whole = [shard for shard, room in enumerate(rooms) if room >= left]
            key = (lambda s: (own.get(s, 0), rooms[s], s)) if whole else (lambda s: (rooms[s], own.get(s, 0), s))
            shard = max(whole or range(len(rooms)), key=key)
            taken = min(left, rooms[shard])
            parts.append((group, done, done + taken, shard, sizes[shard] - rooms[shard]))
            rooms[shard] -= taken
            done, left = done + taken, left - taken
    return parts


def shares(moves: dict[tuple[int, int], int], sizes: dict[int, int], shards: int) -> list[float]:
    """Which part of those who want to come each shard admits.

    A shard's quota is its room below its capacity, the equal share and some slack, plus what may leave
    it; what may leave depends on the other shards, so the shares are lowered until they agree. The
    slack lets documents move at all where all shards are full; the last cut makes sizes equal again.
    """
    capacity = (1 + SLACK) * sum(sizes.values()) / shards
    admitted = [1.0] * shards
    coming = [sum(n for (_, b), n in moves.items() if b == shard) for shard in range(shards)]
    for _ in range(50):
        leaving = [0.0] * shards
        for (a, b), n in moves.items():
            leaving[a] += n * admitted[b]
        for shard in range(shards):
            room = max(0.0, capacity - sizes.get(shard, 0) + leaving[shard])
            admitted[shard] = min(admitted[shard], room / coming[shard] if coming[shard] else 1.0)
    return admitted


def propagated(groups: DataFrame, shards: int, taken: list[int], sizes: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(group, label) from (group, shard, n), the state at the start; ``taken`` of each shard is not theirs."""
    state = groups
    loads = {row["shard"]: row["n"] for row in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    rooms = [sizes[at] - taken[at] - loads.get(at, 0) for at in range(shards)]
    for turn in range(rounds):
        # A group whose best shard is too full leaves it with the share of what is too much, to shards with room.
        over = [max(0.0, -room) / max(1, loads.get(at, 0)) for at, room in enumerate(rooms)]
        free = [max(0.0, room) for room in rooms]
        reach = [sum(free[: at + 1]) / max(1.0, sum(free)) for at in range(shards)]

        def lot(name: str, turn: int = turn) -> Column:
            return F.pmod(F.xxhash64("group", F.lit(turn), F.lit(name)), F.lit(1 << 20)) / float(1 << 20)

        def of(values: list[float], at: Column) -> Column:
            return F.get(F.array(*[F.lit(float(x)) for x in values]), at)

        elsewhere = F.size(F.filter(F.array(*[F.lit(x) for x in reach]), lambda x: x <= lot("where")))
        leaves = (lot("out") < of(over, F.col("best"))) & (elsewhere < shards)
        wishes = favourites(state, rooms).select(
            "group", F.when(leaves, elsewhere).otherwise(F.col("best")).alias("best")
        )
        wanted = stored(state.join(wishes, "group"))
        flows = wanted.groupBy("shard", "best").agg(F.sum("n").alias("n")).collect()  # shards squared
        full = {at: taken[at] + loads.get(at, 0) for at in range(shards)}
        moves = {(r["shard"], r["best"]): r["n"] for r in flows if r["shard"] != r["best"]}
        if not moves:
            break
        admitted = of(shares(moves, full, shards), F.col("best"))
        moved = F.when(lot("in") < admitted, F.col("best")).otherwise(F.col("shard"))
        state = stored(
            wanted.select("group", moved.alias("shard"), "n")
            .groupBy("group", "shard")
            .agg(F.sum("n").alias("n"))
        )
        loads = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        rooms = [sizes[at] - taken[at] - loads.get(at, 0) for at in range(shards)]
    return favourites(state, [0.0] * shards).select("group", F.col("best").alias("label"))


def ranked(frame: DataFrame, by: str, bucket: Column, order: list[str]) -> DataFrame:
    """``frame`` with ``at``, the place of a row among those of its ``by``: of the buckets before, and its own."""
    frame = frame.withColumn("bucket", bucket)
    before = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = frame.groupBy(by, "bucket").count()
    firsts = sizes.select(by, "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy(by, "bucket").orderBy(*order)
    return (
        frame.withColumn("own", F.row_number().over(own) - 1)
        .join(firsts, [by, "bucket"])
        .withColumn("at", (F.col("first") + F.col("own")).cast("long"))
        .drop("bucket", "own", "first")
    )


def placed(frame: DataFrame, shards: int, taken: list[int], sizes: list[int]) -> DataFrame:
    """``shard`` and ``slot`` for the rows (with ``label``) of small groups, after the ``taken`` slots."""
    splits = width(frame.sparkSession)
    counts = {r["label"]: r["count"] for r in frame.groupBy("label").count().collect()}  # shards
    keep = [min(counts.get(at, 0), sizes[at] - taken[at]) for at in range(shards)]
    surplus, lack = [0], [0]
    for at in range(shards):
        surplus.append(surplus[-1] + counts.get(at, 0) - keep[at])
        lack.append(lack[-1] + sizes[at] - taken[at] - keep[at])

    def of(values: list[int], at: Column) -> Column:
        return F.get(F.array(*[F.lit(x).cast("long") for x in values]), at)

    bucket = F.pmod(F.xxhash64("group"), F.lit(splits))
    rows = ranked(frame, "label", bucket, ["group", "doc_id", "text_crc32", "size"])
    stays = F.col("at") < of(keep, F.col("label"))
    number = of(surplus, F.col("label")) + F.col("at") - of(keep, F.col("label"))
    other = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in lack[1:]]), lambda x: x <= F.col("number")))
    rows = rows.withColumn("number", number)
    rows = rows.withColumn("shard", F.when(stays, F.col("label")).otherwise(other).cast("int"))
    begin = F.when(stays, of(taken, F.col("shard")) + F.col("at")).otherwise(
        of([t + k for t, k in zip(taken, keep, strict=True)], F.col("shard")) + F.col("number") - of(lack, F.col("shard"))
    )
    return rows.withColumn("slot", begin.cast("long"))


def sharded(
    docs: DataFrame, shards: int = SHARDS, text_column: str = "text", rounds: int = ROUNDS
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, text_group) for each document; sizes at most one apart.

    ``size`` is the UTF-8 length of the text plus 16. A null text counts as empty, and all empty texts as
    equal. Repeated rows are placed each, together; a null id stays null; an empty table gives no rows;
    further columns are ignored.
    """
    spark, text = docs.sparkSession, F.col("text")
    base = texts(docs, text_column=text_column).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
    )
    base = stored(base.withColumn("shard", F.pmod(F.xxhash64("doc_id", "group"), F.lit(shards)).cast("int")))
    cells = stored(base.groupBy("group", "shard").agg(F.count("*").alias("n")))
    total = cells.agg(F.sum("n")).first()[0] or 0
    sizes = targets(total, shards)
    large = cells.groupBy("group").agg(F.sum("n").alias("all")).where(F.col("all") * LARGE * shards > total)
    large = F.broadcast(stored(large.select("group")))  # fewer than LARGE * shards rows
    own: dict[int, dict[int, int]] = {}
    for row in cells.join(large, "group").collect():
        own.setdefault(row["group"], {})[row["shard"]] = row["n"]
    parts = large_parts(own, sizes)
    taken = [sum(upto - first for _, first, upto, to, _ in parts if to == at) for at in range(shards)]

    labels = propagated(stored(cells.join(large, "group", "left_anti")), shards, taken, sizes, rounds)
    small = stored(base.drop("shard").join(large, "group", "left_anti").join(labels, "group"))
    names = ("part", "from", "upto", "shard", "start")
    rows = json.dumps([dict(zip(names, part, strict=True)) for part in parts])
    kind = "array<struct<part:bigint,from:bigint,upto:bigint,shard:int,start:bigint>>"
    where = F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(rows), kind))))
    salt = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(width(spark)))
    many = ranked(base.drop("shard").join(large, "group"), "group", salt, ["doc_id", "text_crc32", "size"])
    inside = (F.col("group") == F.col("part")) & (F.col("at") >= F.col("from")) & (F.col("at") < F.col("upto"))
    many = many.join(where, inside).withColumn("slot", F.col("start") + F.col("at") - F.col("from"))
    out = ["doc_id", "size", "text_crc32", "shard", "slot", F.col("group").alias("text_group")]
    return placed(small, shards, taken, sizes).select(*out).unionByName(many.select(*out))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
