"""Connected components as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least node of its component.

    Alternates large-star and small-star steps until the links no longer change, a number of rounds
    logarithmic in the number of nodes. Only minima are gathered by node, so a node with very many
    links costs one row for each input partition; each round is written to the shared folder.
    """
    edges = stored(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        larger = larger.where("a != b").distinct()
        least = larger.groupBy("a").agg(F.min("b").alias("m"))
        hooked = larger.join(least, "a")
        edges = stored(
            hooked.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a != b")
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        ).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
