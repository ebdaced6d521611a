"""A corpus pipeline: each stage takes documents and returns documents; the last packs them.

Further columns are carried by all stages but the last, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseflow.llm import decontamination, ngram_join, packing, pii, quality_rules
from caseflow.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality verdict is to keep.

    Null and empty texts go, texts of any length are measured whole, repeated rows stay or go together, a
    null id decides nothing.
    """
    return quality_rules.kept_documents(docs)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    That of the least id stays, of ties and repeated rows one; documents without words all stay. A text of
    any length gives its whole set of shingles.
    """
    return ngram_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark.

    Documents without text stay, repeated rows stay or go together; without items all stay.
    """
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what reveals it replaced in the text.

    A null text stays null, every row stays, repeated rows are replaced alike; texts are read whole.
    """
    return pii.sanitised(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence and offset of every piece of every document.

    A null or empty text is one end token, repeated rows are packed each, a null id stays null; only texts of
    more than a sequence are cut.
    """
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: The verdicts of the quality model and the packing plan are not SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what its predecessor kept, written in between."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stored(docs)
    return docs
