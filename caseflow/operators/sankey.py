"""Nodes and links of the flow diagram of cases through the steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseflow.functions.columns import lookup, standard_columns
from caseflow.functions.constants import FLOW_STEP_COLORS, FLOW_STEP_STANDARDS, NEXT_STEP
from caseflow.operators.scope import Scope, scoped_steps


def latest_completed_visit(steps: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Last finished visit per step and case in ``scope``."""
    finished = scoped_steps(steps, scope).where(
        F.col("date_in").isNotNull() & F.col("date_out").isNotNull()
    )
    return finished.groupBy("step_name", "case_number").agg(F.max("step_id").alias("step_id"))


def in_progress_by_step(steps: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Number of cases in ``scope`` that are now in each step."""
    running = scoped_steps(steps, scope).where(
        F.col("date_in").isNotNull() & F.col("date_out").isNull()
    )
    return running.groupBy("step_name").agg(F.count_distinct("case_number").alias("in_progress"))


def completed_by_step(steps: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Number of cases that have finished each step.

    Counts the rows of the whole table that carry the id of a latest visit, so
    a repeated step id brings in rows out of scope. Only distinct cases are
    counted, hence a semi join: it multiplies nothing, and a hot step id on the
    large side can be split.
    """
    latest = latest_completed_visit(steps, scope).select("step_id")
    return (
        steps.join(latest, "step_id", "left_semi")
        .groupBy("step_name")
        .agg(F.count_distinct("case_number").alias("completed"))
    )


def _joined(*parts: Column) -> Column:
    # A missing part reads as empty text.
    return F.concat_ws("", *parts)


def flow_counts(steps: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Cases per step, once for finished and once for running steps.

    At most two rows per step. Persist it to build nodes and links from one run.
    """
    done = completed_by_step(steps, scope).select(
        "step_name", F.lit(False).alias("running"), F.col("completed").alias("cases")
    )
    running = in_progress_by_step(steps, scope).select(
        "step_name", F.lit(True).alias("running"), F.col("in_progress").alias("cases")
    )
    return done.unionByName(running)


def _in_progress_name() -> Column:
    return _joined(F.col("step_name"), F.lit(" In Progress"))


def nodes_of(counts: DataFrame) -> DataFrame:
    """Diagram nodes from :func:`flow_counts`."""
    step = F.col("step_name")
    return counts.select(
        F.when(F.col("running"), _in_progress_name()).otherwise(step).alias("key"),
        _joined(step, F.lit(" ("), F.col("cases").cast("string"), F.lit(")")).alias("text"),
        lookup(FLOW_STEP_COLORS, step).alias("color"),
        *standard_columns(FLOW_STEP_STANDARDS, step),
    ).distinct()


def links_of(counts: DataFrame) -> DataFrame:
    """Diagram links from :func:`flow_counts`."""
    step = F.col("step_name")
    return counts.select(
        step.alias("from"),
        F.when(F.col("running"), _in_progress_name())
        .otherwise(lookup(NEXT_STEP, step))
        .alias("to"),
        F.col("cases").alias("width"),
    ).distinct()


def sankey_nodes(steps: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """One node per finished step and one per step in progress."""
    return nodes_of(flow_counts(steps, scope))


def sankey_links(steps: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Links from each step to the next one and to its node in progress."""
    return links_of(flow_counts(steps, scope))
