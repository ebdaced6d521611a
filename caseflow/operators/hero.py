"""Headline counts and cycle times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseflow.functions.constants import (
    ACTIVE,
    ACTIVE_REQUESTS,
    AVERAGE_CYCLE_TIME,
    COMPLETED,
    COMPLETED_REQUESTS,
    FASTEST_CYCLE_TIME,
    TOTAL_REQUESTS,
)
from caseflow.operators.scope import Scope, scoped_steps


def org_codes(steps: DataFrame) -> DataFrame:
    """Distinct organisation codes."""
    return steps.where(F.col("org_code").isNotNull()).select("org_code").distinct()


def _metric(name: str, value: Column) -> list[Column]:
    return [F.lit(name).alias("metric"), value.alias("count")]


def _count_cases(steps: DataFrame, name: str) -> DataFrame:
    return steps.agg(F.count_distinct("case_number").alias("cases")).select(
        *_metric(name, F.col("cases"))
    )


def hero_total_requests(steps: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Number of cases."""
    return _count_cases(scoped_steps(steps, scope), TOTAL_REQUESTS)


def hero_total_requests_compat(steps: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Number of cases under the literal predicate of the source report.

    That predicate demands that the organisation equals every requested one and
    also ``Org 1``, so the count is 0 unless ``Org 1`` is the only one. Without
    requested organisations, all codes present in the table count as requested.
    """
    org = F.col("org_code")
    only = F.lit("Org 1")
    dated = scope.date_condition(steps)
    if scope.orgs is not None:
        wanted = dated & (org == only)
        for code in scope.orgs:
            wanted &= org == code
        return _count_cases(steps.where(wanted), TOTAL_REQUESTS)
    per_case = (
        steps.where(org.isNotNull())
        .groupBy("case_number")
        .agg(
            F.max(F.when(dated & (org == only), 1)).alias("counted"),
            F.max(F.when(org != only, 1)).alias("other_org"),
        )
    )
    cases = F.count(F.when(F.col("counted") == 1, F.col("case_number")))
    alone = F.count("other_org") == 0
    return per_case.agg(F.when(alone, cases).otherwise(0).alias("cases")).select(
        *_metric(TOTAL_REQUESTS, F.col("cases"))
    )


def hero_active_requests(steps: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Number of active cases."""
    active = scoped_steps(steps, scope).where(F.col("case_status") == ACTIVE)
    return _count_cases(active, ACTIVE_REQUESTS)


def hero_completed_requests(steps: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Number of completed cases."""
    completed = scoped_steps(steps, scope).where(F.col("case_status") == COMPLETED)
    return _count_cases(completed, COMPLETED_REQUESTS)


def hero_avg_cycle_time(steps: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Average over cases of the case's largest total cycle time."""
    per_case = scoped_steps(steps, scope).groupBy("case_number").agg(
        F.max("total_cycle_time").alias("cycle_time")
    )
    return per_case.agg(F.avg("cycle_time").alias("value")).select(
        *_metric(AVERAGE_CYCLE_TIME, F.col("value"))
    )


def hero_fastest_cycle_time(steps: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Smallest positive total cycle time of a completed case."""
    per_case = (
        scoped_steps(steps, scope)
        .where(F.col("case_status") == COMPLETED)
        .groupBy("case_number")
        .agg(F.max("total_cycle_time").alias("cycle_time"))
    )
    positive = per_case.where(F.col("cycle_time") > 0)
    return positive.agg(F.min("cycle_time").alias("value")).select(
        *_metric(FASTEST_CYCLE_TIME, F.col("value"))
    )


def hero_stats(steps: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """The five headline metrics, from one scan and one shuffle by case."""
    status = F.col("case_status")
    per_case = scoped_steps(steps, scope).groupBy("case_number").agg(
        F.max(F.when(status == ACTIVE, 1)).alias("active"),
        F.max(F.when(status == COMPLETED, 1)).alias("completed"),
        F.max("total_cycle_time").alias("cycle_time"),
        F.max(F.when(status == COMPLETED, F.col("total_cycle_time"))).alias("completed_time"),
    )
    case = F.col("case_number")
    totals = per_case.agg(
        F.count(case).alias("total"),
        F.count(F.when(F.col("active") == 1, case)).alias("active"),
        F.count(F.when(F.col("completed") == 1, case)).alias("completed"),
        F.avg("cycle_time").alias("average"),
        F.min(F.when(F.col("completed_time") > 0, F.col("completed_time"))).alias("fastest"),
    )
    rows = {
        TOTAL_REQUESTS: "total",
        ACTIVE_REQUESTS: "active",
        COMPLETED_REQUESTS: "completed",
        AVERAGE_CYCLE_TIME: "average",
        FASTEST_CYCLE_TIME: "fastest",
    }
    cells = [
        cell
        for metric, column in rows.items()
        for cell in (F.lit(metric), F.col(column).cast("double"))
    ]
    return totals.select(F.stack(F.lit(len(rows)), *cells).alias("metric", "value"))
