"""Duration statistics per role and step, and totals per case."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from caseflow.functions.columns import as_of_column, standard_columns
from caseflow.functions.constants import (
    DETAIL_STEP_STANDARDS,
    OUTLIER_DAYS,
    ROLE_STANDARDS,
    STEP_STANDARDS,
)
from caseflow.functions.units import DurationUnits
from caseflow.operators.scope import Scope, dated_steps, one_case, scoped_steps
from caseflow.schema import CREATED_MONTH

Standards = Mapping[str, tuple[int, int]]
AsOf = datetime | str | None


def effective_durations(steps: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Step visits with ``days`` and ``hours``, open ones aged until ``as_of``."""
    moment = as_of_column(as_of)
    return steps.select(
        *(name for name in steps.columns if name != CREATED_MONTH),
        DurationUnits.of_days(steps).aged_decimal(moment).alias("days"),
        DurationUnits.of_hours(steps).aged_decimal(moment).alias("hours"),
    )


def duration_stats(
    steps: DataFrame, key: str, standards: Standards, as_of: AsOf = None
) -> DataFrame:
    """Average, minimum and maximum days per ``key``, beside its standards.

    Partial aggregation leaves one row per name and input partition, so a name
    holding most rows costs no more in the shuffle than any other.
    """
    days = DurationUnits.of_days(steps)
    visits = steps.where(F.col(key).isNotNull()).select(
        F.col(key).alias("name"), days.aged(as_of_column(as_of)).alias("units")
    )
    stats = visits.groupBy("name").agg(
        days.average(F.col("units")).alias("average_duration"),
        days.value(F.min("units")).alias("min"),
        days.value(F.max("units")).alias("max"),
    )
    return stats.select("*", *standard_columns(standards, F.col("name")))


def totals_by_case(steps: DataFrame, key: str, asap: str | None = None) -> DataFrame:
    """Stored days summed by case and ``key``; visits without stored days are left out."""
    days = DurationUnits.of_days(steps)
    visits = one_case(steps, asap).where(F.col("cycle_days").isNotNull())
    return visits.groupBy("case_number", key).agg(
        days.value(F.sum(days.stored())).alias("total_days")
    )


def role_durations(
    steps: DataFrame,
    scope: Scope = Scope(),
    as_of: AsOf = None,
    standards: Standards = ROLE_STANDARDS,
) -> DataFrame:
    """Duration statistics per role for the cases in ``scope``."""
    return duration_stats(scoped_steps(steps, scope), "role", standards, as_of)


def role_durations_all_orgs(
    steps: DataFrame,
    scope: Scope = Scope(),
    as_of: AsOf = None,
    standards: Standards = ROLE_STANDARDS,
) -> DataFrame:
    """Duration statistics per role in the date range, whatever the organisation."""
    return duration_stats(dated_steps(steps, scope), "role", standards, as_of)


def step_durations(
    steps: DataFrame,
    scope: Scope = Scope(),
    as_of: AsOf = None,
    standards: Standards = STEP_STANDARDS,
) -> DataFrame:
    """Duration statistics per step for the cases in ``scope``."""
    return duration_stats(scoped_steps(steps, scope), "step_name", standards, as_of)


def role_totals_by_case(steps: DataFrame, asap: str | None = None) -> DataFrame:
    """Days per case and role. ``avg_role_time`` keeps its customary name; it is a sum."""
    return totals_by_case(steps, "role", asap).select(
        F.col("case_number").alias("asap"), "role", F.col("total_days").alias("avg_role_time")
    )


def step_totals_by_case(steps: DataFrame, asap: str | None = None) -> DataFrame:
    """Days per case and step. ``avg_role_time`` keeps its customary name; it is a sum."""
    return totals_by_case(steps, "step_name", asap).select(
        F.col("case_number").alias("asap"),
        F.col("step_name").alias("step"),
        F.col("total_days").alias("avg_role_time"),
    )


def _detail(
    steps: DataFrame,
    key: str,
    counted: Column,
    standards: Standards,
    asap: str | None,
    as_of: AsOf,
    slices: int | None,
) -> DataFrame:
    """``stats LEFT JOIN totals`` on the name, one row per name and case.

    ``counted`` tells which visits the statistics are made of. The left side has one row per name, the
    right one per case and name, so a plain left join would hash all totals onto a few names and could
    neither broadcast nor replicate the left side. The statistics therefore also learn which names have
    a total: those are joined inner, the others only get a NULL, and no further scan is needed. The
    engine may broadcast the statistics once it has measured them. Otherwise each name is spread over
    slices of the cases, so a hot name is shared by many tasks.
    """
    if slices is None:
        slices = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    days = DurationUnits.of_days(steps)
    with_total = F.col("cycle_days").isNotNull()
    if asap is not None:
        with_total &= F.col("case_number") == asap
    visits = steps.where(F.col(key).isNotNull()).select(
        F.col(key).alias("name"),
        F.coalesce(counted, F.lit(False)).alias("counted"),
        F.coalesce(with_total, F.lit(False)).alias("with_total"),
        F.when(counted, days.aged(as_of_column(as_of))).alias("units"),
    )
    stats = (
        visits.groupBy("name")
        .agg(
            days.average(F.col("units")).alias("average_duration"),
            days.value(F.min("units")).alias("min"),
            days.value(F.max("units")).alias("max"),
            F.max("counted").alias("counted"),
            F.max("with_total").alias("with_total"),
        )
        .where("counted")
        .drop("counted")
        .select("*", *standard_columns(standards, F.col("name")))
    )
    part = F.pmod(F.xxhash64("case_number"), F.lit(slices)).cast("int").alias("slice")
    totals = totals_by_case(steps, key, asap).select(
        F.col(key).alias("name"), part, F.col("total_days").alias("avg_time")
    )
    copies = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    matched = (
        stats.where("with_total").select("*", copies).join(totals, ["name", "slice"]).drop("slice")
    )
    unmatched = stats.where("not with_total").withColumn("avg_time", F.lit(None).cast("double"))
    return matched.unionByName(unmatched).drop("with_total")


def detail_role(
    steps: DataFrame,
    scope: Scope = Scope(),
    asap: str | None = None,
    as_of: AsOf = None,
    standards: Standards = ROLE_STANDARDS,
    slices: int | None = None,
) -> DataFrame:
    """Role statistics in the date range, beside the days per case of each role.

    ``avg_time`` keeps its customary name; it is a sum. The organisations of
    ``scope`` are not used. ``slices`` is how many tasks may share one role's
    totals; by default as many as the session's shuffle has partitions.
    """
    dated = scope.date_condition(steps)
    return _detail(steps, "role", dated, standards, asap, as_of, slices)


def detail_step(
    steps: DataFrame,
    scope: Scope = Scope(),
    asap: str | None = None,
    as_of: AsOf = None,
    standards: Standards = DETAIL_STEP_STANDARDS,
    slices: int | None = None,
) -> DataFrame:
    """As :func:`detail_role` by step, without visits of 1000 days or more."""
    days = DurationUnits.of_days(steps)
    short = days.aged(as_of_column(as_of)) < OUTLIER_DAYS * days.per_whole
    counted = scope.date_condition(steps) & short
    return _detail(steps, "step_name", counted, standards, asap, as_of, slices)
