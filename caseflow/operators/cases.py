"""Per-case detail: headline, timeline, users and on-time ratio."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from caseflow.functions.columns import within_limit
from caseflow.functions.constants import COMPLETED, ON_TIME_LIMITS
from caseflow.functions.units import DurationUnits
from caseflow.operators.durations import totals_by_case
from caseflow.operators.scope import one_case

Limits = Mapping[str, tuple[str, int]]


def _detail(steps: DataFrame, asap: str | None, compat: bool) -> DataFrame:
    # One scan. Rows are first merged per (case, status, created), which for
    # well-formed data is one row per case; only these merged rows enter the
    # window that adds up the few tuples of a case.
    is_open = F.col("date_out").isNull()
    days = DurationUnits.of_days(steps)
    tuples = one_case(steps, asap).groupBy("case_number", "case_status", "case_created").agg(
        F.count(F.when(is_open, F.col("step_name"))).alias("open_named"),
        F.count(F.when(~is_open, F.col("step_name"))).alias("done_named"),
        F.count(F.when(is_open, 1)).alias("open_rows"),
        F.sum("total_cycle_time").alias("total_sum"),
        F.count("total_cycle_time").alias("total_count"),
        F.sum(days.stored()).alias("days_sum"),
        F.count("cycle_days").alias("days_count"),
        F.max(F.when(F.col("case_status") == COMPLETED, F.col("date_out"))).alias("last_out"),
    )
    case = Window.partitionBy("case_number")

    def case_sum(column: str):
        return F.sum(column).over(case)

    remaining = case_sum("open_named")
    completed = case_sum("done_named")
    if compat:
        completed = F.when(case_sum("open_rows") > 0, remaining)
    return tuples.select(
        F.col("case_number").alias("asap"),
        remaining.alias("remaining"),
        completed.alias("completed"),
        F.try_divide(case_sum("total_sum"), case_sum("total_count").cast("double")).alias(
            "total_cycle_time"
        ),
        F.try_divide(
            days.value(case_sum("days_sum")), case_sum("days_count").cast("double")
        ).alias("avg_cycle_time"),
        F.col("case_status").alias("is_active"),
        F.col("case_created").alias("date_start"),
        F.max("last_out").over(case).alias("date_end"),
    )


def detail_hero(steps: DataFrame, asap: str | None = None) -> DataFrame:
    """Open and finished steps, cycle times, status and dates of each case.

    A case with several statuses or creation dates has one row for each pair.
    ``total_cycle_time`` is a mean of doubles, so its last digit may depend on
    the order of rows if the totals are not whole numbers.
    """
    return _detail(steps, asap, compat=False)


def detail_hero_compat(steps: DataFrame, asap: str | None = None) -> DataFrame:
    """As :func:`detail_hero` with the source report's literal ``completed``.

    There it counts the open steps again, and is NULL for a case without any.
    """
    return _detail(steps, asap, compat=True)


def asap_detail(steps: DataFrame, asap: str | None = None) -> DataFrame:
    """Timeline of a case, ordered by time; of all cases, without an order.

    Visits at the same moment follow their step id, so that the order is fixed
    and one frequent moment does not have to be sorted by one task.
    """
    visits = one_case(steps, asap).where(F.col("date_in").isNotNull())
    if asap is not None:
        visits = visits.orderBy("date_in", "step_id")
    return visits.select(
        "case_number",
        F.col("date_in").alias("action_time"),
        F.col("assigned_to").alias("user"),
        "role",
        "step_name",
        "action_name",
    )


def user_time(steps: DataFrame, asap: str | None = None) -> DataFrame:
    """Stored days summed by case and user; visits without stored days are left out."""
    return totals_by_case(steps, "assigned_to", asap).select(
        F.col("assigned_to").alias("asap_user"),
        F.col("total_days").alias("user_time"),
        F.col("case_number").alias("asap"),
    )


def completed_steps(steps: DataFrame) -> DataFrame:
    """Number of distinct finished steps per case and creation date.

    Steps are made distinct first, with keys that spread a large case. What is
    left is gathered by case alone, so that a join on the case needs no further
    shuffle.
    """
    finished = steps.where(F.col("date_out").isNotNull())
    return (
        finished.select("case_number", "case_created", "step_name")
        .distinct()
        .repartition("case_number")
        .groupBy("case_number", "case_created")
        .agg(F.count("step_name").alias("completedsteps"))
    )


def step_times(steps: DataFrame) -> DataFrame:
    """Stored days summed by case and step."""
    days = DurationUnits.of_days(steps)
    return steps.groupBy("case_number", "step_name").agg(
        days.value(F.sum(days.stored())).alias("steptime")
    )


def step_standards(steps: DataFrame, limits: Limits = ON_TIME_LIMITS) -> DataFrame:
    """Days by case and step with 1 if they meet the step's on-time limit, else 0."""
    within = within_limit(limits, F.col("step_name"), F.col("steptime"))
    return step_times(steps).select("*", within.alias("withinstandards"))


def case_on_time_summary(steps: DataFrame, limits: Limits = ON_TIME_LIMITS) -> DataFrame:
    """Steps within their limit beside finished steps, per case and creation date.

    A case without any finished row has one row with NULLs. The limits name the steps that can meet one,
    so days are added up for these steps side by side, one row per case in each input partition, and no
    shuffle has a row per case and step. Only finished steps, which may have any name, are made distinct
    in a second scan. The join finds both sides gathered by case.
    """
    days = DurationUnits.of_days(steps)
    sums = [
        F.sum(F.when(F.col("step_name") == step, days.stored())).alias(f"units_{at}")
        for at, step in enumerate(limits)
    ]
    within = [
        within_limit({step: limit}, F.lit(step), days.value(F.col(f"units_{at}")))
        for at, (step, limit) in enumerate(limits.items())
    ]
    on_time = steps.groupBy("case_number").agg(*(sums or [F.count(F.lit(1))])).select(
        "case_number", sum(within, F.lit(0).cast("long")).alias("ontimesteps")
    )
    return on_time.join(completed_steps(steps), "case_number", "left").select(
        "case_number", "ontimesteps", "completedsteps", "case_created"
    )


def asap_list(steps: DataFrame, limits: Limits = ON_TIME_LIMITS) -> DataFrame:
    """On-time ratio of each case.

    NULL if the case has no finished row or none of them names a step. Repeated
    and open steps count as on time as well, so the ratio can exceed 1.
    """
    ratio = F.try_divide(
        F.col("ontimesteps").cast("double"), F.col("completedsteps").cast("double")
    )
    return case_on_time_summary(steps, limits).select(
        F.col("case_number").alias("asap"),
        ratio.alias("percent_completed_within_time"),
        F.col("case_created").alias("created_at"),
    )
