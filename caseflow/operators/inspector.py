"""Case inspector: days per role and step of each case, and its legend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from caseflow.functions.columns import as_of_column, case_suffix, lookup, standard_columns
from caseflow.functions.constants import (
    CASE_TOTAL_MAX,
    CASE_TOTAL_MIN,
    DETAIL_STEP_STANDARDS,
    INSPECTOR_ROLE_STANDARDS,
    OUTLIER_DAYS,
    ROLE_COLORS,
    ROLE_LEGEND_TITLE,
    STEP_COLORS,
    STEP_LEGEND_TITLE,
    TOTAL_LEGEND,
    TOTAL_LEGEND_TITLE,
)
from caseflow.functions.units import DurationUnits
from caseflow.operators.durations import AsOf
from caseflow.operators.scope import Scope, scoped_steps


def _case_units(steps: DataFrame, days: DurationUnits, as_of: AsOf) -> DataFrame:
    # Units of the whole case, also of its visits out of scope.
    totals = steps.groupBy("case_number").agg(
        F.sum(days.aged(as_of_column(as_of))).alias("total_units")
    )
    return totals.where(F.col("total_units") < OUTLIER_DAYS * days.per_whole)


def _activity(steps: DataFrame, scope: Scope, as_of: AsOf) -> DataFrame:
    days = DurationUnits.of_days(steps)
    # Visits are summed with keys that spread a large case. The few sums left
    # are gathered by case: join, split and final sum then need no shuffle.
    sums = (
        scoped_steps(steps, scope)
        .groupBy("case_number", "case_status", "role", "step_name")
        .agg(F.sum(days.aged(as_of_column(as_of))).alias("units"))
        .repartition("case_number")
    )
    # Each visit counts once for its role and once for its step.
    halves = F.array(
        F.struct(F.lit("Role").alias("type"), F.col("role").alias("name")),
        F.struct(F.lit("Step").alias("type"), F.col("step_name").alias("name")),
    )
    rows = (
        sums.join(_case_units(steps, days, as_of), "case_number")
        .select("case_number", "case_status", "total_units", "units", F.inline(halves))
        .groupBy("case_number", "type", "name", "case_status", "total_units")
        .agg(F.sum("units").alias("units"))
    )
    name = F.col("name")
    is_role = F.col("type") == "Role"
    role_min, role_max = standard_columns(INSPECTOR_ROLE_STANDARDS, name)
    step_min, step_max = standard_columns(DETAIL_STEP_STANDARDS, name)
    return rows.select(
        F.col("case_status").alias("is_active"),
        days.value(F.col("total_units")).alias("total_time"),
        F.lit(CASE_TOTAL_MIN).alias("total_min"),
        F.lit(CASE_TOTAL_MAX).alias("total_max"),
        F.col("case_number").alias("asap"),
        name,
        F.when(is_role, lookup(ROLE_COLORS, name))
        .otherwise(lookup(STEP_COLORS, name))
        .alias("color"),
        days.value(F.col("units")).alias("duration_days"),
        "type",
        F.when(is_role, role_min).otherwise(step_min).alias("standard_min"),
        F.when(is_role, role_max).otherwise(step_max).alias("standard_max"),
    )


def inspector_rows(steps: DataFrame, scope: Scope = Scope(), as_of: AsOf = None) -> DataFrame:
    """One row per case and role and per case and step, ordered by case number and name.

    Cases without a number come last. Equal places are ordered by case and type,
    so that many such cases still sort in many tasks.
    """
    return _activity(steps, scope, as_of).orderBy(
        F.asc_nulls_last(case_suffix(F.col("asap"))), F.asc_nulls_last("name"), "asap", "type"
    )


def inspector_nested(steps: DataFrame, scope: Scope = Scope(), as_of: AsOf = None) -> DataFrame:
    """One row per case with its ``roles`` and ``steps``, each ordered by name.

    An array holds one entry per distinct role or step of the case, not one per
    visit: visits are summed before they are nested.
    """

    def entries(kind: str):
        entry = F.struct(
            F.col("name").isNull().alias("nameless"),
            "name",
            "type",
            "color",
            "duration_days",
            "standard_min",
            "standard_max",
        )
        ordered = F.array_sort(F.collect_list(F.when(F.col("type") == kind, entry)))
        return F.transform(ordered, lambda item: item.dropFields("nameless"))

    keys = ("is_active", "total_time", "total_min", "total_max", "asap")
    return _activity(steps, scope, as_of).groupBy(*keys).agg(
        entries("Role").alias("roles"), entries("Step").alias("steps")
    )


def _legend(steps: DataFrame, column: str, colors: dict[str, str]) -> DataFrame:
    names = steps.select(F.col(column).alias("name")).distinct()
    return names.select("name", lookup(colors, F.col("name")).alias("color"))


def legend_steps(steps: DataFrame) -> DataFrame:
    """Distinct steps, also the missing one, with their colours."""
    return _legend(steps, "step_name", STEP_COLORS)


def legend_roles(steps: DataFrame) -> DataFrame:
    """Distinct roles, also the missing one, with their colours."""
    return _legend(steps, "role", ROLE_COLORS)


def activity_legend(steps: DataFrame) -> DataFrame:
    """The three legend blocks (steps, total time, roles) as flat rows with their ``position``.

    The bands of the total time keep their fixed order; steps and roles follow their names, the
    missing one last.
    """
    by_name = Window.partitionBy("block_no").orderBy(F.asc_nulls_last("name"))

    def block(number: int, title: str, rows: DataFrame) -> DataFrame:
        return rows.select(
            F.lit(number).alias("block_no"), F.lit(title).alias("title"), "name", "color"
        ).withColumn("position", F.row_number().over(by_name))

    bands = F.array(
        *(
            F.struct(
                F.lit(2).alias("block_no"),
                F.lit(TOTAL_LEGEND_TITLE).alias("title"),
                F.lit(name).alias("name"),
                F.lit(color).alias("color"),
                F.lit(position).alias("position"),
            )
            for position, (name, color) in enumerate(TOTAL_LEGEND.items(), 1)
        )
    )
    static = steps.sparkSession.range(1).select(F.inline(bands))
    return (
        block(1, STEP_LEGEND_TITLE, legend_steps(steps))
        .unionByName(static)
        .unionByName(block(3, ROLE_LEGEND_TITLE, legend_roles(steps)))
    )


def activity_legend_nested(steps: DataFrame) -> DataFrame:
    """The legend with one row per block and its entries in ``rows``, in the order of the flat form."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "name", "color")))
    return activity_legend(steps).groupBy("block_no", "title").agg(
        F.transform(ordered, lambda item: item.dropFields("position")).alias("rows")
    )
