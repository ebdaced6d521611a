"""The ``case_steps`` table: one row per visit of a case to a step."""

from __future__ import annotations

from pyspark.sql import types as T

DURATION = T.DecimalType(18, 2)


def case_steps_schema(duration: T.DecimalType = DURATION) -> T.StructType:
    """Schema of ``case_steps`` with ``duration`` as type of the stored durations.

    A precision of at most 8 lets Catalyst sum the durations as plain longs.
    """
    return T.StructType(
        [
            T.StructField("case_number", T.StringType()),
            T.StructField("step_id", T.LongType()),
            T.StructField("step_name", T.StringType()),
            T.StructField("role", T.StringType()),
            T.StructField("assigned_to", T.StringType()),
            T.StructField("action_name", T.StringType()),
            T.StructField("date_in", T.TimestampNTZType()),
            T.StructField("date_out", T.TimestampNTZType()),
            T.StructField("cycle_days", duration),
            T.StructField("cycle_hours", duration),
            T.StructField("case_created", T.TimestampNTZType()),
            T.StructField("case_status", T.StringType()),
            T.StructField("total_cycle_time", T.DoubleType()),
            T.StructField("org_code", T.StringType()),
        ]
    )


CASE_STEPS = case_steps_schema()

# Partition column of stored tables: year * 100 + month of case_created.
CREATED_MONTH = "created_month"

# Column titles of the source table -> our column names.
SOURCE_COLUMNS = {
    "CASE_NUMBER": "case_number",
    "STEP_ID": "step_id",
    "Step Display Name": "step_name",
    "Role": "role",
    "Assigned To Display Name": "assigned_to",
    "Action Name": "action_name",
    "Date In": "date_in",
    "Date Out": "date_out",
    "Cycle Time - Days": "cycle_days",
    "Cycle Time - Hours": "cycle_hours",
    "ASAP CREATED": "case_created",
    "ASAP Status": "case_status",
    "ASAP Total Cycle Time": "total_cycle_time",
    "Org Code": "org_code",
}
