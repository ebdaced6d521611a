from decimal import Decimal

import pytest

from caseflow.operators import durations
from caseflow.operators.scope import Scope
from caseflow.schema import CASE_STEPS, case_steps_schema
from hand_rows import AS_OF, as_set, numbered_rows
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

SCOPE = Scope("2000-01-01", "2000-05-20", ["Org 1", "Org 2"])
STATS = ["name", "average_duration", "min", "max", "standard_min", "standard_max"]

ROLES = {
    ("Role 1", 2.73 / 5, -0.52, 1.0, 3, 9),
    ("Role 2", 1.8, 1.0, 3.0, 2, 4),
    ("Role 3", 275.0625, 1.0, 1096.0, 2, 6),
    ("Role 4", 1.125, 0.5, 1.75, 1, 3),
    ("Role 5", None, None, None, None, None),
    ("Role 9", 0.25, 0.25, 0.25, None, None),
}


def by_id(frame, step_id, case):
    return frame.where((F.col("step_id") == step_id) & (F.col("case_number") == case)).first()


def test_effective_durations(steps):
    aged = durations.effective_durations(steps, AS_OF)
    assert aged.columns == [*steps.columns, "days", "hours"]
    assert aged.schema["days"].dataType == steps.schema["cycle_days"].dataType

    def times(step_id, case):
        row = by_id(aged, step_id, case)
        return row.days, row.hours

    assert times(4, "Ticket 1") == (Decimal("1.25"), Decimal("30.00"))
    assert times(6, "Ticket 2") == (Decimal("1.75"), Decimal("42.00"))
    assert times(7, "Ticket 2") == (None, None)
    assert times(8, "Ticket 2") == (Decimal("0.75"), Decimal("18.00"))
    # -45000 seconds: cut toward zero, not down to -0.53.
    assert times(16, "Ticket 7") == (Decimal("-0.52"), Decimal("-12.50"))


def test_elapsed_time_keeps_the_time_of_day_and_is_cut(spark, steps):
    aged = durations.effective_durations(steps, "2002-01-01 00:00:59")
    # 1.75 days and 59 seconds: 1.7506..., 42.0163...
    row = by_id(aged, 6, "Ticket 2")
    assert (row.days, row.hours) == (Decimal("1.75"), Decimal("42.01"))


def test_as_of_defaults_to_now(steps):
    row = by_id(durations.effective_durations(steps), 10, "Ticket 4")
    assert row.days > 8000
    assert row.hours >= row.days * 24


def test_as_of_must_not_have_a_zone(steps):
    with pytest.raises(ValueError):
        durations.effective_durations(steps, "2002-01-01T00:00:00+00:00")


def test_session_zone_does_not_matter(spark, steps):
    wanted = as_set(durations.effective_durations(steps, AS_OF))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # The clock change of April 2000 lies between entry and as_of.
        assert as_set(durations.effective_durations(steps, AS_OF)) == wanted
        found = durations.role_durations(steps, as_of=AS_OF)
        assert as_set(found) == ROLES
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_role_durations(steps):
    found = durations.role_durations(steps, as_of=AS_OF)
    assert found.columns == STATS
    assert as_set(found) == ROLES


def test_role_durations_all_orgs(steps):
    found = durations.role_durations_all_orgs(steps, as_of=AS_OF)
    role_1 = ("Role 1", 3.73 / 6, -0.52, 1.0, 3, 9)
    assert as_set(found) == {row for row in ROLES if row[0] != "Role 1"} | {role_1}


def test_step_durations_in_scope(steps):
    found = durations.step_durations(steps, SCOPE, AS_OF)
    assert as_set(found) == {
        ("Step Display Name 1", 0.75, 0.5, 1.0, None, None),
        ("Step Display Name 2", 2.5, 2.0, 3.0, 1, 3),
        ("Step Display Name 3", 1.25, 1.25, 1.25, 1, 3),
        ("Step Display Name 4", 1.75, 1.75, 1.75, 1, 3),
        ("Step Display Name 5", None, None, None, 1, 3),
        ("Step Display Name 6", 0.75, 0.75, 0.75, 1, 1),
    }


def test_own_standards(steps):
    found = durations.role_durations(steps, as_of=AS_OF, standards={"Role 9": (7, 8)})
    assert {(row.name, row.standard_max) for row in found.collect()} >= {
        ("Role 9", 8),
        ("Role 1", None),
    }


def test_totals_by_case(steps):
    roles = as_set(durations.role_totals_by_case(steps))
    assert {row for row in roles if row[0] in ("Ticket 1", "Ticket 2", "Ticket 6")} == {
        ("Ticket 1", "Role 1", 0.5),
        ("Ticket 1", "Role 2", 5.0),
        ("Ticket 1", "Role 3", 1.25),
        ("Ticket 2", "Role 1", 1.75),
        ("Ticket 6", "Role 2", 2.0),
        ("Ticket 6", None, 1.0),
    }
    assert not any(row[0] in ("Ticket 3", "Draft A") for row in roles)
    assert as_set(durations.step_totals_by_case(steps, "Ticket 1")) == {
        ("Ticket 1", "Step Display Name 1", 0.5),
        ("Ticket 1", "Step Display Name 2", 5.0),
        ("Ticket 1", "Step Display Name 3", 1.25),
    }


def test_detail_role_for_one_case(steps):
    found = durations.detail_role(steps, asap="Ticket 1", as_of=AS_OF)
    assert found.columns == [*STATS, "avg_time"]
    assert {(row.name, row.avg_time) for row in found.collect()} == {
        ("Role 1", 0.5),
        ("Role 2", 5.0),
        ("Role 3", 1.25),
        ("Role 4", None),
        ("Role 5", None),
        ("Role 9", None),
    }


def test_detail_role_for_all_cases(steps):
    rows = durations.detail_role(steps, as_of=AS_OF).collect()
    assert sorted(row.avg_time for row in rows if row.name == "Role 1") == [0.5, 1.0, 1.0, 1.75]
    assert [row.avg_time for row in rows if row.name == "Role 5"] == [None]
    assert not any(row.name is None for row in rows)


def test_detail_role_of_an_unknown_case(steps):
    rows = durations.detail_role(steps, asap="Ticket 99", as_of=AS_OF).collect()
    assert len(rows) == 6 and all(row.avg_time is None for row in rows)


def test_detail_step_drops_outliers_and_unknown_durations(steps):
    rows = durations.detail_step(steps, asap="Ticket 2", as_of=AS_OF).collect()
    found = {row.name: (row.average_duration, row.standard_max, row.avg_time) for row in rows}
    # Step 7 has only the visit of 1096 days.
    assert "Step Display Name 7" not in found
    # Step 5 of Ticket 2 has no duration, the one of Ticket 10 has.
    assert found["Step Display Name 5"] == (2.0, 3, None)
    assert found["Step Display Name 4"] == ((1.75 + 1.0) / 2, 1, None)
    assert found["Step Display Name 6"] == (0.75, 1, 0.75)
    assert found["Side Step"] == (0.25, None, None)


@pytest.mark.parametrize("kind", [DecimalType(8, 2), DecimalType(10, 0), DecimalType(20, 4)])
def test_other_duration_types(spark, kind):
    rows = spark.createDataFrame(numbered_rows(), CASE_STEPS)
    schema = case_steps_schema(kind)
    typed = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
    found = {row.name: row for row in durations.role_durations(typed, as_of=AS_OF).collect()}
    assert found["Role 4"].average_duration == 1.125
    assert found["Role 2"].max == 3.0


def test_durations_must_be_decimal(steps):
    with pytest.raises(TypeError):
        durations.role_durations(steps.withColumn("cycle_days", F.lit(1.5)), as_of=AS_OF)
