from datetime import datetime

from caseflow.operators import cases
from hand_rows import as_set


def day(text):
    return datetime.fromisoformat(text)


HERO = {
    ("Ticket 1", 0, 4, 10.0, 1.6875, "Completed", day("2000-01-01"), day("2000-01-09 06:00")),
    ("Ticket 2", 2, 2, None, 0.875, "Active", day("2000-02-01"), None),
    ("Ticket 3", 1, 0, 5.0, None, "Active", day("2000-05-20"), None),
    ("Ticket 4", 1, 1, None, 1.0, "Active", day("1999-01-01"), None),
    ("Ticket 5", 1, 1, 8.0, 1.0, "Completed", day("2000-03-01"), day("2000-03-02")),
    ("Ticket 5", 1, 1, 8.0, 1.0, "Active", day("2000-03-01"), day("2000-03-02")),
    ("Ticket 6", 0, 0, 0.0, 1.5, "Completed", day("2000-04-01"), day("2000-04-04")),
    ("Ticket 7", 1, 0, None, None, "Active", day("2001-12-01"), None),
    ("Draft A", 1, 0, None, None, "Active", day("2000-06-01"), None),
    ("Ticket 8", 0, 1, 3.0, 1.0, "Completed", day("2000-01-15"), day("2000-01-17")),
    ("Ticket 9", 0, 1, 7.0, 1.0, "Completed", day("2001-01-01"), day("2001-01-02")),
    ("Ticket 10", 0, 2, 5.0, 1.5, "Completed", day("2000-07-01"), day("2000-07-04")),
    ("Ticket 10", 0, 2, 5.0, 1.5, "Completed", day("2000-07-02"), day("2000-07-04")),
}


def test_detail_hero(steps):
    found = cases.detail_hero(steps)
    assert found.columns == [
        "asap",
        "remaining",
        "completed",
        "total_cycle_time",
        "avg_cycle_time",
        "is_active",
        "date_start",
        "date_end",
    ]
    assert as_set(found) == HERO


def test_detail_hero_of_one_case(steps):
    assert as_set(cases.detail_hero(steps, "Ticket 5")) == {r for r in HERO if r[0] == "Ticket 5"}
    assert cases.detail_hero(steps, "Ticket 99").count() == 0


def test_detail_hero_compat(steps):
    def literal(row):
        finished = row[0] in ("Ticket 1", "Ticket 6", "Ticket 8", "Ticket 9", "Ticket 10")
        return (*row[:2], None if finished else row[1], *row[3:])

    assert as_set(cases.detail_hero_compat(steps)) == {literal(row) for row in HERO}


def test_asap_detail(steps):
    timeline = cases.asap_detail(steps, "Ticket 1").collect()
    assert [(row.action_time.day, row.user, row.action_name) for row in timeline] == [
        (1, "Ann", "Approve"),
        (2, "Bob", "Approve"),
        (5, "Bob", "Return"),
        (8, None, None),
    ]
    everything = cases.asap_detail(steps)
    assert everything.count() == steps.where("date_in IS NOT NULL").count() == 19
    assert everything.columns == [
        "case_number",
        "action_time",
        "user",
        "role",
        "step_name",
        "action_name",
    ]


def test_user_time(steps):
    assert as_set(cases.user_time(steps, "Ticket 1")) == {
        ("Ann", 0.5, "Ticket 1"),
        ("Bob", 5.0, "Ticket 1"),
        (None, 1.25, "Ticket 1"),
    }
    assert cases.user_time(steps).columns == ["asap_user", "user_time", "asap"]


def test_asap_list(flow_steps):
    created = day("2000-07-01"), day("2000-07-02")
    assert as_set(cases.asap_list(flow_steps)) == {
        ("Ticket 1", 1 / 3, day("2000-01-01")),
        ("Ticket 2", 0.0, day("2000-02-01")),
        # No finished row at all.
        ("Ticket 3", None, None),
        ("Ticket 7", None, None),
        ("Draft A", None, None),
        ("Ticket 4", 1.0, day("1999-01-01")),
        ("Ticket 5", 0.0, day("2000-03-01")),
        # Finished rows, but none with a name.
        ("Ticket 6", None, day("2000-04-01")),
        ("Ticket 8", 1.0, day("2000-01-15")),
        ("Ticket 9", 1.0, day("2001-01-01")),
        # Two creation dates: both on-time steps count for each.
        ("Ticket 10", 2.0, created[0]),
        ("Ticket 10", 2.0, created[1]),
    }


def test_step_standards(flow_steps):
    rows = as_set(cases.step_standards(flow_steps))
    assert {row for row in rows if row[0] in ("Ticket 1", "Ticket 2")} == {
        ("Ticket 1", "Submitted", 0.5, 0),
        ("Ticket 1", "2nd Level Review (Manager)", 5.0, 0),
        ("Ticket 1", "2nd Level Approval (Manager)", 1.25, 1),
        ("Ticket 2", "Submitted", 1.0, 0),
        ("Ticket 2", "Manpower Approval", None, 0),
        ("Ticket 2", "Classification Review", None, 0),
        ("Ticket 2", "Step Display Name 1", 0.75, 0),
    }


def test_limits_at_their_border(spark):
    from hand_rows import business_rows
    from caseflow.schema import CASE_STEPS
    from decimal import Decimal

    first = business_rows()[0]

    def visit(case, step, days):
        return (case, 1, step, *first[3:8], Decimal(days), *first[9:])

    rows = [
        visit("a", "DCA Finalizes Classification", "3.00"),
        visit("b", "DCA Finalizes Classification", "2.99"),
        visit("c", "Step Display Name 1", "0.00"),
        visit("d", "Step Display Name 1", "0.01"),
        visit("e", "Classification Review", "5.00"),
        visit("f", "Classification Review", "5.01"),
        visit("g", None, "0.00"),
    ]
    found = cases.step_standards(spark.createDataFrame(rows, CASE_STEPS)).collect()
    assert {row.case_number: row.withinstandards for row in found} == dict(
        a=0, b=1, c=1, d=0, e=1, f=0, g=0
    )


def test_parts_of_the_list(flow_steps):
    assert ("Ticket 1", day("2000-01-01"), 3) in as_set(cases.completed_steps(flow_steps))
    assert ("Ticket 6", day("2000-04-01"), 0) in as_set(cases.completed_steps(flow_steps))
    assert ("Ticket 6", None, 3.0) in as_set(cases.step_times(flow_steps))
    assert ("Ticket 10", 2, 1, day("2000-07-01")) in as_set(cases.case_on_time_summary(flow_steps))


def test_on_time_summary_without_limits(flow_steps):
    by_case = {row.case_number: row.ontimesteps for row in cases.case_on_time_summary(flow_steps, {}).collect()}
    assert set(by_case.values()) == {0}
    assert set(by_case) == {row.case_number for row in flow_steps.select("case_number").collect()}


def test_hot_case_with_a_date_for_each_visit(spark, steps):
    """Rows per case are (status, date) pairs: the windows of the detail hold as many as a case has dates."""
    hot = steps.sparkSession.range(3000).selectExpr(
        "'Ticket 7' case_number", "id step_id", "concat('Manpower Review') step_name", "'Role 1' role",
        "'a' assigned_to", "'b' action_name", "timestamp_ntz'2020-01-01 00:00:00' date_in",
        "case when id % 2 = 0 then timestamp_ntz'2020-01-02 00:00:00' end date_out",
        "cast(0.001 * 0 as decimal(18,2)) cycle_days", "cast(0 as decimal(18,2)) cycle_hours",
        "timestamp_ntz'2019-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) case_created", "'Active' case_status",
        "cast(1 as double) total_cycle_time", "'Org 1' org_code",
    ).select(*steps.columns)
    found = cases.detail_hero(hot).collect()
    assert len(found) == 3000
    assert {(r.remaining, r.completed, r.total_cycle_time, r.avg_cycle_time) for r in found} == {(1500, 1500, 1.0, 0.0)}
    summary = cases.case_on_time_summary(hot).collect()
    assert len(summary) == 1500
    assert {(r.ontimesteps, r.completedsteps) for r in summary} == {(1, 1)}
