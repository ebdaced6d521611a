from caseflow.operators import inspector
from caseflow.operators.scope import Scope
from hand_rows import AS_OF, as_set
from pyspark.sql import functions as F


def test_rows_of_one_case(steps):
    rows = inspector.inspector_rows(steps, as_of=AS_OF).where("asap = 'Ticket 1'").collect()
    assert [tuple(row) for row in rows] == [
        ("Completed", 6.75, 12, 24, "Ticket 1", name, color, days, kind, low, high)
        for name, color, days, kind, low, high in [
            ("Role 1", "#B7B7C5", 0.5, "Role", None, None),
            ("Role 2", "#D2D2D2", 5.0, "Role", 3, 9),
            ("Role 3", "#D6D6DC", 1.25, "Role", 2, 4),
            ("Step Display Name 1", "#2a487b", 0.5, "Step", None, None),
            ("Step Display Name 2", "#545E82", 5.0, "Step", 1, 3),
            ("Step Display Name 3", "#898dadb", 1.25, "Step", 1, 3),
        ]
    ]


def test_order_and_outliers(steps):
    rows = inspector.inspector_rows(steps, as_of=AS_OF).collect()
    order = list(dict.fromkeys(row.asap for row in rows))
    # By number, not by text; the case without a number comes last; 4 is an outlier.
    assert order == [f"Ticket {n}" for n in (1, 2, 3, 5, 6, 7, 9, 10)] + ["Draft A"]
    names = [row.name for row in rows if row.asap == "Ticket 6"]
    assert names == ["Role 2", None, None]


def test_total_covers_visits_out_of_scope(steps):
    scope = Scope("2000-07-02", "2000-07-03")
    rows = inspector.inspector_rows(steps, scope, AS_OF).collect()
    assert {(row.asap, row.name, row.total_time, row.duration_days) for row in rows} == {
        ("Ticket 10", "Role 3", 3.0, 2.0),
        ("Ticket 10", "Step Display Name 5", 3.0, 2.0),
    }


def test_outlier_limit_is_exclusive(spark, steps):
    def totals(days):
        changed = steps.where("step_id = 1").withColumn(
            "cycle_days", F.lit(days).cast("decimal(18,2)")
        )
        return inspector.inspector_rows(changed, as_of=AS_OF).count()

    assert totals("999.99") == 2
    assert totals("1000.00") == 0


def test_case_without_any_duration_is_left_out(steps):
    assert inspector.inspector_rows(steps.where("step_id = 7"), as_of=AS_OF).count() == 0


def test_two_statuses_give_two_groups(steps):
    rows = inspector.inspector_nested(steps, as_of=AS_OF).where("asap = 'Ticket 5'").collect()
    assert {(row.is_active, row.total_time, row.roles[0].name) for row in rows} == {
        ("Completed", 1.5, "Role 1"),
        ("Active", 1.5, "Role 4"),
    }


def test_nested(steps):
    nested = inspector.inspector_nested(steps, as_of=AS_OF)
    found = {row.asap: row for row in nested.where("asap <> 'Ticket 5'").collect()}
    assert [(e.name, e.duration_days) for e in found["Ticket 6"].roles] == [
        ("Role 2", 2.0),
        (None, 1.0),
    ]
    assert [(e.name, e.duration_days) for e in found["Ticket 6"].steps] == [(None, 3.0)]
    assert [tuple(e) for e in found["Ticket 2"].roles] == [
        ("Role 1", "Role", "#B7B7C5", 1.75, None, None),
        ("Role 4", "Role", "#B7B7C5", 1.75, 3, 6),
        ("Role 5", "Role", "#898dadb", None, 1, 3),
    ]
    assert found["Draft A"].steps[0].asDict() == {
        "name": "Side Step",
        "type": "Step",
        "color": None,
        "duration_days": 0.25,
        "standard_min": None,
        "standard_max": None,
    }


def test_nesting_loses_no_row(steps):
    flat = inspector.inspector_rows(steps, as_of=AS_OF)
    nested = inspector.inspector_nested(steps, as_of=AS_OF)
    keys = ["is_active", "total_time", "total_min", "total_max", "asap"]
    unfolded = nested.select(*keys, F.inline(F.concat("roles", "steps")))
    assert as_set(unfolded.select(*flat.columns)) == as_set(flat)


def test_one_scan_equals_two_halves(steps):
    rows = inspector.inspector_rows(steps, as_of=AS_OF)
    for kind, column in (("Role", "role"), ("Step", "step_name")):
        other = {"Role": "step_name", "Step": "role"}[kind]
        alone = inspector.inspector_rows(steps.withColumn(other, F.lit(None).cast("string")),
                                         as_of=AS_OF).where(F.col("type") == kind)
        assert as_set(alone) == as_set(rows.where(F.col("type") == kind)), column


def test_legends(steps):
    roles = as_set(inspector.legend_roles(steps))
    assert {("Role 5", "#898dadb"), ("Role 9", None), (None, None)} <= roles
    assert len(roles) == 7
    names = as_set(inspector.legend_steps(steps))
    assert {("Step Display Name 8", "#ffffff"), ("Step Display Name 9", None)} <= names
    assert {("Side Step", None), (None, None)} <= names
    legend = as_set(inspector.activity_legend(steps))
    assert {row[3] for row in legend if row[0] == 2} == {
        "#719546",
        "#FCD360",
        "#A3294D",
        "#ffffff",
    }
    assert len(legend) == len(roles) + len(names) + 4


def test_nested_legend(steps):
    blocks = inspector.activity_legend_nested(steps).orderBy("block_no").collect()
    assert [block.title for block in blocks] == [
        "ASAP Durations by Step (Days)",
        "Total Time",
        "ASAP Durations by Role (Days)",
    ]
    assert [len(block.rows) for block in blocks] == [11, 4, 7]
    assert [tuple(row) for row in blocks[1].rows] == [
        ("Above Standards", "#719546"),
        ("Within Standards", "#FCD360"),
        ("Below Standards", "#A3294D"),
        ("Active", "#ffffff"),
    ]
    for block in (blocks[0], blocks[2]):
        names = [row.name for row in block.rows]
        assert names[-1] is None and names[:-1] == sorted(names[:-1])


def test_flat_legend_has_the_same_order(steps):
    flat = inspector.activity_legend(steps).orderBy("block_no", "position").collect()
    nested = inspector.activity_legend_nested(steps).orderBy("block_no").collect()
    assert [(row.name, row.color) for row in flat] == [
        tuple(row) for block in nested for row in block.rows
    ]
    assert [row.position for row in flat if row.block_no == 2] == [1, 2, 3, 4]

