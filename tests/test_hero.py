import pytest

from caseflow.operators import hero
from caseflow.operators.scope import Scope
from hand_rows import as_set

SINGLE = [
    hero.hero_total_requests,
    hero.hero_active_requests,
    hero.hero_completed_requests,
    hero.hero_avg_cycle_time,
    hero.hero_fastest_cycle_time,
]


def test_org_codes(steps):
    assert as_set(hero.org_codes(steps)) == {(f"Org {n}",) for n in range(1, 6)}


def test_hero_stats(steps):
    assert [tuple(row) for row in hero.hero_stats(steps).collect()] == [
        ("Total ASAP Requests", 10.0),
        ("Active ASAP Requests", 6.0),
        ("Completed ASAP Requests", 5.0),
        ("Average ASAP Cycle Time - Days", 6.0),
        ("Fastest ASAP Total Cycle Time - Days", 6.0),
    ]


@pytest.mark.parametrize(
    "scope",
    [
        Scope(),
        Scope("2000-01-01", "2000-05-20"),
        Scope("2000-01-01", None, ["Org 1"]),
        Scope(None, "2001-01-01", ["Org 1", "Org 3"]),
        Scope("1950-01-01", "1951-01-01"),
    ],
)
def test_one_scan_equals_the_single_metrics(steps, scope):
    single = [tuple(operator(steps, scope).first()) for operator in SINGLE]
    together = [tuple(row) for row in hero.hero_stats(steps, scope).collect()]
    assert together == [(name, None if value is None else float(value)) for name, value in single]


def test_empty_scope(steps):
    nothing = Scope("1950-01-01", "1951-01-01")
    assert [row.value for row in hero.hero_stats(steps, nothing).collect()] == [0, 0, 0, None, None]


def test_total_requests_compat(steps):
    def count(scope):
        return hero.hero_total_requests_compat(steps, scope).first()["count"]

    assert count(Scope(orgs=["Org 1"])) == 5
    assert count(Scope("2000-01-01", "2001-01-01", ["Org 1"])) == 3
    assert count(Scope(orgs=["Org 1", "Org 2"])) == 0
    assert count(Scope(orgs=["Org 2"])) == 0
    assert count(Scope()) == 0
    alone = steps.where("org_code = 'Org 1' OR org_code IS NULL")
    assert hero.hero_total_requests_compat(alone).first()["count"] == 5
    assert hero.hero_total_requests_compat(steps.limit(0)).first()["count"] == 0
