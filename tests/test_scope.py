from datetime import date, datetime

import pytest

from caseflow.operators.scope import Scope, dated_steps, one_case, scoped_steps


def cases(frame):
    return {row.case_number for row in frame.select("case_number").distinct().collect()}


def test_defaults_cover_every_case_with_an_organisation(steps):
    assert cases(scoped_steps(steps)) == cases(steps) - {"Ticket 8"}
    assert scoped_steps(steps).columns == steps.columns


def test_no_organisations_equals_all_of_them(steps):
    every = Scope(orgs=["Org 1", "Org 2", "Org 3", "Org 4", "Org 5", "Org 6"])
    assert cases(scoped_steps(steps, every)) == cases(scoped_steps(steps))


def test_range_is_half_open(steps):
    assert "Ticket 3" not in cases(scoped_steps(steps, Scope("2000-01-01", "2000-05-20")))
    assert cases(scoped_steps(steps, Scope("2000-05-20", "2000-05-21"))) == {"Ticket 3"}


def test_only_start_or_only_end(steps):
    assert cases(scoped_steps(steps, Scope(start="2001-01-01", orgs=["Org 1"]))) == {"Ticket 7"}
    assert cases(scoped_steps(steps, Scope(end="2000-01-01", orgs=["Org 1"]))) == {"Ticket 4"}


def test_dates_without_organisations(steps):
    found = cases(dated_steps(steps, Scope("2000-01-01", "2000-02-01", ["Org 2"])))
    assert found == {"Ticket 1", "Ticket 8"}


def test_one_case(steps):
    assert cases(one_case(steps, "Ticket 9")) == {"Ticket 9"}
    assert one_case(steps, None).count() == steps.count()


def test_dates_may_be_date_objects(steps):
    assert Scope(date(2000, 1, 1), date(2001, 1, 1)) == Scope("2000-01-01", "2001-01-01")


@pytest.mark.parametrize(
    "bad",
    ["2020xx0101", "2021-01&01", "2020-01-01abc", "", " ", "20200101", "2020-02-30", "2020-1-1"],
)
def test_bad_dates(bad):
    with pytest.raises(ValueError):
        Scope(start=bad)
    with pytest.raises(ValueError):
        Scope(end=bad)


def test_time_of_day_is_not_a_date():
    with pytest.raises(ValueError):
        Scope(start=datetime(2020, 1, 1, 5))


def test_bad_organisations():
    for bad in ([], ["Org 7"], ["Org 1", "Org 1' OR '1'='1"], "Org 1"):
        with pytest.raises(ValueError):
            Scope(orgs=bad)
    assert Scope(orgs=["Elsewhere"], allowed_orgs=None).orgs == ("Elsewhere",)


def test_a_range_must_not_be_reversed_or_before_the_calendar():
    with pytest.raises(ValueError, match="after"):
        Scope("2021-01-01", "2020-01-01")
    with pytest.raises(ValueError, match="calendar"):
        Scope("0001-01-01", "0001-01-01")
