"""Hand-written step visits that hold every special case of the reports."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from caseflow.schema import CASE_STEPS

AS_OF = "2002-01-01 00:00:00"


def _moment(text):
    return None if text is None else datetime.fromisoformat(text)


def _number(text):
    return None if text is None else Decimal(text)


# case, step id, step number or name, role, user, action, in, out, days, hours,
# created, status, total, org
_ROWS = [
    # A plain finished case with a repeated visit of step 2.
    ("Ticket 1", 1, 1, "Role 1", "Ann", "Approve", "2000-01-01 00:00", "2000-01-01 12:00",
     "0.50", "12.00", "2000-01-01", "Completed", 10.0, "Org 1"),
    ("Ticket 1", 2, 2, "Role 2", "Bob", "Approve", "2000-01-02 00:00", "2000-01-04 00:00",
     "2.00", "48.00", "2000-01-01", "Completed", 10.0, "Org 1"),
    ("Ticket 1", 3, 2, "Role 2", "Bob", "Return", "2000-01-05 00:00", "2000-01-08 00:00",
     "3.00", "72.00", "2000-01-01", "Completed", 10.0, "Org 1"),
    ("Ticket 1", 4, 3, "Role 3", None, None, "2000-01-08 00:00", "2000-01-09 06:00",
     "1.25", "30.00", "2000-01-01", "Completed", 10.0, "Org 1"),
    # An open step (1.75 days old), both dates missing, only the end date.
    ("Ticket 2", 5, 1, "Role 1", "Ann", "Approve", "2000-02-01 00:00", "2000-02-02 00:00",
     "1.00", "24.00", "2000-02-01", "Active", None, "Org 2"),
    ("Ticket 2", 6, 4, "Role 4", "Cid", None, "2001-12-30 06:00", None,
     None, None, "2000-02-01", "Active", None, "Org 2"),
    ("Ticket 2", 7, 5, "Role 5", None, None, None, None,
     None, None, "2000-02-01", "Active", None, "Org 2"),
    ("Ticket 2", 8, 6, "Role 1", "Dee", "Approve", None, "2000-02-05 00:00",
     "0.75", "18.00", "2000-02-01", "Active", None, "Org 2"),
    # Created exactly at the end of the usual range.
    ("Ticket 3", 9, 2, "Role 2", "Bob", None, "2001-12-31 00:00", None,
     None, None, "2000-05-20", "Active", 5.0, "Org 1"),
    # More than 1000 days in total, and a missing role.
    ("Ticket 4", 10, 7, "Role 3", "Eve", None, "1999-01-01 00:00", None,
     None, None, "1999-01-01", "Active", None, "Org 1"),
    ("Ticket 4", 11, 8, None, "Eve", "Approve", "1999-01-02 00:00", "1999-01-03 00:00",
     "1.00", "24.00", "1999-01-01", "Active", None, "Org 1"),
    # Two statuses.
    ("Ticket 5", 12, 1, "Role 1", "Ann", "Approve", "2000-03-01 00:00", "2000-03-02 00:00",
     "1.00", "24.00", "2000-03-01", "Completed", 8.0, "Org 3"),
    ("Ticket 5", 13, 9, "Role 4", "Cid", None, "2001-12-31 12:00", None,
     None, None, "2000-03-01", "Active", 8.0, "Org 3"),
    # Finished steps without a name; a total of zero.
    ("Ticket 6", 14, None, "Role 2", "Bob", "Approve", "2000-04-01 00:00", "2000-04-03 00:00",
     "2.00", "48.00", "2000-04-01", "Completed", 0.0, "Org 2"),
    ("Ticket 6", 15, None, None, None, None, "2000-04-03 00:00", "2000-04-04 00:00",
     "1.00", "24.00", "2000-04-01", "Completed", 0.0, "Org 2"),
    # Entered after the moment of the report: -12.5 hours.
    ("Ticket 7", 16, 2, "Role 1", "Ann", None, "2002-01-01 12:30", None,
     None, None, "2001-12-01", "Active", None, "Org 1"),
    # No number in the case, an unknown step and an unknown role.
    ("Draft A", 17, "Side Step", "Role 9", "Fay", None, "2001-12-31 18:00", None,
     None, None, "2000-06-01", "Active", None, "Org 4"),
    # No organisation.
    ("Ticket 8", 18, 3, "Role 1", "Ann", "Approve", "2000-01-16 00:00", "2000-01-17 00:00",
     "1.00", "24.00", "2000-01-15", "Completed", 3.0, None),
    # The step id of another case's visit.
    ("Ticket 9", 2, 4, "Role 2", "Bob", "Approve", "2001-01-01 00:00", "2001-01-02 00:00",
     "1.00", "24.00", "2001-01-01", "Completed", 7.0, "Org 5"),
    # Two creation dates and two totals.
    ("Ticket 10", 20, 3, "Role 3", "Eve", "Approve", "2000-07-01 00:00", "2000-07-02 00:00",
     "1.00", "24.00", "2000-07-01", "Completed", 4.0, "Org 1"),
    ("Ticket 10", 21, 5, "Role 3", "Eve", "Approve", "2000-07-02 00:00", "2000-07-04 00:00",
     "2.00", "48.00", "2000-07-02", "Completed", 6.0, "Org 1"),
]

_BUSINESS = {
    1: "Submitted",
    2: "2nd Level Review (Manager)",
    3: "2nd Level Approval (Manager)",
    4: "Manpower Approval",
    5: "Classification Review",
    6: "Step Display Name 1",
    7: "DCA Finalizes Classification",
    8: "Issue Classification Advisory",
    9: "3rd Level Approval (Manager)",
}


def _rows(step_name):
    return [
        (
            *row[:2],
            step_name(row[2]) if isinstance(row[2], int) else row[2],
            *row[3:6],
            _moment(row[6]),
            _moment(row[7]),
            _number(row[8]),
            _number(row[9]),
            _moment(row[10]),
            *row[11:],
        )
        for row in _ROWS
    ]


def numbered_rows():
    return _rows(lambda number: f"Step Display Name {number}")


def business_rows():
    return _rows(_BUSINESS.get)


def numbered_steps(spark):
    return spark.createDataFrame(numbered_rows(), CASE_STEPS)


def business_steps(spark):
    return spark.createDataFrame(business_rows(), CASE_STEPS)


def as_set(frame):
    """All rows as a set of tuples; fails on repeated rows."""
    rows = [tuple(row) for row in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)
