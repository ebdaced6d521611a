"""Which step visits a report looks at."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from caseflow.functions.constants import DEFAULT_END, DEFAULT_START, ORG_CODES
from caseflow.schema import CREATED_MONTH


def _parse(value: str | date | None, default: str, name: str) -> date:
    if value is None:
        value = default
    if isinstance(value, datetime):
        raise ValueError(f"{name} must be a date without time of day: {value!r}")
    if isinstance(value, date):
        return value
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        raise ValueError(f"{name} is not a yyyy-MM-dd date: {value!r}")
    return date.fromisoformat(value)


@dataclass(frozen=True)
class Scope:
    """Cases created in ``[start, end)`` that belong to one of ``orgs``.

    ``orgs=None`` means every organisation; rows without one are then left out
    too. Codes outside ``allowed_orgs`` are an error; pass ``None`` to allow any.
    """

    start: str | date | None = None
    end: str | date | None = None
    orgs: Sequence[str] | None = None
    allowed_orgs: Sequence[str] | None = ORG_CODES

    def __post_init__(self) -> None:
        object.__setattr__(self, "start", _parse(self.start, DEFAULT_START, "start"))
        object.__setattr__(self, "end", _parse(self.end, DEFAULT_END, "end"))
        if self.start > self.end:
            raise ValueError(f"start {self.start} is after end {self.end}")
        if self.end == date.min:
            raise ValueError("end is the first day of the calendar, so nothing lies before it")
        if self.orgs is None:
            return
        if isinstance(self.orgs, str):
            raise ValueError("orgs must be a list of codes, not one string")
        orgs = tuple(self.orgs)
        if not orgs:
            raise ValueError("orgs is empty; use None for all organisations")
        if self.allowed_orgs is not None:
            unknown = sorted(set(orgs) - set(self.allowed_orgs))
            if unknown:
                raise ValueError(f"unknown organisations: {unknown}")
        object.__setattr__(self, "orgs", orgs)

    def date_condition(self, steps: DataFrame) -> Column:
        """Half-open range on ``case_created``.

        On a table stored by month the same range is also put on the partition
        column, so files outside it are not listed.
        """
        created = F.col("case_created")
        condition = (created >= F.lit(str(self.start)).cast("timestamp_ntz")) & (
            created < F.lit(str(self.end)).cast("timestamp_ntz")
        )
        if CREATED_MONTH in steps.columns:
            last = self.end - timedelta(days=1)
            condition &= F.col(CREATED_MONTH).between(
                self.start.year * 100 + self.start.month, last.year * 100 + last.month
            )
        return condition

    def org_condition(self) -> Column:
        if self.orgs is None:
            return F.col("org_code").isNotNull()
        return F.col("org_code").isin(*self.orgs)


def scoped_steps(steps: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Step visits of the cases in ``scope``, without the partition column of a stored table."""
    return steps.where(scope.date_condition(steps) & scope.org_condition()).drop(CREATED_MONTH)


def dated_steps(steps: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Step visits in the date range of ``scope``, whatever the organisation."""
    return steps.where(scope.date_condition(steps))


def one_case(steps: DataFrame, asap: str | None) -> DataFrame:
    """Step visits of case ``asap``; all of them for ``None``."""
    return steps if asap is None else steps.where(F.col("case_number") == asap)
