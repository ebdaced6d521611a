"""Column expressions shared by the operators. All are built-in functions."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import Column, functions as F

from caseflow.functions.constants import CASE_PREFIX_LENGTH


def lookup(table: Mapping[str, Any], key: Column) -> Column:
    """Value of ``key`` in a small fixed table, NULL if absent.

    The table becomes one map literal inside the projection, so no join and no
    broadcast job is planned. Meant for the dozen-row tables of ``constants``.
    """
    if not table:
        raise ValueError("lookup table is empty")
    entries = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*entries), key)


def standard_columns(
    standards: Mapping[str, tuple[int, int]], name: Column
) -> tuple[Column, Column]:
    """``standard_min`` and ``standard_max`` of a role or step."""
    low = {key: pair[0] for key, pair in standards.items()}
    high = {key: pair[1] for key, pair in standards.items()}
    return (
        lookup(low, name).alias("standard_min"),
        lookup(high, name).alias("standard_max"),
    )


def as_of_column(as_of: datetime | str | None) -> Column:
    """The moment up to which open steps age; ``None`` is the query's start.

    Whole seconds, as the source's dates have no fraction.
    """
    if as_of is None:
        now = F.date_trunc("second", F.localtimestamp())
        return now.cast("timestamp_ntz")
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    if as_of.tzinfo is not None:
        raise ValueError("as_of must not carry a time zone")
    text = as_of.replace(microsecond=0).isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def case_suffix(case_number: Column) -> Column:
    """Number behind the case prefix; NULL if it is not a number."""
    return F.substring(case_number, CASE_PREFIX_LENGTH + 1, 2**31 - 1).try_cast("bigint")


def within_limit(limits: Mapping[str, tuple[str, int]], name: Column, days: Column) -> Column:
    """1 if ``days`` meets the on-time limit of step ``name``, else 0."""
    compare = {
        "=": lambda limit: days == limit,
        "<=": lambda limit: days <= limit,
        "<": lambda limit: days < limit,
    }
    met = F.lit(False)
    for step, (operator, limit) in limits.items():
        met = met | ((name == step) & compare[operator](F.lit(limit)))
    return F.when(met, 1).otherwise(0)
