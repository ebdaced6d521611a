"""Durations as whole 64-bit units, so that sums are exact and cheap.

A stored duration is a decimal, usually with two places. Summing wide decimals
allocates an object per row, and summing doubles depends on the order of rows.
The operators therefore add up whole units (hundredths of a day for scale 2)
as plain longs and divide once at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DecimalType

SECONDS_PER_DAY = 86_400
SECONDS_PER_HOUR = 3_600

# Elapsed time of open steps is cut to two places, whatever the stored scale.
ELAPSED_SCALE = 2


@dataclass(frozen=True)
class DurationUnits:
    """A stored duration column and the unit it is counted in."""

    column: str
    kind: DecimalType
    seconds: int

    @classmethod
    def of_days(cls, steps: DataFrame) -> DurationUnits:
        return cls._of(steps, "cycle_days", SECONDS_PER_DAY)

    @classmethod
    def of_hours(cls, steps: DataFrame) -> DurationUnits:
        return cls._of(steps, "cycle_hours", SECONDS_PER_HOUR)

    @classmethod
    def _of(cls, steps: DataFrame, column: str, seconds: int) -> DurationUnits:
        kind = steps.schema[column].dataType
        if not isinstance(kind, DecimalType):
            raise TypeError(f"{column} must be a decimal, not {kind.simpleString()}")
        return cls(column, kind, seconds)

    @property
    def per_whole(self) -> int:
        """Units in one day or hour."""
        return 10 ** max(self.kind.scale, ELAPSED_SCALE)

    def stored(self) -> Column:
        """The stored duration in units.

        Exact up to 2**53 units, the same bound that the double results have.
        """
        value = F.col(self.column).cast("double") * float(self.per_whole)
        return F.rint(value).cast("bigint")

    def _elapsed(self, as_of: Column) -> Column:
        # Subtracting zone-less timestamps does not depend on the session zone;
        # timestamp_diff would go through it. Both casts and the integer division
        # truncate toward zero, also for a date_in after as_of.
        seconds = (as_of - F.col("date_in")).cast("interval second").cast("bigint")
        cut = F.call_function("div", seconds * 10**ELAPSED_SCALE, F.lit(self.seconds))
        finer = self.per_whole // 10**ELAPSED_SCALE
        return cut if finer == 1 else cut * finer

    def aged(self, as_of: Column) -> Column:
        """Units in the step: elapsed so far if it is open, else as stored."""
        return F.when(is_open(), self._elapsed(as_of)).otherwise(self.stored())

    def aged_decimal(self, as_of: Column) -> Column:
        """As :meth:`aged`, in the type of the stored column."""
        unit = F.lit(f"{1 / self.per_whole:.{max(self.kind.scale, ELAPSED_SCALE)}f}")
        elapsed = self._elapsed(as_of).cast("decimal(20,0)") * unit.cast(
            DecimalType(self.kind.precision, max(self.kind.scale, ELAPSED_SCALE))
        )
        return F.when(is_open(), elapsed.cast(self.kind)).otherwise(F.col(self.column))

    def value(self, units: Column) -> Column:
        """Units back as a number of days or hours."""
        return units.cast("double") / float(self.per_whole)

    def average(self, units: Column) -> Column:
        """Exact sum over count, NULL without any value."""
        return F.try_divide(self.value(F.sum(units)), F.count(units).cast("double"))


def is_open() -> Column:
    """The step was entered and not left."""
    return F.col("date_out").isNull() & F.col("date_in").isNotNull()
