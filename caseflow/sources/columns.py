"""Bringing a table with the source's column titles into the ``case_steps`` shape.

Values are never changed silently: durations keep the scale of a decimal source, and a conversion that
would lose digits raises when the rows are read. So does text that is not a number, unless the caller
asks for NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    DataType,
    DecimalType,
    LongType,
    StringType,
    StructType,
    TimestampNTZType,
)

from caseflow.schema import CASE_STEPS, SOURCE_COLUMNS

DURATIONS = ("cycle_days", "cycle_hours")
BAD_TEXT = ("error", "null")
# Wide enough to tell whether a text has more digits than the target keeps.
WIDE = DecimalType(38, 18)


def _failure(title: str, why: str, target: DataType) -> Column:
    shown = F.col(f"`{title}`").cast("string")
    message = F.concat(F.lit(f"{title}: {why}: "), F.coalesce(shown, F.lit("NULL")))
    return F.raise_error(message).cast(target)


def _number(title: str, source: DataType, target: DataType, bad_text: str) -> Column:
    value = F.col(f"`{title}`")
    is_text = isinstance(source, StringType)
    converted = value.try_cast(target)
    exact = value
    if is_text:
        exact = value.try_cast(WIDE) if isinstance(target, (DecimalType, LongType)) else converted
        if isinstance(target, LongType):
            converted = exact.try_cast(target)
        elif isinstance(target, DecimalType):
            # The wide decimal has an end as well: count written places, and compare exponents as doubles.
            places = F.length(F.regexp_extract(value, r"\.([0-9]*?)0*\s*$", 1))
            long_text = (places > target.scale) | (value.try_cast("double") != exact.cast("double"))
            converted = F.when(long_text, _failure(title, "digits would be lost", target)).otherwise(
                converted
            )
    result = F.when(
        converted != exact, _failure(title, "digits would be lost", target)
    ).otherwise(converted)
    unread = value.isNotNull() & value.try_cast("double" if is_text else target).isNull()
    if is_text and bad_text == "null":
        return F.when(~unread, result)
    why = "not a number" if is_text else "out of range"
    return F.when(unread, _failure(title, why, target)).otherwise(result)


def _converted(title: str, source: DataType, target: DataType, bad_text: str) -> Column:
    if source == target:
        return F.col(f"`{title}`")
    if isinstance(target, (StringType, TimestampNTZType)):
        return F.col(f"`{title}`").cast(target)
    return _number(title, source, target, bad_text)


def from_source_columns(
    source: DataFrame, schema: StructType | None = None, bad_text: str = "error"
) -> DataFrame:
    """Rename and convert the titled source columns.

    Without a ``schema`` durations keep the type of a decimal source, and are ``decimal(18,2)``
    otherwise. ``bad_text`` says what a text that is not a number becomes: ``"error"`` or ``"null"``.
    """
    missing = [title for title in SOURCE_COLUMNS if title not in source.columns]
    if missing:
        raise ValueError(f"source lacks the columns {missing}")
    if bad_text not in BAD_TEXT:
        raise ValueError(f"bad_text must be one of {BAD_TEXT}, not {bad_text!r}")

    def target(title: str, name: str) -> DataType:
        found = source.schema[title].dataType
        if schema is None and name in DURATIONS and isinstance(found, DecimalType):
            return found
        return (schema or CASE_STEPS)[name].dataType

    return source.select(
        *(
            _converted(
                title, source.schema[title].dataType, target(title, name), bad_text
            ).alias(name)
            for title, name in SOURCE_COLUMNS.items()
        )
    )
