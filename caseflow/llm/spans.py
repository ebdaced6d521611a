"""Spans of regular expressions in whole texts, with SQL functions only.

A span is a struct (start, rank, end, kind): code points, end exclusive; ``rank`` orders kinds that start
together. Expressions take time in proportion to the text and its matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
#: Matches whose lengths are added up one by one; the sums of whole chunks are carried on.
CHUNK = 256


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` or a lambda in it uses it."""
    return F.transform(F.array(value), body).getItem(0)


def _before(values: Column, fold: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """For each element ``fold`` of those before it: of the chunks before its own, joined with that within its own."""

    def chunk(i: Column) -> Column:
        return F.floor(i / CHUNK).cast("int")

    def folded(own: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), chunk(F.size(own) - 1)),
            lambda c: fold(F.slice(own, c * CHUNK + 1, F.lit(CHUNK))),
        )

    def before(chunks: Column) -> Column:
        return F.transform(chunks, lambda _, c: fold(F.slice(chunks, F.lit(1), c)))

    return let(
        values,
        lambda own: let(
            let(folded(own), before),
            lambda firsts: F.transform(
                own,
                lambda _, i: join(
                    F.get(firsts, chunk(i)), fold(F.slice(own, chunk(i) * CHUNK + 1, i % CHUNK))
                ),
            ),
        ),
    )


def _starts(steps: Column) -> Column:
    """Sum of the elements before each element."""
    return _before(steps, _total, lambda a, b: a + b)


def greatest_before(values: Column) -> Column:
    """The greatest of the elements before each element, at least 0."""

    def fold(some: Column) -> Column:
        return F.coalesce(F.array_max(some), F.lit(0).cast("long"))

    return _before(values, fold, F.greatest)


def found(text: Column, pattern: str) -> Column:
    """All matches, leftmost and not overlapping."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def spans(
    text: Column,
    pattern: str,
    kind: str,
    rank: int,
    passes: Callable[[Column], Column],
) -> Column:
    """Sorted spans of the matches of ``pattern``; ``passes`` maps their array to an array of booleans.

    What lies between matches comes from splitting at the same pattern, so a match starts after the
    gaps and matches before it.
    """

    def placed(matches: Column, gaps: Column) -> Column:
        lengths = F.transform(matches, lambda m: F.length(m).cast("long"))
        # One step for each match: the gap before it, and the match.
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), lengths, lambda g, n: g + n)
        ends = let(steps, lambda own: F.zip_with(_starts(own), own, lambda before, step: before + step))
        at = F.zip_with(
            ends,
            lengths,
            lambda end, n: F.struct(
                (end - n).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")
            ),
        )
        chosen = F.zip_with(at, passes(matches), lambda span, good: F.when(good, span))
        return F.filter(chosen, lambda span: span.isNotNull())

    def all_of(matches: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
        some = let(gaps, lambda own: placed(matches, own))
        return F.when(F.size(matches) > 0, some).otherwise(F.array().cast(SPAN))

    return let(found(text, pattern), all_of)


def listed(spans_: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(
        F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def of_kind(spans_: Column, kind: str) -> Column:
    return F.size(F.filter(spans_, lambda s: s["kind"] == kind)).cast("long")
