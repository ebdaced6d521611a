"""Every operator as a named query over the star schema tables.

Each query reads whole tables. Operators that take a scope appear twice: under
their name with the default scope, which covers every case that has an
organisation, and as ``<name>_scoped`` with a date range and two organisations.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseflow.operators import cases, durations, hero, inspector, sankey, scope as scopes
from caseflow.operators.scope import Scope
from caseflow.sources.star_schema import BUSINESS, NUMBERED, from_star_schema

Query = Callable[[SparkSession, str], DataFrame]

# The tables end in 1998; open steps age until this moment.
AS_OF = "2002-01-01 00:00:00"
EVERYTHING = Scope()
SCOPED = Scope("1996-01-01", "2000-01-01", ["Org 1", "Org 2"])
# The literal total has an answer other than 0 for one organisation only.
ONE_ORG = Scope(orgs=["Org 1"])
ONE_ORG_SCOPED = Scope("1996-01-01", "2000-01-01", ["Org 1"])
# A case that is present at every scale, with a date range that its cases lie in.
CASE = "Ticket 23"
CASE_SCOPE = Scope("1992-01-01", "1999-01-01")


def _plain_numbers(rows: DataFrame) -> DataFrame:
    """Decimals as doubles, for results that carry the fact columns through."""
    decimals = [name for name, kind in rows.dtypes if kind.startswith("decimal")]
    return rows.withColumns({name: F.col(name).cast("double") for name in decimals})


def _flat_inspector(rows: DataFrame) -> DataFrame:
    """Nested inspector cases with their arrays written out as text: all fields, in array order."""

    def listed(array: str):
        parts = F.transform(
            F.col(array),
            lambda item: F.concat_ws(
                ":",
                *(F.coalesce(item[f].cast("string"), F.lit("-")) for f in ("name", "type", "color")),
                F.coalesce(item["duration_days"].cast("decimal(18,2)").cast("string"), F.lit("-")),
                *(
                    F.coalesce(item[f].cast("string"), F.lit("-"))
                    for f in ("standard_min", "standard_max")
                ),
            ),
        )
        return F.array_join(parts, ",").alias(array)

    return rows.select(
        "is_active",
        "total_time",
        "total_min",
        "total_max",
        "asap",
        F.size("roles").cast("bigint").alias("role_count"),
        F.size("steps").cast("bigint").alias("step_count"),
        listed("roles"),
        listed("steps"),
    )


def _flat_legend(rows: DataFrame) -> DataFrame:
    """Nested legend blocks with their entries written out as text: all fields, in array order."""
    entries = F.transform(
        "rows",
        lambda item: F.concat_ws(
            ":", F.coalesce(item["name"], F.lit("-")), F.coalesce(item["color"], F.lit("-"))
        ),
    )
    return rows.select(
        "block_no",
        "title",
        F.size("rows").cast("bigint").alias("row_count"),
        F.array_join(entries, ",").alias("entries"),
    )


Operator = Callable[[DataFrame], DataFrame]


def operators() -> dict[str, tuple[str, Operator]]:
    """Name -> (step vocabulary, function of ``case_steps``)."""
    with_scope: dict[str, tuple[str, Callable[..., DataFrame]]] = {
        "scoped_steps": (NUMBERED, lambda s, scope: _plain_numbers(scopes.scoped_steps(s, scope))),
        "hero_total_requests": (NUMBERED, hero.hero_total_requests),
        "hero_active_requests": (NUMBERED, hero.hero_active_requests),
        "hero_completed_requests": (NUMBERED, hero.hero_completed_requests),
        "hero_avg_cycle_time": (NUMBERED, hero.hero_avg_cycle_time),
        "hero_fastest_cycle_time": (NUMBERED, hero.hero_fastest_cycle_time),
        "hero_stats": (NUMBERED, hero.hero_stats),
        "role_durations": (NUMBERED, partial(durations.role_durations, as_of=AS_OF)),
        "role_durations_all_orgs": (
            NUMBERED,
            partial(durations.role_durations_all_orgs, as_of=AS_OF),
        ),
        "step_durations": (NUMBERED, partial(durations.step_durations, as_of=AS_OF)),
        "detail_role": (NUMBERED, partial(durations.detail_role, as_of=AS_OF)),
        "detail_step": (NUMBERED, partial(durations.detail_step, as_of=AS_OF)),
        "inspector_rows": (NUMBERED, partial(inspector.inspector_rows, as_of=AS_OF)),
        "inspector_nested": (
            NUMBERED,
            lambda s, scope: _flat_inspector(inspector.inspector_nested(s, scope, AS_OF)),
        ),
        "latest_completed_visit": (BUSINESS, sankey.latest_completed_visit),
        "in_progress_by_step": (BUSINESS, sankey.in_progress_by_step),
        "completed_by_step": (BUSINESS, sankey.completed_by_step),
        "sankey_nodes": (BUSINESS, sankey.sankey_nodes),
        "sankey_links": (BUSINESS, sankey.sankey_links),
    }
    without_scope: dict[str, tuple[str, Operator]] = {
        "hero_total_requests_compat": (
            NUMBERED,
            partial(hero.hero_total_requests_compat, scope=ONE_ORG),
        ),
        "hero_total_requests_compat_scoped": (
            NUMBERED,
            partial(hero.hero_total_requests_compat, scope=ONE_ORG_SCOPED),
        ),
        "detail_role_case": (
            NUMBERED,
            partial(durations.detail_role, scope=CASE_SCOPE, asap=CASE, as_of=AS_OF),
        ),
        "detail_step_case": (
            NUMBERED,
            partial(durations.detail_step, scope=CASE_SCOPE, asap=CASE, as_of=AS_OF),
        ),
        "detail_hero_case": (NUMBERED, partial(cases.detail_hero, asap=CASE)),
        "asap_detail_case": (NUMBERED, partial(cases.asap_detail, asap=CASE)),
        "user_time_case": (NUMBERED, partial(cases.user_time, asap=CASE)),
        "effective_durations": (
            NUMBERED,
            lambda s: _plain_numbers(durations.effective_durations(s, AS_OF)),
        ),
        "org_codes": (NUMBERED, hero.org_codes),
        "role_totals_by_case": (NUMBERED, durations.role_totals_by_case),
        "step_totals_by_case": (NUMBERED, durations.step_totals_by_case),
        "detail_hero": (NUMBERED, cases.detail_hero),
        "detail_hero_compat": (NUMBERED, cases.detail_hero_compat),
        "asap_detail": (NUMBERED, cases.asap_detail),
        "user_time": (NUMBERED, cases.user_time),
        "completed_steps": (BUSINESS, cases.completed_steps),
        "step_times": (BUSINESS, cases.step_times),
        "step_standards": (BUSINESS, cases.step_standards),
        "case_on_time_summary": (BUSINESS, cases.case_on_time_summary),
        "asap_list": (BUSINESS, cases.asap_list),
        "legend_steps": (NUMBERED, inspector.legend_steps),
        "legend_roles": (NUMBERED, inspector.legend_roles),
        "activity_legend": (NUMBERED, inspector.activity_legend),
        "activity_legend_nested": (
            NUMBERED,
            lambda s: _flat_legend(inspector.activity_legend_nested(s)),
        ),
    }
    found: dict[str, tuple[str, Operator]] = {}
    for name, (vocabulary, operator) in with_scope.items():
        found[name] = (vocabulary, partial(operator, scope=EVERYTHING))
        found[f"{name}_scoped"] = (vocabulary, partial(operator, scope=SCOPED))
    return {**found, **without_scope}


def catalog() -> dict[str, Query]:
    """Name -> callable of (session, directory of the tables)."""

    def query(vocabulary: str, operator: Operator) -> Query:
        return lambda spark, sf_dir: operator(from_star_schema(spark, sf_dir, vocabulary))

    return {name: query(*entry) for name, entry in operators().items()}
