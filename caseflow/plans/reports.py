"""The twelve reports, each as named DataFrames built from one ``case_steps`` table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from caseflow.operators import cases, durations, hero, inspector, sankey
from caseflow.operators.scope import Scope

Report = dict[str, DataFrame]
AsOf = datetime | str | None


def hero_stats(steps: DataFrame, scope: Scope = Scope()) -> Report:
    return {"hero_stats": hero.hero_stats(steps, scope)}


def role_durations(steps: DataFrame, scope: Scope = Scope(), as_of: AsOf = None) -> Report:
    return {
        "detail_roles": durations.role_totals_by_case(steps),
        "role_durations": durations.role_durations(steps, scope, as_of),
    }


def step_durations(steps: DataFrame, scope: Scope = Scope(), as_of: AsOf = None) -> Report:
    return {
        "detail_steps": durations.step_totals_by_case(steps),
        "step_durations": durations.step_durations(steps, scope, as_of),
    }


def asap_inspector(steps: DataFrame, scope: Scope = Scope(), as_of: AsOf = None) -> Report:
    return {
        "activity_data_rows": inspector.inspector_nested(steps, scope, as_of),
        "activity_legend": inspector.activity_legend_nested(steps),
    }


def sankey_diagram(
    steps: DataFrame, scope: Scope = Scope(), counts: DataFrame | None = None
) -> Report:
    """Nodes and links. Pass a persisted ``flow_counts`` to count once for both."""
    if counts is None:
        counts = sankey.flow_counts(steps, scope)
    return {
        "node_data_array": sankey.nodes_of(counts),
        "link_data_array": sankey.links_of(counts),
    }


def detail_role(
    steps: DataFrame, scope: Scope = Scope(), asap: str | None = None, as_of: AsOf = None
) -> Report:
    return {"detail_roles": durations.detail_role(steps, scope, asap, as_of)}


def detail_step(
    steps: DataFrame, scope: Scope = Scope(), asap: str | None = None, as_of: AsOf = None
) -> Report:
    return {"detail_steps": durations.detail_step(steps, scope, asap, as_of)}


def detail_hero(steps: DataFrame, asap: str | None = None) -> Report:
    return {"detail_hero": cases.detail_hero(steps, asap)}


def asap_detail(steps: DataFrame, asap: str | None = None) -> Report:
    return {"asap_detail": cases.asap_detail(steps, asap)}


def user_time(steps: DataFrame, asap: str | None = None) -> Report:
    return {"user_time": cases.user_time(steps, asap)}


def org_codes(steps: DataFrame) -> Report:
    return {"org_codes": hero.org_codes(steps)}


def asap_list(steps: DataFrame) -> Report:
    return {"asap_list": cases.asap_list(steps)}
