"""The catalog's queries as DuckDB SQL over the same parquet tables.

Written from the meaning of each report and not from the Spark plans, so the two
sides check each other.
"""

from __future__ import annotations

from collections.abc import Mapping

from caseflow.functions import constants as C
from caseflow.sources.star_schema import BUSINESS_STEPS

AS_OF = "TIMESTAMP '2002-01-01 00:00:00'"
EVERYTHING = (
    "case_created >= TIMESTAMP '1900-01-01' AND case_created < TIMESTAMP '2100-01-01'",
    "org_code IN (SELECT DISTINCT org_code FROM s WHERE org_code IS NOT NULL)",
)
SCOPED = (
    "case_created >= TIMESTAMP '1996-01-01' AND case_created < TIMESTAMP '2000-01-01'",
    "(org_code = 'Org 1' OR org_code = 'Org 2')",
)
METRICS = {
    "hero_total_requests": C.TOTAL_REQUESTS,
    "hero_active_requests": C.ACTIVE_REQUESTS,
    "hero_completed_requests": C.COMPLETED_REQUESTS,
    "hero_avg_cycle_time": C.AVERAGE_CYCLE_TIME,
    "hero_fastest_cycle_time": C.FASTEST_CYCLE_TIME,
}


def _literal(value: object) -> str:
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def _values(alias: str, columns: str, rows: Mapping) -> str:
    listed = []
    for key, value in rows.items():
        cells = value if isinstance(value, tuple) else (value,)
        listed.append("(" + ", ".join(_literal(cell) for cell in (key, *cells)) + ")")
    return f"(VALUES {', '.join(listed)}) AS {alias}({columns})"


def _standards(rows: Mapping) -> str:
    return _values("std", "std_name, standard_min, standard_max", rows)


def _colors(rows: Mapping) -> str:
    return _values("col", "col_name, color", rows)


NUMBERED_STEP = (
    "CASE WHEN l_partkey % 13 = 0 THEN NULL "
    "ELSE concat('Step Display Name ', CAST(l_partkey % 13 AS VARCHAR)) END"
)
BUSINESS_STEP = (
    "CASE l_partkey % 13 "
    + " ".join(f"WHEN {number} THEN {_literal(name)}" for number, name in BUSINESS_STEPS.items())
    + " END"
)


def _star(step_name: str) -> str:
    """``case_steps`` over the star schema."""
    return f"""
  SELECT concat('Ticket ', CAST(o_orderkey AS VARCHAR)) AS case_number,
    ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey AS step_id,
    {step_name} AS step_name,
    CASE WHEN l_suppkey % 7 = 0 THEN NULL
         ELSE concat('Role ', CAST(l_suppkey % 7 AS VARCHAR)) END AS role,
    concat('User ', CAST(l_suppkey AS VARCHAR)) AS assigned_to,
    CASE l_returnflag WHEN 'A' THEN 'Approve' WHEN 'R' THEN 'Return' END AS action_name,
    CASE WHEN l_partkey % 50 = 0 THEN NULL
         ELSE o_orderdate + INTERVAL '1' HOUR * CAST(l_partkey % 24 AS INT) END AS date_in,
    CASE WHEN l_linestatus = 'O' THEN NULL
         ELSE o_orderdate + INTERVAL '1' HOUR * CAST(l_partkey % 24 + 6 * l_quantity AS INT)
         END AS date_out,
    CASE WHEN l_linestatus = 'O' THEN NULL
         ELSE CAST(l_quantity * 0.25 AS DECIMAL(18,2)) END AS cycle_days,
    CASE WHEN l_linestatus = 'O' THEN NULL
         ELSE CAST(l_quantity * 6 AS DECIMAL(18,2)) END AS cycle_hours,
    o_orderdate AS case_created,
    CASE WHEN o_orderstatus = 'F' THEN 'Completed' ELSE 'Active' END AS case_status,
    CASE WHEN o_orderstatus = 'P' THEN NULL
         ELSE CAST(floor(o_totalprice / 1000) AS DOUBLE) END AS total_cycle_time,
    CASE WHEN c_nationkey % 7 = 0 THEN NULL
         ELSE concat('Org ', CAST(c_nationkey % 7 AS VARCHAR)) END AS org_code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""


def with_steps(case_steps: str, sql: str) -> str:
    """``sql`` over the CTEs ``s`` (case_steps) and ``d`` (with aged days and hours)."""

    def elapsed(unit: int) -> str:
        seconds = f"date_diff('second', date_in, {AS_OF})"
        return f"CAST(CAST(({seconds} * 100) // {unit} AS DECIMAL(16,0)) * 0.01 AS DECIMAL(18,2))"

    is_open = "date_out IS NULL AND date_in IS NOT NULL"
    return f"""WITH s AS ({case_steps}
), d AS (
  SELECT *, CASE WHEN {is_open} THEN {elapsed(86400)} ELSE cycle_days END AS days,
    CASE WHEN {is_open} THEN {elapsed(3600)} ELSE cycle_hours END AS hours
  FROM s
)
{sql}"""


FACT_COLUMNS = """case_number, step_id, step_name, role, assigned_to, action_name, date_in, date_out,
  CAST(cycle_days AS DOUBLE) AS cycle_days, CAST(cycle_hours AS DOUBLE) AS cycle_hours,
  case_created, case_status, total_cycle_time, org_code"""


def _stats(key: str, condition: str, standards: Mapping) -> str:
    return f"""
  SELECT name, average_duration, "min", "max", standard_min, standard_max FROM (
    SELECT {key} AS name, CAST(SUM(days) AS DOUBLE) / NULLIF(COUNT(days), 0) AS average_duration,
      CAST(MIN(days) AS DOUBLE) AS "min", CAST(MAX(days) AS DOUBLE) AS "max"
    FROM d WHERE {key} IS NOT NULL AND {condition} GROUP BY {key}
  ) LEFT JOIN {_standards(standards)} ON name = std_name"""


def _case_sums(key: str) -> str:
    return f"""
  SELECT case_number AS asap, {key} AS name, CAST(SUM(cycle_days) AS DOUBLE) AS total
  FROM s WHERE cycle_days IS NOT NULL GROUP BY case_number, {key}"""


def _detail(key: str, condition: str, standards: Mapping, case: str = "TRUE") -> str:
    totals = f"SELECT name, total FROM ({_case_sums(key)}) WHERE {case}"
    return f"""
SELECT name, average_duration, "min", "max", standard_min, standard_max, total AS avg_time
FROM ({_stats(key, condition, standards)}) LEFT JOIN ({totals}) USING (name)"""


def _count_cases(metric: str, condition: str) -> str:
    return (
        f"SELECT '{metric}' AS metric, COUNT(DISTINCT case_number) AS count "
        f"FROM s WHERE {condition}"
    )


def _hero(dates: str, orgs: str) -> dict[str, str]:
    where = f"{dates} AND {orgs}"
    names = METRICS
    return {
        "hero_total_requests": _count_cases(names["hero_total_requests"], where),
        "hero_active_requests": _count_cases(
            names["hero_active_requests"], f"case_status = 'Active' AND {where}"
        ),
        "hero_completed_requests": _count_cases(
            names["hero_completed_requests"], f"case_status = 'Completed' AND {where}"
        ),
        "hero_avg_cycle_time": f"""
SELECT '{names["hero_avg_cycle_time"]}' AS metric, AVG(longest) AS count FROM (
  SELECT case_number, MAX(total_cycle_time) AS longest FROM s WHERE {where} GROUP BY case_number)
""",
        "hero_fastest_cycle_time": f"""
SELECT '{names["hero_fastest_cycle_time"]}' AS metric, MIN(longest) AS count FROM (
  SELECT case_number, case_status, MAX(total_cycle_time) AS longest FROM s WHERE {where}
  GROUP BY case_number, case_status)
WHERE case_status = 'Completed' AND longest > 0""",
    }


def _inspector_half(kind: str, key: str, where: str, colors: Mapping, standards: Mapping) -> str:
    return f"""
  SELECT is_active, total_time, {C.CASE_TOTAL_MIN} AS total_min, {C.CASE_TOTAL_MAX} AS total_max,
    asap, name, color, duration_days, '{kind}' AS type, standard_min, standard_max
  FROM (
    SELECT case_status AS is_active, CAST(whole AS DOUBLE) AS total_time, case_number AS asap,
      {key} AS name, CAST(SUM(days) AS DOUBLE) AS duration_days
    FROM d JOIN (
      SELECT case_number, SUM(days) AS whole FROM d
      GROUP BY case_number HAVING SUM(days) < {C.OUTLIER_DAYS}
    ) USING (case_number)
    WHERE {where} GROUP BY ALL
  )
  LEFT JOIN {_colors(colors)} ON name = col_name
  LEFT JOIN {_standards(standards)} ON name = std_name"""


def _inspector(where: str) -> str:
    roles = _inspector_half("Role", "role", where, C.ROLE_COLORS, C.INSPECTOR_ROLE_STANDARDS)
    steps = _inspector_half("Step", "step_name", where, C.STEP_COLORS, C.DETAIL_STEP_STANDARDS)
    return f"{roles}\n  UNION ALL{steps}"


def _inspector_nested(where: str) -> str:
    def listed(kind: str) -> str:
        entry = (
            "concat_ws(':', coalesce(name, '-'), type, coalesce(color, '-'), "
            "coalesce(CAST(CAST(duration_days AS DECIMAL(18,2)) AS VARCHAR), '-'), "
            "coalesce(CAST(standard_min AS VARCHAR), '-'), "
            "coalesce(CAST(standard_max AS VARCHAR), '-'))"
        )
        return (
            f"coalesce(string_agg({entry}, ',' ORDER BY name ASC NULLS LAST) "
            f"FILTER (WHERE type = '{kind}'), '')"
        )

    return f"""
SELECT is_active, total_time, total_min, total_max, asap,
  COUNT(*) FILTER (WHERE type = 'Role') AS role_count,
  COUNT(*) FILTER (WHERE type = 'Step') AS step_count,
  {listed('Role')} AS roles, {listed('Step')} AS steps
FROM ({_inspector(where)})
GROUP BY is_active, total_time, total_min, total_max, asap"""


def _latest(where: str) -> str:
    return f"""
  SELECT step_name, case_number, MAX(step_id) AS step_id FROM s
  WHERE date_in IS NOT NULL AND date_out IS NOT NULL AND {where}
  GROUP BY step_name, case_number"""


def _completed(where: str) -> str:
    return f"""
  SELECT step_name, COUNT(DISTINCT case_number) AS completed FROM s
  WHERE step_id IN (SELECT step_id FROM ({_latest(where)}))
  GROUP BY step_name"""


def _in_progress(where: str) -> str:
    return f"""
  SELECT step_name, COUNT(DISTINCT case_number) AS in_progress FROM s
  WHERE date_in IS NOT NULL AND date_out IS NULL AND {where}
  GROUP BY step_name"""


def _nodes(where: str) -> str:
    def half(key: str, count: str, counts: str) -> str:
        return f"""
SELECT {key} AS "key", concat(step_name, ' (', {count}, ')') AS "text", color,
  standard_min, standard_max
FROM ({counts})
LEFT JOIN {_colors(C.FLOW_STEP_COLORS)} ON step_name = col_name
LEFT JOIN {_standards(C.FLOW_STEP_STANDARDS)} ON step_name = std_name"""

    done = half("step_name", "completed", _completed(where))
    running = half("concat(step_name, ' In Progress')", "in_progress", _in_progress(where))
    return f"{done}\nUNION{running}"


def _links(where: str) -> str:
    return f"""
SELECT step_name AS "from", next_name AS "to", completed AS width
FROM ({_completed(where)})
LEFT JOIN {_values("nxt", "this_name, next_name", C.NEXT_STEP)} ON step_name = this_name
UNION
SELECT step_name AS "from", concat(step_name, ' In Progress') AS "to", in_progress AS width
FROM ({_in_progress(where)})"""


def _detail_hero(completed: str) -> str:
    return f"""
SELECT DISTINCT case_number AS asap, remaining, completed, total_cycle_time, avg_cycle_time,
  case_status AS is_active, case_created AS date_start, date_end
FROM (SELECT DISTINCT case_number, case_status, case_created FROM s) JOIN (
  SELECT case_number, COUNT(step_name) FILTER (WHERE date_out IS NULL) AS remaining,
    {completed} AS completed, AVG(total_cycle_time) AS total_cycle_time,
    CAST(SUM(cycle_days) AS DOUBLE) / NULLIF(COUNT(cycle_days), 0) AS avg_cycle_time,
    MAX(date_out) FILTER (WHERE case_status = 'Completed') AS date_end
  FROM s GROUP BY case_number
) USING (case_number)"""


STEP_TIMES = """
  SELECT case_number, step_name, SUM(cycle_days) AS steptime FROM s
  GROUP BY case_number, step_name"""
COMPLETED_STEPS = """
  SELECT case_number, case_created, COUNT(DISTINCT step_name) AS completedsteps FROM s
  WHERE date_out IS NOT NULL GROUP BY case_number, case_created"""


def _step_standards() -> str:
    conditions = " OR ".join(
        f"(step_name = {_literal(name)} AND steptime {operator} {limit})"
        for name, (operator, limit) in C.ON_TIME_LIMITS.items()
    )
    return f"""
  SELECT case_number, step_name, CAST(steptime AS DOUBLE) AS steptime,
    CASE WHEN {conditions} THEN 1 ELSE 0 END AS withinstandards
  FROM ({STEP_TIMES})"""


def _summary() -> str:
    return f"""
  SELECT case_number, CAST(ontime AS BIGINT) AS ontimesteps, completedsteps, case_created
  FROM (SELECT case_number, SUM(withinstandards) AS ontime FROM ({_step_standards()})
        GROUP BY case_number)
  LEFT JOIN ({COMPLETED_STEPS}) USING (case_number)"""


def _legend(key: str, colors: Mapping) -> str:
    return f"""
  SELECT name, color FROM (SELECT DISTINCT {key} AS name FROM s)
  LEFT JOIN {_colors(colors)} ON name = col_name"""


def _activity_legend() -> str:
    bands = ", ".join(
        f"({position}, {_literal(name)}, {_literal(color)})"
        for position, (name, color) in enumerate(C.TOTAL_LEGEND.items(), 1)
    )
    by_name = "CAST(row_number() OVER (ORDER BY name ASC NULLS LAST) AS INTEGER) AS position"
    return f"""
SELECT 1 AS block_no, '{C.STEP_LEGEND_TITLE}' AS title, name, color, {by_name}
FROM ({_legend("step_name", C.STEP_COLORS)})
UNION ALL SELECT 2, '{C.TOTAL_LEGEND_TITLE}', name, color, position
FROM (VALUES {bands}) AS total(position, name, color)
UNION ALL SELECT 3, '{C.ROLE_LEGEND_TITLE}', name, color, {by_name}
FROM ({_legend("role", C.ROLE_COLORS)})"""


def _with_scope(dates: str, orgs: str) -> tuple[dict, dict]:
    where = f"{dates} AND {orgs}"
    in_scope = f"({where})"
    numbered = {
        "scoped_steps": f"SELECT {FACT_COLUMNS} FROM s WHERE {where}",
        **_hero(dates, orgs),
        "hero_stats": " UNION ALL ".join(
            f'SELECT metric, CAST("count" AS DOUBLE) AS "value" FROM ({sql})'
            for sql in _hero(dates, orgs).values()
        ),
        "role_durations": _stats("role", where, C.ROLE_STANDARDS),
        "role_durations_all_orgs": _stats("role", dates, C.ROLE_STANDARDS),
        "step_durations": _stats("step_name", where, C.STEP_STANDARDS),
        "detail_role": _detail("role", dates, C.ROLE_STANDARDS),
        "detail_step": _detail(
            "step_name", f"days < {C.OUTLIER_DAYS} AND {dates}", C.DETAIL_STEP_STANDARDS
        ),
        "inspector_rows": _inspector(in_scope),
        "inspector_nested": _inspector_nested(in_scope),
    }
    business = {
        "latest_completed_visit": _latest(where),
        "in_progress_by_step": _in_progress(where),
        "completed_by_step": _completed(where),
        "sankey_nodes": _nodes(where),
        "sankey_links": _links(where),
    }
    return numbered, business


def _per_case() -> dict[str, str]:
    """The reports of one case."""
    dates = "case_created >= TIMESTAMP '1992-01-01' AND case_created < TIMESTAMP '1999-01-01'"
    case = "asap = 'Ticket 23'"
    named = "COUNT(step_name) FILTER (WHERE date_out IS NOT NULL)"
    return {
        "detail_role_case": _detail("role", dates, C.ROLE_STANDARDS, case),
        "detail_step_case": _detail(
            "step_name", f"days < {C.OUTLIER_DAYS} AND {dates}", C.DETAIL_STEP_STANDARDS, case
        ),
        "detail_hero_case": f"SELECT * FROM ({_detail_hero(named)}) WHERE {case}",
        "asap_detail_case": f"SELECT * FROM ({ASAP_DETAIL}) WHERE case_number = 'Ticket 23'",
        "user_time_case": f"SELECT * FROM ({USER_TIME}) WHERE {case}",
    }


ASAP_DETAIL = """
SELECT case_number, date_in AS action_time, assigned_to AS "user", role, step_name, action_name
FROM s WHERE date_in IS NOT NULL"""
USER_TIME = """
SELECT assigned_to AS asap_user, CAST(SUM(cycle_days) AS DOUBLE) AS user_time, case_number AS asap
FROM s WHERE cycle_days IS NOT NULL GROUP BY case_number, assigned_to"""


def queries_by_vocabulary() -> tuple[dict[str, str], dict[str, str]]:
    """SQL over ``s`` and ``d`` by catalog name: numbered and business step names."""
    numbered: dict[str, str] = {
        "effective_durations": f"""
SELECT {FACT_COLUMNS}, CAST(days AS DOUBLE) AS days, CAST(hours AS DOUBLE) AS hours FROM d""",
        "org_codes": "SELECT DISTINCT org_code FROM s WHERE org_code IS NOT NULL",
        "role_totals_by_case": f"""
SELECT asap, name AS role, total AS avg_role_time FROM ({_case_sums("role")})""",
        "step_totals_by_case": f"""
SELECT asap, name AS step, total AS avg_role_time FROM ({_case_sums("step_name")})""",
        "detail_hero": _detail_hero("COUNT(step_name) FILTER (WHERE date_out IS NOT NULL)"),
        "detail_hero_compat": _detail_hero(
            "CASE WHEN bool_or(date_out IS NULL) "
            "THEN COUNT(step_name) FILTER (WHERE date_out IS NULL) END"
        ),
        "asap_detail": ASAP_DETAIL,
        "user_time": USER_TIME,
        **_per_case(),
        "legend_steps": _legend("step_name", C.STEP_COLORS),
        "legend_roles": _legend("role", C.ROLE_COLORS),
        "activity_legend": _activity_legend(),
        "activity_legend_nested": f"""
SELECT block_no, title, COUNT(*) AS row_count,
  string_agg(concat(coalesce(name, '-'), ':', coalesce(color, '-')), ',' ORDER BY position)
    AS entries
FROM ({_activity_legend()}) GROUP BY block_no, title""",
    }
    business: dict[str, str] = {
        "completed_steps": COMPLETED_STEPS,
        "step_times": f"""
SELECT case_number, step_name, CAST(steptime AS DOUBLE) AS steptime FROM ({STEP_TIMES})""",
        "step_standards": _step_standards(),
        "case_on_time_summary": _summary(),
        "asap_list": f"""
SELECT case_number AS asap,
  CAST(ontimesteps AS DOUBLE) / NULLIF(completedsteps, 0) AS percent_completed_within_time,
  case_created AS created_at FROM ({_summary()})""",
    }
    for suffix, scope in (("", EVERYTHING), ("_scoped", SCOPED)):
        first, second = _with_scope(*scope)
        numbered.update({name + suffix: sql for name, sql in first.items()})
        business.update({name + suffix: sql for name, sql in second.items()})
        numbered["hero_total_requests_compat" + suffix] = _count_cases(
            C.TOTAL_REQUESTS, f"{scope[0]} AND org_code = 'Org 1'"
        )
    return numbered, business


def oracle() -> dict[str, str]:
    """SQL over the star schema tables by catalog name."""
    numbered, business = queries_by_vocabulary()
    return {
        **{name: with_steps(_star(NUMBERED_STEP), sql) for name, sql in numbered.items()},
        **{name: with_steps(_star(BUSINESS_STEP), sql) for name, sql in business.items()},
    }
