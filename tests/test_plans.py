"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from caseflow.operators import cases, durations, hero, inspector, sankey
from caseflow.operators.scope import Scope
from caseflow.plans import reports
from caseflow.plans.catalog import operators
from caseflow.sources.parquet import read_parquet, write_parquet
from caseflow.sources.star_schema import from_star_schema

AS_OF = "2002-01-01"
SCOPE = Scope("1996-01-01", "1997-01-01", ["Org 1", "Org 2"])


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "case_steps")
    write_parquet(from_star_schema(spark, "/root/testdata/sf0.001"), path)
    # Plan as for tables too large to broadcast, and print the plans in full.
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.maxMetadataStringLength": "10000",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield read_parquet(spark, path)
    for key, value in before.items():
        spark.conf.set(key, value)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def count(frame, node):
    return len(re.findall(rf"\b{node}\b", plan(frame)))


@pytest.mark.parametrize("name", sorted(operators()))
def test_nothing_leaves_the_jvm_or_grows_without_bound(table, name):
    text = plan(operators()[name][1](table))
    for node in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text
    # A window always has a partition key.
    assert "windowspecdefinition(specifiedwindowframe" not in text


def test_headline_metrics_scan_once(table):
    frame = hero.hero_stats(table, SCOPE)
    assert count(frame, "FileScan") == 1
    assert count(frame, "Exchange") == 2
    text = plan(frame)
    read = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert set(re.findall(r"(\w+):", read)) == {
        "case_number",
        "case_created",
        "case_status",
        "total_cycle_time",
        "org_code",
    }
    assert "GreaterThanOrEqual(case_created" in text and "In(org_code" in text


def test_duration_statistics_shuffle_once(table):
    frame = durations.role_durations(table, SCOPE, AS_OF)
    assert (count(frame, "FileScan"), count(frame, "Exchange")) == (1, 1)
    # Sums run on longs: no decimal arithmetic in the aggregates.
    assert "MakeDecimal" not in plan(frame) and "decimal(28" not in plan(frame)


def test_detail_hero_scans_once(table):
    frame = cases.detail_hero(table)
    assert (count(frame, "FileScan"), count(frame, "Exchange")) == (1, 2)
    assert count(frame, "SortMergeJoin") == 0


def test_one_case_reaches_the_scan(table):
    for frame in (
        cases.detail_hero(table, "Ticket 23"),
        cases.asap_detail(table, "Ticket 23"),
        cases.user_time(table, "Ticket 23"),
        durations.role_totals_by_case(table, "Ticket 23"),
        durations.detail_role(table, SCOPE, "Ticket 23", AS_OF),
        durations.detail_step(table, SCOPE, "Ticket 23", AS_OF),
    ):
        assert "EqualTo(case_number,Ticket 23)" in plan(frame)


def test_inspector_scans_twice_and_nests_without_a_shuffle(table):
    rows = inspector.inspector_rows(table, SCOPE, AS_OF)
    nested = inspector.inspector_nested(table, SCOPE, AS_OF)
    assert count(rows, "FileScan") == count(nested, "FileScan") == 2
    # The rows have one exchange more, for their order.
    assert count(nested, "Exchange") == count(rows, "Exchange") - 1


def test_on_time_list_has_no_shuffle_by_case_and_step(table):
    frame = cases.asap_list(table)
    assert (count(frame, "FileScan"), count(frame, "Exchange")) == (2, 3)
    text = plan(frame)
    assert "hashpartitioning(case_number, step_name" not in re.sub(r"#\d+", "", text)
    # The sums need no step but those of the limits, and the join no exchange of its own.
    assert len(re.findall(r"SortMergeJoin|ShuffledHashJoin", text)) == 1


def test_completed_flow_uses_a_semi_join(table):
    assert "LeftSemi" in plan(sankey.completed_by_step(table, SCOPE))


def test_repeated_step_id_is_split(spark, table):
    settings = {
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in settings}
    hot = table.withColumn(
        "step_id",
        F.when(F.pmod(F.xxhash64("case_number"), F.lit(3)) == 0, 5).otherwise(F.col("step_id")),
    ).repartition(8)
    wanted = sorted(map(tuple, sankey.completed_by_step(hot).na.fill("-").collect()))
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        frame = sankey.completed_by_step(hot)
        assert sorted(map(tuple, frame.na.fill("-").collect())) == wanted
        frame.collect()
        assert "skew=true" in plan(frame)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_detail_spreads_each_name_over_the_shuffle(spark, table):
    frame = durations.detail_role(table, SCOPE, None, AS_OF)
    assert re.search(r"hashpartitioning\(name#\d+, slice#\d+", plan(frame))
    text = frame._jdf.queryExecution().optimizedPlan().toString()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert re.search(rf"pmod\(xxhash64\(case_number#\d+, 42\), {partitions}\)", text)


def test_detail_scans_twice_without_an_anti_join(table):
    frame = durations.detail_role(table, SCOPE, None, AS_OF)
    text = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in text and "Inner" in text and "LeftAnti" not in text
    frame.collect()
    final = plan(frame).split("== Initial Plan ==")[0]
    # The statistics are made once and used for the names with and without totals.
    assert len(re.findall(r"\bFileScan\b", final)) - final.count("ReusedExchange") <= 2


def test_a_name_with_most_totals_keeps_its_rows(spark, table):
    settings = {"spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    hot = table.withColumn("role", F.when(F.col("step_id") % 10 > 0, "Role 2").otherwise(F.col("role")))
    wanted = durations.role_totals_by_case(hot).where("role is not null").count()
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = durations.detail_role(hot, Scope(), None, AS_OF).where("avg_time is not null")
        assert rows.count() == wanted
        wider = durations.detail_role(hot, Scope(), None, AS_OF, slices=37)
        assert wider.where("avg_time is not null").count() == wanted
    finally:
        if before is None:
            spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        else:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", before)


def test_small_statistics_are_broadcast_once_measured(table):
    frame = durations.detail_role(table, SCOPE, None, AS_OF)
    assert "BroadcastHashJoin" not in plan(frame)
    frame.collect()
    assert "BroadcastHashJoin" in plan(frame)


def test_reports_hold_every_endpoint(table):
    found = {
        **reports.hero_stats(table, SCOPE),
        **reports.role_durations(table, SCOPE, AS_OF),
        **reports.step_durations(table, SCOPE, AS_OF),
        **reports.asap_inspector(table, SCOPE, AS_OF),
        **reports.sankey_diagram(table, SCOPE),
        **reports.detail_hero(table, "Ticket 23"),
        **reports.asap_detail(table, "Ticket 23"),
        **reports.user_time(table, "Ticket 23"),
        **reports.org_codes(table),
        **reports.asap_list(table),
    }
    assert sorted(found) == [
        "activity_data_rows",
        "activity_legend",
        "asap_detail",
        "asap_list",
        "detail_hero",
        "detail_roles",
        "detail_steps",
        "hero_stats",
        "link_data_array",
        "node_data_array",
        "org_codes",
        "role_durations",
        "step_durations",
        "user_time",
    ]
    assert all(frame.columns for frame in found.values())
    for detail in (
        reports.detail_role(table, SCOPE, "Ticket 23", AS_OF)["detail_roles"],
        reports.detail_step(table, SCOPE, "Ticket 23", AS_OF)["detail_steps"],
    ):
        assert detail.columns[-1] == "avg_time"
