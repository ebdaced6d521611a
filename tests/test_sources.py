from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from caseflow.operators import cases, durations, hero
from caseflow.operators.scope import Scope, scoped_steps
from caseflow.schema import CASE_STEPS, CREATED_MONTH, SOURCE_COLUMNS
from caseflow.sources.columns import from_source_columns
from caseflow.sources.jdbc import jdbc_options
from caseflow.sources.parquet import read_flat_parquet, read_parquet, write_parquet
from caseflow.sources.star_schema import BUSINESS, from_star_schema
from hand_rows import AS_OF, as_set

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, steps, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "case_steps")
    write_parquet(steps, path)
    return path


def test_stored_table_keeps_every_row(spark, steps, stored):
    back = read_parquet(spark, stored)
    assert back.columns == [*steps.columns, CREATED_MONTH]
    assert as_set(back.drop(CREATED_MONTH)) == as_set(steps)


def test_stored_table_gives_the_same_results(spark, steps, stored):
    back = read_parquet(spark, stored)
    assert scoped_steps(back).columns == steps.columns
    assert durations.effective_durations(back, AS_OF).columns == [*steps.columns, "days", "hours"]
    for scope in (Scope(), Scope("2000-01-01", "2000-05-20"), Scope("2000-05-20", "2000-06-01")):
        assert as_set(hero.hero_stats(back, scope)) == as_set(hero.hero_stats(steps, scope))
        assert as_set(durations.detail_step(back, scope, "Ticket 1", AS_OF)) == as_set(
            durations.detail_step(steps, scope, "Ticket 1", AS_OF)
        )


def test_range_prunes_partitions(spark, stored):
    part = scoped_steps(read_parquet(spark, stored), Scope("2000-02-01", "2000-04-01"))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_month" in plan
    files = {row.file for row in part.select(F.input_file_name().alias("file")).collect()}
    assert all("created_month=2000" in name for name in files) and len(files) == 2


def test_existing_table_is_not_overwritten(steps, stored):
    with pytest.raises(Exception, match="already exists"):
        write_parquet(steps, stored)


def test_flat_parquet(spark, steps, tmp_path):
    steps.write.parquet(str(tmp_path / "flat"))
    assert as_set(read_flat_parquet(spark, str(tmp_path / "flat"))) == as_set(steps)


def test_source_columns(spark, steps):
    titled = steps.select(*(F.col(name).alias(title) for title, name in SOURCE_COLUMNS.items()))
    back = from_source_columns(titled)
    assert back.schema.simpleString() == CASE_STEPS.simpleString()
    assert as_set(back) == as_set(steps)


def titled(steps, **changes):
    names = {name: title for title, name in SOURCE_COLUMNS.items()}
    frame = steps.select(*(F.col(name).alias(title) for title, name in SOURCE_COLUMNS.items()))
    return frame.withColumns({names[name]: value for name, value in changes.items()})


def test_numbers_kept_as_text(spark, steps):
    days = F.when(F.col("STEP_ID") == 1, "n/a").otherwise("2.50")
    text = titled(steps, cycle_days=days, total_cycle_time=F.lit("12.5"))
    rows = from_source_columns(text, bad_text="null").where("case_number = 'Ticket 1'")
    rows = rows.orderBy("step_id")
    assert [row.cycle_days for row in rows.collect()] == [None] + [Decimal("2.50")] * 3
    assert rows.first().total_cycle_time == 12.5
    with pytest.raises(Exception, match="Cycle Time - Days: not a number: n/a"):
        from_source_columns(text).collect()
    with pytest.raises(ValueError, match="bad_text"):
        from_source_columns(text, bad_text="drop")


def test_a_decimal_source_keeps_its_scale(spark, steps):
    fine = F.lit("0.125").cast("decimal(38,10)")
    back = from_source_columns(titled(steps, cycle_days=fine))
    assert dict(back.dtypes)["cycle_days"] == "decimal(38,10)"
    assert {row.cycle_days for row in back.collect()} == {Decimal("0.125")}
    with pytest.raises(Exception, match="digits would be lost"):
        from_source_columns(titled(steps, cycle_days=fine), CASE_STEPS).collect()


@pytest.mark.parametrize("text", ["0.125", "1.0000000000000000001", "1e-30"])
def test_digits_of_a_text_are_not_lost(steps, text):
    with pytest.raises(Exception, match="digits would be lost"):
        from_source_columns(titled(steps, cycle_days=F.lit(text))).collect()


@pytest.mark.parametrize("column, value", [("step_id", "7.5"), ("cycle_days", 0.125)])
def test_digits_of_other_columns_are_not_lost(steps, column, value):
    with pytest.raises(Exception, match="digits would be lost"):
        from_source_columns(titled(steps, **{column: F.lit(value)})).collect()


def test_loss_would_change_sides_of_a_limit(spark, steps):
    """Eight visits of 0.125 days meet the limit of 1 day; eight of 0.13 do not."""
    one = steps.limit(1).crossJoin(spark.range(8)).withColumns(
        {"case_number": F.lit("Ticket 1"), "step_name": F.lit("Manpower Approval")}
    )

    def on_time(value, kind):
        rows = titled(one.drop("id"), cycle_days=F.lit(value).cast(kind))
        return cases.case_on_time_summary(from_source_columns(rows)).first()["ontimesteps"]

    assert on_time("0.125", "decimal(38,10)") == 1
    assert on_time("0.13", "decimal(38,10)") == 0


def test_missing_source_column(steps):
    with pytest.raises(ValueError, match="Date In"):
        from_source_columns(steps)


def test_jdbc_options():
    options = jdbc_options("jdbc:some:url", "t", 1, 1000, 16, extra={"user": "reader"})
    assert options["partitionColumn"] == "STEP_ID"
    assert (options["lowerBound"], options["upperBound"]) == ("1", "1000")
    assert options["numPartitions"] == "16" and options["user"] == "reader"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:some:url", "t", 1, 1000, 0)
    with pytest.raises(ValueError):
        jdbc_options("jdbc:some:url", "t", 5, 5, 4)


def test_star_schema(spark):
    steps = from_star_schema(spark, TABLES)
    assert steps.schema.simpleString() == CASE_STEPS.simpleString()
    assert steps.count() == 6000
    first = steps.where("case_number = 'Ticket 23'").first()
    assert first.role is None or first.role.startswith("Role ")
    assert isinstance(first.case_created, datetime)


def test_star_schema_vocabularies(spark):
    names = {
        row.step_name
        for row in from_star_schema(spark, TABLES, BUSINESS).select("step_name").distinct().collect()
    }
    assert len(names) == 13 and {"Submitted", "Step Display Name 12", None} <= names
    with pytest.raises(ValueError):
        from_star_schema(spark, TABLES, "other")
