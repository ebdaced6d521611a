"""``case_steps`` derived from an order star schema: an order is a case, a line item a step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caseflow.functions.columns import lookup
from caseflow.functions.constants import ACTIVE, COMPLETED, FLOW_STEPS
from caseflow.schema import CASE_STEPS

NUMBERED = "numbered"
BUSINESS = "business"

# Columns read from each table; naming them here spares a schema inference job.
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_returnflag string, l_linestatus string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int",
}

# Step names of the business vocabulary by part number; 0 has none.
BUSINESS_STEPS = {
    **dict(enumerate(FLOW_STEPS, start=1)),
    10: "Step Display Name 1",
    11: "Step Display Name 11",
    12: "Step Display Name 12",
}


def _code(prefix: str, number: Column) -> Column:
    return F.when(number != 0, F.concat(F.lit(prefix), number.cast("string")))


def _step_name(vocabulary: str) -> Column:
    number = (F.col("l_partkey") % 13).cast("int")
    if vocabulary == NUMBERED:
        return _code("Step Display Name ", number)
    if vocabulary == BUSINESS:
        return lookup(BUSINESS_STEPS, number)
    raise ValueError(f"unknown step vocabulary: {vocabulary!r}")


def from_star_schema(
    spark: SparkSession, directory: str, vocabulary: str = NUMBERED
) -> DataFrame:
    """Derive ``case_steps`` from ``lineitem``, ``orders`` and ``customer``.

    Orders meet customers first, so the largest table is shuffled once only.
    """

    def table(name: str) -> DataFrame:
        return spark.read.schema(TABLES[name]).parquet(f"{directory}/{name}.parquet")

    orders = table("orders")
    customer = table("customer")
    owned = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    visits = table("lineitem").join(owned, F.col("l_orderkey") == F.col("o_orderkey"))

    hour = F.col("l_partkey") % 24
    finished = F.col("l_linestatus") != "O"

    def hours_in(hours: Column) -> Column:
        return F.col("o_orderdate") + F.make_dt_interval(F.lit(0), hours.cast("int"))

    step_id = (
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")
    ) * 100_000 + F.col("l_suppkey")
    columns = {
        "case_number": F.concat(F.lit("Ticket "), F.col("o_orderkey").cast("string")),
        "step_id": step_id,
        "step_name": _step_name(vocabulary),
        "role": _code("Role ", F.col("l_suppkey") % 7),
        "assigned_to": F.concat(F.lit("User "), F.col("l_suppkey").cast("string")),
        "action_name": lookup({"A": "Approve", "R": "Return"}, F.col("l_returnflag")),
        "date_in": F.when(F.col("l_partkey") % 50 != 0, hours_in(hour)),
        "date_out": F.when(finished, hours_in(hour + 6 * F.col("l_quantity"))),
        "cycle_days": F.when(finished, F.col("l_quantity") * 0.25),
        "cycle_hours": F.when(finished, F.col("l_quantity") * 6),
        "case_created": F.col("o_orderdate"),
        "case_status": F.when(F.col("o_orderstatus") == "F", COMPLETED).otherwise(ACTIVE),
        "total_cycle_time": F.when(
            F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 1000)
        ),
        "org_code": _code("Org ", F.col("c_nationkey") % 7),
    }
    return visits.select(
        *(columns[field.name].cast(field.dataType).alias(field.name) for field in CASE_STEPS)
    )
