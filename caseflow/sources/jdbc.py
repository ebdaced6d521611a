"""``case_steps`` from a relational database over JDBC."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


from caseflow.sources.columns import from_source_columns


def jdbc_options(
    url: str,
    table: str,
    lower_step_id: int,
    upper_step_id: int,
    num_partitions: int,
    fetch_size: int = 10_000,
    extra: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Reader options: ``num_partitions`` parallel reads over ranges of the step id.

    The bounds only place the range borders; rows outside them are read by the
    first and last range.
    """
    if num_partitions < 1:
        raise ValueError("num_partitions must be positive")
    if lower_step_id >= upper_step_id:
        raise ValueError("lower_step_id must be below upper_step_id")
    return {
        **(extra or {}),
        "url": url,
        "dbtable": table,
        "partitionColumn": "STEP_ID",
        "lowerBound": str(lower_step_id),
        "upperBound": str(upper_step_id),
        "numPartitions": str(num_partitions),
        "fetchsize": str(fetch_size),
        "preferTimestampNTZ": "true",
    }


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    lower_step_id: int,
    upper_step_id: int,
    num_partitions: int,
    fetch_size: int = 10_000,
    extra: Mapping[str, str] | None = None,
    schema: StructType | None = None,
    bad_text: str = "error",
) -> DataFrame:
    """Read the titled source table in parallel and convert it by :func:`from_source_columns`.

    Pass user, password and driver class in ``extra``. Filters and column
    selection of the operators reach the database through Spark's pushdown.
    """
    options = jdbc_options(
        url, table, lower_step_id, upper_step_id, num_partitions, fetch_size, extra
    )
    return from_source_columns(spark.read.format("jdbc").options(**options).load(), schema, bad_text)
