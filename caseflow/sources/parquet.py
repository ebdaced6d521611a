"""``case_steps`` as parquet, optionally partitioned by month of creation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from caseflow.schema import CASE_STEPS, CREATED_MONTH


def read_parquet(spark: SparkSession, path: str, schema: StructType = CASE_STEPS) -> DataFrame:
    """Read a table written by :func:`write_parquet`."""
    stored = StructType([*schema.fields, StructField(CREATED_MONTH, IntegerType())])
    return spark.read.schema(stored).parquet(path)


def read_flat_parquet(
    spark: SparkSession, path: str, schema: StructType = CASE_STEPS
) -> DataFrame:
    """Read ``case_steps`` files that are not partitioned."""
    return spark.read.schema(schema).parquet(path)


def write_parquet(steps: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``steps`` by month of creation, so that a date range prunes files.

    The rebalance hint gathers each month into files of about the advisory
    partition size: a month holding most rows is split over many tasks, small
    months share one. Sorting by case within a file lets the row group
    statistics skip to a single case.
    """
    created = F.col("case_created")
    month = (F.year(created) * 100 + F.month(created)).cast("int")
    (
        steps.withColumn(CREATED_MONTH, month)
        .hint("rebalance", F.col(CREATED_MONTH))
        .sortWithinPartitions(CREATED_MONTH, "case_number")
        .write.mode(mode)
        .partitionBy(CREATED_MONTH)
        .parquet(path)
    )
