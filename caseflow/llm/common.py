"""Reading the tables and keeping intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where a local session has none, as in tests, a temporary folder is set and remembered. Executors on
    other machines could not see such a folder, so a cluster that names none is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="caseflow-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(frame: DataFrame) -> DataFrame:
    """Write ``frame`` as a table in the shared folder and read it again.

    The rows are then computed once, whatever reads them, and survive the loss of executors.
    ``forget`` deletes all tables that a session has stored.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/caseflow-tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete what ``stored`` has written in this session; call when its results are written."""
    path = f"{shared_folder(spark)}/caseflow-tables-{spark.sparkContext.applicationId}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as an empty one. Other columns cannot clash."""
    return docs.select(
        docs[id_column].cast("long").alias("doc_id"),
        F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"),
    )


def width(spark: SparkSession) -> int:
    """Number of tasks that a salted group is spread over: grows with the cluster's shuffle width."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def digest(spans: Column) -> Column:
    """Lowercase hex of the sha-256 of a string."""
    return F.sha2(spans.cast("binary"), 256)
