"""Session-derived settings shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: a group below this many rows is never split, whatever its share of the table
HOT_ROWS_DEFAULT = 200_000
#: upper bound of the number of pieces; bounds every broadcast made by ``scan``
MAX_PARTS = 4096


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.spanaccord.hotRows", str(HOT_ROWS_DEFAULT)))


def parts(spark: SparkSession) -> int:
    """Number of equal shares a table is thought of as having."""
    return max(8, min(MAX_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))


def _shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names for checkpoints, if it names one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return named or spark.sparkContext.getCheckpointDir()


def _local_folder(spark: SparkSession, prefix: str) -> str:
    """A temporary folder for tests on one machine; on a cluster its files would not be shared."""
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only
    where nothing is set (tests on one machine) a fresh folder is made.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared_folder(spark) or _local_folder(spark, "spanaccord-ckpt-"))
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files of one run, in the shared checkpoint folder where there is one."""
    base = _shared_folder(spark) or _local_folder(spark, "spanaccord-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows from files made once, for tables that are read many times or in few of their columns."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
