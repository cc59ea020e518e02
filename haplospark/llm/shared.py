"""The folder that driver and executors share, and what operators keep there.

A cluster names the folder in ``spark.checkpoint.dir``. Only where that is unset (tests, one machine) a temporary
folder is made. Tables written here cut lineage: a lost executor costs a reread of files, not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, as a URI; it exists on return."""
    top = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not top:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(SETTING, top)
    return f"{top.rstrip('/')}/haplospark/{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return a scan of it."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, for tasks that read or write files of their own format."""
    return pafs.FileSystem.from_uri(uri)

