"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir. Only a local session may name none: it gets a temporary one."""
    top = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(SETTING, top)
    return f"{top.rstrip('/')}/haplospark/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder that the cluster names in spark.checkpoint.dir; executors may be lost afterwards.

    A scan of files starts a plan of its own: a checkpoint would hand on what the optimizer knows of its rows, and over many
    rounds of self-joins that knowledge takes longer to combine than the joins.
    """
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
