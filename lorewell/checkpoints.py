"""Results kept between the steps of an iteration."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own on a local master that names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="lorewell-")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over four tasks a core: a file of few row groups would leave all that is done by row to as few tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def kept(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint(eager=True)
