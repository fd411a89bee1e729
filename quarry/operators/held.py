"""Rows that are written once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where ``spark.checkpoint.dir`` is unset and the master is local, a temporary one is made."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarry-"))
    return sc.getCheckpointDir()


def held(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint: what made it does not run again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def free(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that is no column of ``df``."""
    there, out, k = {c.lower() for c in df.columns}, name, 0
    while out.lower() in there:
        k += 1
        out = f"{name}_{k}"
    return out
