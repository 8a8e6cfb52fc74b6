"""Lineage cuts in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that spark.checkpoint.dir names, which all executors share.

    Where none is named, a session of one machine takes a temporary folder, which that machine's
    threads share; on a cluster an error is raised.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder and sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="leafmill-checkpoints-")
    if not folder:
        raise RuntimeError("spark.checkpoint.dir names no folder; set it to one that all executors share")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """`df` written to the shared checkpoint folder and read from there, so it survives lost executors and is computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)
