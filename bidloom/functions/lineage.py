"""Cutting lineage by writing to the folder that the cluster names for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint in spark.checkpoint.dir. Only a local master (tests on one machine) may leave that unset; a cluster gets an error then,
    as a folder of the driver's own would be lost to the executors. ``spark.cleaner.referenceTracking.cleanCheckpoints`` has Spark remove what is no longer used."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="bidloom-"))
    return df.checkpoint()
