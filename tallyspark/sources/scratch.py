"""Tables written between the steps of a loop."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """The table read back from a checkpoint: its lineage ends there. The folder is spark.checkpoint.dir, which all
    executors share; on a local master without one, where driver and executors are one process, a temporary one."""
    session = df.sparkSession
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        configured = session.conf.get("spark.checkpoint.dir", None)
        if not configured and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a loop needs a folder that all executors share")
        context.setCheckpointDir(configured or "file://" + tempfile.mkdtemp(prefix="tallyspark-"))
    return df.checkpoint()
