"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, computed once and read back from the folder in spark.checkpoint.dir or, on a local master where that is unset, a temporary one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="quillmark-checkpoint-")
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)
