"""Cutting a plan where what follows would recompute it or grow beyond generated code."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there; it survives lost executors.

    The folder is that of spark.checkpoint.dir; a local session without one gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="valuemesh-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
