"""Cutting a plan between the phases of a search."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder of spark.checkpoint.dir, from where lost executors' work is read again.

    Only where no folder is set, as in tests, an own one is.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp())
    return df.checkpoint()
