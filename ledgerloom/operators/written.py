"""Tables that cut the lineage of long computations."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame


@functools.cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the folder of ``spark.checkpoint.dir``, so that its lineage ends there; in a local run without it, in a temporary one."""
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder(context.applicationId)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
