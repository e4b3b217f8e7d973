"""Tables that a job writes once and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own
    only in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("a cluster needs spark.checkpoint.dir: a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def shared(df: DataFrame) -> DataFrame:
    """``df``, worked out once: written as Parquet to the shared folder and read back, so a
    lost executor costs a re-read and no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/riskloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
