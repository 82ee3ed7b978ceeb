"""Scratch space that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``. A local session without one gets a folder below its
    warehouse; on a cluster that folder may be the driver's own disk, so there it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not (context.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/rulewright-{uuid.uuid4().hex}")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the checkpoint folder and read back: for rows that several later steps read."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
