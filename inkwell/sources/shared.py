"""Where operations of several executors leave tables for each other."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on one machine, where that may be unset, one beside the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.master.startswith("local"):
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/inkwell-shared"
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A name below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
