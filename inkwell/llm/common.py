"""What the operators share: reading tables and cutting lineage; bounds for Arrow batches are in functions.batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.batches import BATCH_BYTES, BATCH_CONF, Batches, lean, release, small_batches  # noqa: F401


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The whole table; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; raises where that is unset, as a local folder is no place for tables of a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.master.startswith("local"):
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/inkwell-shared"  # one machine: there is no other
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Later stages then start from files that every executor sees, so the loss of an executor
    costs no recomputation of what came before, and non-deterministic input is pinned down.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of cut() that nothing reads any more."""
    for table in tables:
        if table is not None:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(table.cut_path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, however its case, for columns of our own beside a caller's."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        found.append(name)
    return found


def whole_text(text: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def partitions(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions for a stage dealt by key: the session's number."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
