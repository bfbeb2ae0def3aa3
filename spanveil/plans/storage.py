"""Intermediate tables in the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; where none is set, a temporary one in a local session, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spanveil-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/spanveil/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: plans above start from the table, and lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes the scratch tables under ``spark.checkpoint.dir``, once nothing that reads them is left."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/spanveil")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of input that one task of a Python step should have at least.
TASK_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where it is so small that its scan or shuffle would give them too few tasks; larger input stays as it lies."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * TASK_BYTES else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` shuffled by a key into as many tasks as the session asks for, however small they are: what follows is worth them."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)
