"""Cutting lineage, and handing values to tasks.

Intermediate tables go to the folder that the cluster names in spark.checkpoint.dir, so
that they outlive any executor.  Modules are pickled by value, so executors need only
the public libraries and not this package on their path.
"""

from __future__ import annotations

import pickle
import sys
import tempfile
import uuid

import numpy as np
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir.  Where that is unset, a local folder if Spark runs in this process alone (tests), else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(spark, "_fieldkrig_shared", None) or tempfile.mkdtemp(prefix="fieldkrig-")
        spark._fieldkrig_shared = root
        root = f"file://{root}"
    return root.rstrip("/")


#: Frees the shuffle files of a query when it ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read it again.

    The copy outlives any executor.  The folder carries a fresh name, and is
    removed when the JVM that wrote it ends.  free: the shuffle files behind it go once it is written,
    and not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE, None)
    if free:
        spark.conf.set(FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(FREE, before or "false")
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcasts a value of this package's classes: they go by value, their arrays beside them, so that executors need no copy of the package and tasks copy no array."""
    arrays: list[pickle.PickleBuffer] = []
    head = cloudpickle.dumps(value, protocol=5, buffer_callback=arrays.append)
    return spark.sparkContext.broadcast((head, [np.frombuffer(x.raw(), np.uint8) for x in arrays]))


def shared(held: Broadcast):
    """In a task: the value of share(); its arrays are read-only."""
    head, arrays = held.value
    return pickle.loads(head, buffers=arrays)


def fits(df: DataFrame, rows: int) -> bool:
    """True if df has at most that many rows; reads no further than needed."""
    return len(df.limit(rows + 1).select(F.lit(1)).groupBy().count().filter(F.col("count") > rows).take(1)) == 0
