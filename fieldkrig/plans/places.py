"""Places of rows in an order, without ordering all of them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written


def with_place(df: DataFrame, key: str, name: str) -> tuple[DataFrame, int]:
    """(df plus the place of each row by key, from 0; the number of rows).  key is unique.

    Ranges of the key are counted, and each range numbers its own rows from where the ranges before it end.
    """
    ranged = written(df.repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id()), "places")
    start, before = {}, 0
    for r in sorted(ranged.groupBy("_range").count().collect()):  # a row for each partition
        start[r["_range"]], before = before, before + r["count"]
    if not start:
        return df.withColumn(name, F.lit(0).cast("long")), 0
    first = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in start.items() for x in kv]), F.col("_range").cast("long"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return ranged.withColumn(name, first + own).drop("_range"), before
