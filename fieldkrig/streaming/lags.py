"""Incremental variograms: partial sums of lag bins are additive, so new points only meet old ones.

``VariogramStream`` is a foreachBatch sink.  Each micro-batch of points (id, x, y,
value) is paired with itself and with the points of earlier batches, by cells; the sums
of the new pairs are stored under the batch's number, so a batch that is delivered again replaces its
own rows.  What has been stored is read from the folder and not remembered, so a stream that is
started again from its checkpoint goes on where it stopped, whichever object is its sink.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.variogram import lag_of
from ..plans.pairs import cross_pairs, pair_join


class VariogramStream:
    def __init__(self, spark: SparkSession, folder: str, n_lags: int, max_dist: float):
        self.spark, self.folder, self.n_lags, self.max_dist = spark, folder.rstrip("/"), n_lags, max_dist

    def stored(self, kind: str) -> list[int]:
        """Numbers of the batches whose points or sums were written to the end."""
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        top = jvm.Path(f"{self.folder}/{kind}")
        files = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(top):
            return []
        found = [(re.fullmatch(r"batch=(\d+)", s.getPath().getName()), s.getPath()) for s in files.listStatus(top)]
        return sorted(int(m[1]) for m, path in found if m and files.exists(jvm.Path(path, "_SUCCESS")))

    def _points(self, upto: int) -> DataFrame | None:
        old = [f"{self.folder}/points/batch={b}" for b in self.stored("points") if b < upto]
        return self.spark.read.parquet(*old) if old else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.select("id", "x", "y", "value").write.mode("overwrite").parquet(f"{self.folder}/points/batch={batch_id}")
        new, old = self.spark.read.parquet(f"{self.folder}/points/batch={batch_id}"), self._points(batch_id)
        dz = F.col("b_value") - F.col("a_value")
        pairs = pair_join(new, self.max_dist).select("d", dz.alias("dz"))
        if old is not None:
            pairs = pairs.union(cross_pairs(new, old, self.max_dist).select("d", dz.alias("dz")))
        sums = pairs.filter("d > 0").groupBy(lag_of(F.col("d"), self.max_dist, self.n_lags).alias("lag")).agg(F.sum("d").alias("sum_h"), F.sum(0.5 * F.col("dz") * F.col("dz")).alias("sum_g"), F.count(F.lit(1)).alias("n_pairs"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/sums/batch={batch_id}")

    def variogram(self) -> DataFrame:
        """lag, h, gamma, n_pairs of non-empty bins, over all batches."""
        found = [f"{self.folder}/sums/batch={b}" for b in self.stored("sums")]
        sums = self.spark.read.parquet(*found) if found else self.spark.createDataFrame([], "lag int, sum_h double, sum_g double, n_pairs long")
        return sums.groupBy("lag").agg((F.sum("sum_h") / F.sum("n_pairs")).alias("h"), (F.sum("sum_g") / F.sum("n_pairs")).alias("gamma"), F.sum("n_pairs").alias("n_pairs"))
