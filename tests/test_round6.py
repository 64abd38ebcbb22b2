"""The variogram cloud by pairs of blocks (round 3, F9)."""

import math
import os

import numpy as np
import pytest

SF = "/root/testdata/sf0.1"


def test_cloud_equals_all_pairs_whatever_the_rows(spark):
    from fieldkrig.operators.variogram import variogram_cloud

    rng = np.random.default_rng(7)
    at, z = rng.uniform(0, 0.35, (240, 2)), rng.normal(size=240)
    at[100:110] = at[0]  # one place
    ids = rng.choice(np.arange(-(2**62), 2**62, 2**53 + 1), 240, replace=False)  # beyond a double's integers
    rows = [(int(i), float(x), float(y), float(v)) for i, (x, y), v in zip(ids, at, z)]
    rows[5] = (*rows[5][:3], None)
    rows[6] = (*rows[6][:3], math.nan)
    rows[7:11] = [(rows[7][0], None, 0.1, 1.0), (rows[8][0], math.nan, 0.1, 1.0), (rows[9][0], math.inf, 0.1, 1.0), (None, 0.1, 0.1, 1.0)]
    rows[12] = (12, 0.099, 0.1, 1.0)
    rows[13] = (12, 0.101, 0.1, 2.0)  # equal ids in two cells are no pair
    df = spark.createDataFrame(rows, "id long, x double, y double, value double")
    want = {}
    for i, x, y, v in rows:
        for j, p, q, w in rows:
            if None in (i, j, x, y, p, q) or i >= j:
                continue
            h = math.sqrt((p - x) * (p - x) + (q - y) * (q - y))
            if 0 < h <= 0.1:
                want[i, j, h] = None if v is None or w is None else 0.5 * (w - v) * (w - v)
    out = variogram_cloud(df, 0.1)
    assert out.dtypes == [("i", "bigint"), ("j", "bigint"), ("h", "double"), ("gamma", "double")]
    found = out.collect()
    got = {(r["i"], r["j"], r["h"]): r["gamma"] for r in found}
    assert len(found) == len(got) and got.keys() == want.keys() and len(want) > 2000
    for k, g in want.items():
        assert (got[k] is None) == (g is None)
        assert g is None or got[k] == g or math.isnan(g) and math.isnan(got[k])
    assert any(g is None for g in want.values()) and any(g is not None and math.isnan(g) for g in want.values())


def test_cloud_of_one_cell_is_dealt_to_many_tasks(spark, monkeypatch):
    from fieldkrig.operators.variogram import variogram_cloud
    from fieldkrig.plans import blocks
    from pyspark.sql import functions as F

    monkeypatch.setattr(blocks, "BLOCK", 16)
    at = np.random.default_rng(8).uniform(0, 0.05, (400, 2))
    df = spark.createDataFrame([(i, float(x), float(y), 1.0) for i, (x, y) in enumerate(at)], "id long, x double, y double, value double")
    n = [r["count"] for r in variogram_cloud(df, 0.1).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(n) == 400 * 399 // 2
    assert len(n) > 8 and max(n) < sum(n) / 8


@pytest.mark.parametrize("held", [1 << 20, 5000])
def test_cloud_takes_few_bytes_a_row(spark, monkeypatch, tmp_path, held):
    from fieldkrig.operators.variogram import variogram_cloud
    from fieldkrig.plans import blocks
    from fieldkrig.queries import field, rounded

    monkeypatch.setattr(blocks, "HELD", held, raising=False)
    monkeypatch.setattr(blocks, "TASKS", 0)  # one task: the table is small
    df = field(spark, SF)
    size = lambda n: sum(os.path.getsize(os.path.join(tmp_path, n, f)) for f in os.listdir(tmp_path / n) if f.endswith(".parquet"))
    rounded(variogram_cloud(df, 0.1), "h", "gamma").write.parquet(str(tmp_path / "a"))
    rows = spark.read.parquet(str(tmp_path / "a")).count()
    xy = np.array([(r["x"], r["y"]) for r in df.select("x", "y").collect()])
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=-1))[np.triu_indices(len(xy), 1)]
    assert rows == ((d > 0) & (d <= 0.1)).sum()
    if held == 1 << 20:
        assert size("a") < 15 * rows
