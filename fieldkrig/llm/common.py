"""Helpers that the operators of this subpackage share.

Kernel modules are pickled by value, so executors need only the public
libraries and not this repository on their path.
"""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import delete_on_exit, fits, share, shared, shared_dir, written

__all__ = ["BLANKS", "at_most", "delete_on_exit", "fits", "give_back", "let", "map_arrow", "row_key", "share", "shared", "shared_dir", "small_side", "table", "unused", "words_of", "written"]

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: ASCII white space as Java regular expressions write it.
BLANKS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, task, schema) -> DataFrame:
    """df.mapInArrow(task, schema), where a worker gives its free memory back to the system at the end of each task."""

    def run(batches):
        yield from task(batches)
        give_back()

    return df.mapInArrow(run, schema)


def at_most(df: DataFrame, tasks: int) -> int:
    """spark.sql.shuffle.partitions, but no more than there are keys to deal."""
    return min(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column, separators: str = BLANKS) -> Column:
    """The non-empty pieces between separators; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows apart that share a doc_id; rows equal in both get equal keys."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its row count is within the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if fits(df, rows) else df
