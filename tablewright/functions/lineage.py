"""Keep an intermediate table that several later jobs read."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_checkpoints(spark: SparkSession) -> bool:
    """Whether the cluster names a shared checkpoint folder; the context is pointed at it if it is not yet."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return bool(folder)


def cut(df: DataFrame) -> DataFrame:
    """The table computed once: written to the cluster's shared checkpoint folder, or, where none is configured, kept in
    executor storage as it is first read."""
    return df.checkpoint(eager=True) if shared_checkpoints(df.sparkSession) else df.persist(StorageLevel.MEMORY_AND_DISK)


@contextmanager
def kept(*tables: DataFrame) -> Iterator[list[DataFrame]]:
    """Tables computed once for the jobs of a block: in the shared checkpoint folder, which survives lost executors;
    where none is configured, in executor storage, from which lost parts are recomputed."""
    if tables and shared_checkpoints(tables[0].sparkSession):
        yield [t.checkpoint(eager=True) for t in tables]
        return
    stored = [t.persist(StorageLevel.MEMORY_AND_DISK) for t in tables]
    try:
        yield stored
    finally:
        for t in stored:
            t.unpersist()
