"""Run independent Spark jobs side by side, so that short ones do not wait for each other."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def together(spark: SparkSession, actions: Iterable[Callable[[], object]], at_once: int = 4) -> list:
    """Results of the actions in their order; the first error is raised."""
    wrapped = [inheritable_thread_target(spark)(a) for a in actions]
    if len(wrapped) < 2 or at_once < 2:
        return [a() for a in wrapped]
    with ThreadPool(min(at_once, len(wrapped))) as pool:
        return pool.map(lambda a: a(), wrapped, chunksize=1)
