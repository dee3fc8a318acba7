"""Silhouette of a clustering in true Euclidean distances.

The distances of a block of points to all others are summed by cluster while the table is read once: a task
holds the block and one sum per point of the block and cluster. Equal points are taken together with their count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col
from tablewright.functions.lineage import kept

BLOCK = 2000
_AT_ONCE = 256


def silhouette(points: DataFrame, columns: Sequence[str], cluster: str = "cluster", evaluated: int | None = None) -> DataFrame:
    """One row (points, silhouette): the mean over the points of (b - a) / max(a, b).

    a is a point's mean distance to the rest of its cluster, b the least mean distance to another cluster; a point alone in
    its cluster has 0. Every point is measured against all rows. With ``evaluated`` only so many different points, chosen by a
    hash, are measured (each weighted by its copies), which reads the table once; without it all are, block after block of
    ``BLOCK``, which is quadratic. Points without a cluster or a coordinate are left out; the silhouette of fewer than two clusters is NULL.
    """
    names = [f"x{i}" for i in range(len(columns))]
    plain = points.select(col(cluster).cast("string").alias("c"), *[col(x).cast("double").alias(n) for x, n in zip(columns, names)])
    distinct = plain.dropna().groupBy("c", *names).agg(F.count(F.lit(1)).alias("n"))
    hashed = distinct.withColumn("h", F.xxhash64("c", *names))
    spark, weight, total = points.sparkSession, 0, 0.0
    with kept(hashed) as (table,):
        sizes = {r["c"]: (r["rows"], r["different"]) for r in table.groupBy("c").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("different")).collect()}
        found = sum(d for _, d in sizes.values())
        if len(sizes) > 1:
            for block in _blocks(table, found, evaluated):
                chosen = block.select("c", "n", *names).toPandas()
                values = _of_block(table, chosen, names, {c: rows for c, (rows, _) in sizes.items()})
                weight += int(chosen["n"].sum())
                total += float(values @ chosen["n"].to_numpy(float))
    schema = "points bigint, silhouette double"
    return spark.createDataFrame([(weight, total / weight if weight else None)], schema)


def _blocks(table: DataFrame, found: int, evaluated: int | None) -> Iterator[DataFrame]:
    if evaluated is not None and evaluated < found:
        yield table.orderBy("h", "c", *[c for c in table.columns if c.startswith("x")]).limit(evaluated)
        return
    parts = -(-found // BLOCK)
    for i in range(parts):
        yield table.where(F.pmod("h", F.lit(parts)) == i)


def _of_block(table: DataFrame, chosen: pd.DataFrame, names: list[str], sizes: dict[str, int]) -> np.ndarray:
    """The silhouette of each chosen point."""
    if chosen.empty:
        return np.zeros(0)
    clusters = sorted(sizes)
    probes = table.sparkSession.sparkContext.broadcast(chosen[names].to_numpy(float))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = probes.value
        held = np.zeros((len(at), len(clusters)))
        for batch in batches:
            for start in range(0, len(batch), _AT_ONCE):
                part = batch.iloc[start : start + _AT_ONCE]
                gaps = np.zeros((len(at), len(part)))
                for i, n in enumerate(names):
                    gaps += (at[:, i][:, None] - part[n].to_numpy(float)[None, :]) ** 2
                shares = np.zeros((len(part), len(clusters)))
                shares[np.arange(len(part)), np.searchsorted(clusters, part["c"].to_numpy(str))] = part["n"].to_numpy(float)
                held += np.sqrt(gaps) @ shares
        rows, columns = np.nonzero(held)
        yield pd.DataFrame({"point": rows, "k": columns, "distance": held[rows, columns]})

    summed = table.mapInPandas(sums, "point long, k int, distance double").groupBy("point", "k").agg(F.sum("distance").alias("d")).toPandas()
    distances = np.zeros((len(chosen), len(clusters)))
    distances[summed["point"], summed["k"]] = summed["d"]
    probes.unpersist()
    rows = np.array([sizes[c] for c in clusters], float)
    place = np.searchsorted(clusters, chosen["c"].to_numpy(str))
    each = np.arange(len(chosen))
    alone = rows[place] == 1
    own = distances[each, place] / np.where(alone, 1.0, rows[place] - 1)
    others = distances / rows
    others[each, place] = np.inf
    nearest = others.min(axis=1)
    widest = np.maximum(own, nearest)
    return np.where(alone | (widest == 0), 0.0, (nearest - own) / np.where(widest == 0, 1.0, widest))
