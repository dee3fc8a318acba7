"""Repeated rows, counted exactly while only hashes of most rows are shuffled.

A narrow row is its own key.  A wide one is first counted by a digest of 16 bytes; a digest seen once proves its row
different from all others.  Only rows whose digest was seen again are compared by their values, which tells apart
different rows of one digest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import col, groupable
from tablewright.functions.lineage import cut

# Repeated digests of 16 bytes that are sent to every executor (some 40 MB as a hash table); more of them are joined by shuffle.
BROADCAST_DIGESTS = 500_000
# Repeated digests whose rows are looked at before any other: one true repetition among them settles the question.
FIRST_LOOK = 100

Digest = Callable[[Sequence[Column]], list[Column]]


def two_hashes(values: Sequence[Column]) -> list[Column]:
    """Two independent 64-bit hashes of the values and their NULL flags."""
    plain = [part for v in values for part in (v, v.isNull())]
    return [F.xxhash64(F.lit("a"), *plain), F.xxhash64(F.lit("b"), *plain)]


def _is_narrow(rows: DataFrame) -> bool:
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return len(rows.columns) <= 4 and all(isinstance(f.dataType, fixed) for f in rows.schema)


def _digested(rows: DataFrame, digest: Digest) -> tuple[DataFrame, DataFrame]:
    """The rows with their digest, and the digests seen more than once."""
    names = ["_d0", "_d1"]
    marked = rows.withColumns(dict(zip(names, digest([col(c) for c in rows.columns]))))
    return marked, marked.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*names)


def _of_digests(marked: DataFrame, digests: DataFrame, found: int) -> DataFrame:
    side = F.broadcast(digests) if found <= BROADCAST_DIGESTS else digests
    return marked.join(side, ["_d0", "_d1"], "left_semi").drop("_d0", "_d1")


def count_repeats(df: DataFrame, by: Sequence[str] = (), exact: bool = False, digest: Digest = two_hashes) -> DataFrame:
    """(by..., repeats): rows beyond the first of each group of equal rows (NULL equals NULL), maps compared by their entries.

    Rows are compared with ``by`` among their columns.  Values of ``by`` without repeated rows may be absent; without ``by`` there
    is one row, 0 for an empty table.  ``exact=True`` groups by the values at once, for tables of mostly repeated rows.
    """
    rows = df.select(*groupable(df))
    if not (exact or _is_narrow(rows)):
        marked, digests = _digested(rows, digest)
        digests = cut(digests)
        found = digests.count()
        rows = _of_digests(marked, digests, found) if found else rows.limit(0)
    groups = rows.groupBy(*[col(c) for c in rows.columns]).agg((F.count(F.lit(1)) - 1).alias("_more"))
    return groups.groupBy(*[col(b) for b in by]).agg(F.coalesce(F.sum("_more"), F.lit(0)).alias("repeats"))


def all_different(df: DataFrame, digest: Digest = two_hashes) -> bool:
    """Whether no two rows are equal."""
    rows = df.select(*groupable(df))
    marked, digests = _digested(rows, digest)
    first = digests.limit(FIRST_LOOK).collect()
    if not first:
        return True
    looked = df.sparkSession.createDataFrame([tuple(r) for r in first], "_d0 long, _d1 long")
    alike = _of_digests(marked, looked, len(first)).groupBy(*[col(c) for c in rows.columns]).count().filter("count > 1")
    if not alike.isEmpty():
        return False
    # Only collisions so far; fewer than were asked for were all of them.
    return len(first) < FIRST_LOOK or count_repeats(df, digest=digest).first()["repeats"] == 0
