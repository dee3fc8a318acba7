"""Column classes and small expressions used everywhere.

Only three column classes matter: numeric, categorical (strings) and other.  NULL is the single missing
marker; ``null_nan`` turns NaN into NULL once, where a table enters.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)
BROADCAST_TEXT_BYTES = 32 * 1024 * 1024


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def column_classes(df: DataFrame) -> DataFrame:
    """One row per column: its name, its class and its position."""
    numeric, strings = set(numeric_columns(df)), set(string_columns(df))
    rows = [
        (name, "numeric" if name in numeric else "categorical" if name in strings else "other", i)
        for i, name in enumerate(df.columns)
    ]
    return df.sparkSession.createDataFrame(rows, "column string, class string, position int")


def resolve_target(df: DataFrame, target: str | None) -> str:
    """The named target, or the last column; a name the table does not have is an error."""
    name = df.columns[-1] if target is None else target
    if name not in df.columns:
        raise ValueError(f"target column {name!r} not found")
    return name


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def null_nan(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every float and double column (a projection, no shuffle)."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, FLOATING)}
    if not floating:
        return df
    return df.select(
        *[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floating else col(c).alias(c) for c in df.columns]
    )


def read_number(name: str) -> Column:
    """The text as a number, or NULL.

    Text that cannot start a number is ruled out by a pattern first: a failing cast costs an exception per value.
    """
    return F.when(col(name).rlike(r"^[\x00-\x20]*[0-9+\-.iInN]"), col(name).try_cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole as a double; NULL for an empty whole."""
    return F.try_divide(part.cast("double") * 100.0, whole.cast("double"))


def groupable(df: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    """Columns as grouping keys; maps become sorted entry arrays so that equal maps compare equal."""
    wanted = df.columns if columns is None else columns
    maps = {f.name for f in df.schema if isinstance(f.dataType, T.MapType)}
    return [F.array_sort(F.map_entries(col(c))).alias(c) if c in maps else col(c).alias(c) for c in wanted]


def hash_key(keys: Sequence[str], seed: int | str) -> Column:
    """A reproducible pseudo-random sort key: md5 over the key columns and the seed, as hex text; never NULL."""
    text = [F.coalesce(col(k).cast("string"), F.lit("\x00")) for k in keys]
    joined = text[0] if len(text) == 1 else F.concat_ws("|", *text)
    return F.md5(F.concat(joined, F.lit(f"-{seed}")))


def hex_share(share: float) -> str:
    """Hex text below which the given share of md5 keys falls ("g" sorts after all of them)."""
    return "g" if share >= 1 else format(int(share * 2**32), "08x")


def in_share(key: Column, share: float) -> Column:
    """True for the rows whose md5 key falls into the first ``share`` of the hash space."""
    return key < F.lit(hex_share(share))


def unit_interval(key: Column, start: int) -> Column:
    """A number in (0, 1) read from eight hex digits of an md5 key."""
    digits = F.conv(F.substring(key, start, 8), 16, 10).cast("double")
    return (digits + 0.5) / float(2**32)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if(df: DataFrame, rows: int, limit: int = 100_000, text_bytes: int = 0) -> DataFrame:
    """Broadcast a table only when its counted rows and the counted bytes of its texts stay below the limits; otherwise leave the
    join to AQE."""
    return F.broadcast(df) if rows <= limit and text_bytes <= BROADCAST_TEXT_BYTES else df
