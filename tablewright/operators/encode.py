"""Feature preparation: sorted label codes, mean filling, shared target codes, column alignment."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import broadcast_if, col, numeric_columns, resolve_target, string_columns
from tablewright.operators.fixes import column_means, fill_values
from tablewright.operators.sequence import ordinal_codes

MISSING_LABEL = "MISSING"


def align(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give both tables the sorted union of their columns; a column a table lacks is 0."""
    names = sorted({*left.columns, *right.columns})

    def widen(df: DataFrame) -> DataFrame:
        return df.select(*[col(c) if c in df.columns else F.lit(0).alias(c) for c in names])

    return widen(left), widen(right)


def split_target(df: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    name = resolve_target(df, target)
    return df.drop(name), df.select(col(name))


def code_table(*tables: DataFrame, column: str, fill: str | None = None) -> DataFrame:
    """Sorted codes of the distinct values one column holds in all given tables together."""
    values = None
    for t in tables:
        v = col(column).cast("string")
        one = t.select((F.coalesce(v, F.lit(fill)) if fill is not None else v).alias(column)).distinct()
        values = one if values is None else values.union(one)
    distinct = values.distinct() if len(tables) > 1 else values
    return ordinal_codes(distinct.filter(col(column).isNotNull()), column)


def row_counts(*tables: DataFrame) -> list[int]:
    """Rows of several tables, counted in one job."""
    if not tables:
        return []
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "n") for i, t in enumerate(tables)]
    found = {r["i"]: r["n"] for r in reduce(DataFrame.union, counts).collect()}
    return [found[i] for i in range(len(tables))]


class Size(NamedTuple):
    """Rows of a code table and bytes of its values."""

    rows: int
    text_bytes: int


def code_sizes(*tables: DataFrame) -> list[Size]:
    """Sizes of several code tables, from one job."""
    if not tables:
        return []
    text = F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).cast("long")
    sizes = [t.agg(F.count(F.lit(1)).alias("n"), text.alias("b")).select(F.lit(i).alias("i"), "n", "b") for i, t in enumerate(tables)]
    found = {r["i"]: Size(r["n"], r["b"]) for r in reduce(DataFrame.union, sizes).collect()}
    return [found[i] for i in range(len(tables))]


def apply_codes(
    df: DataFrame, column: str, codes: DataFrame, size: Size | None = None, fill: str | None = None
) -> DataFrame:
    """Replace a column by its codes; a value without a code becomes the next free code.

    The code table is broadcast only when its counted rows and bytes allow; a larger one, also one of few but long texts, is joined
    by shuffle, where AQE splits a dominant value.
    """
    size = code_sizes(codes)[0] if size is None else size
    v = col(column).cast("string")
    key = F.coalesce(v, F.lit(fill)) if fill is not None else v
    small = broadcast_if(codes.select(F.col("value").alias("_value"), F.col("code").alias("_code")), size.rows, text_bytes=size.text_bytes)
    coded = df.withColumn("_key", key).join(small, F.col("_key") == F.col("_value"), "left")
    value = F.when(F.col("_key").isNotNull(), F.coalesce("_code", F.lit(size.rows)))
    return coded.select(*[value.alias(column) if c == column else col(c) for c in df.columns])


def encode_target(df: DataFrame, target: str | None = None) -> DataFrame:
    """A string target becomes codes in sorted order; NULL stays NULL.  Other types pass unchanged."""
    name = resolve_target(df, target)
    if not isinstance(df.schema[name].dataType, T.StringType):
        return df
    return apply_codes(df, name, code_table(df, column=name))


Codes = dict[str, tuple[DataFrame, Size]]


@dataclass
class Fitted:
    """What the preparation of one table learned: means of numeric columns, code tables of categorical ones."""

    means: dict[str, float | None]
    codes: Codes


def encode_categoricals(df: DataFrame, columns: Sequence[str], fitted: Codes | None = None) -> tuple[DataFrame, Codes]:
    """NULL becomes the label MISSING, then every value its sorted code; returns the fitted code tables too."""
    if fitted is None:
        tables = [code_table(df, column=c, fill=MISSING_LABEL) for c in columns]
        fitted = dict(zip(columns, zip(tables, code_sizes(*tables))))
    for c in columns:
        codes, size = fitted[c]
        df = apply_codes(df, c, codes, size, fill=MISSING_LABEL)
    return df, fitted


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    """NULL labels become the most frequent label (the smallest of equally frequent ones)."""
    top = (
        df.filter(col(column).isNotNull())
        .groupBy(col(column).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "v")
        .limit(1)
        .collect()
    )
    if not top:
        return df
    dtype = df.schema[column].dataType
    return df.withColumn(column, F.coalesce(col(column), F.lit(top[0]["v"]).cast(dtype)))


def shared_target_codes(left: DataFrame, right: DataFrame, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Code the target of two tables by one map over the sorted union of its text values."""
    codes = code_table(left, right, column=target)
    size = code_sizes(codes)[0]
    return apply_codes(left, target, codes, size), apply_codes(right, target, codes, size), codes


def prepare_features(
    df: DataFrame, target: str, fitted: Fitted | None = None, keep: Sequence[str] = ()
) -> tuple[DataFrame, Fitted]:
    """Mean-fill numeric features and code categorical ones; columns of other types are dropped unless kept.

    With ``fitted`` of another table (the train part), its means and codes are used and nothing is learned here.
    """
    untouched = {target, *keep}
    numeric, strings = numeric_columns(df, untouched), string_columns(df, untouched)
    df = df.select(*[col(c) for c in df.columns if c in {*numeric, *strings, *untouched}])
    means = column_means(df, numeric) if fitted is None else {c: fitted.means.get(c) for c in numeric}
    df, codes = encode_categoricals(fill_values(df, means), strings, None if fitted is None else fitted.codes)
    return df, Fitted(means, codes)
