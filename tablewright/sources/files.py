"""CSV sources, result sinks and their readers.

Sinks are Spark writers: distributed, restartable, no driver-side files.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import col, null_nan
from tablewright.operators.outcomes import latest_registrations
from tablewright.operators.rules import DEFAULT_RULE, RULES_SCHEMA


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Without one, a local session takes the temporary folder of its machine; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/tablewright/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str, nan_to_null: bool = True) -> DataFrame:
    """A Parquet table with NaN normalised to NULL.

    Where a table is known to hold no NaN, ``nan_to_null=False`` lets range filters on its floating columns reach the scan.
    """
    table = spark.read.parquet(path)
    return null_nan(table) if nan_to_null else table


def read_headerless_csv(spark: SparkSession, path: str, schema: T.StructType | str, null_value: str = "?") -> DataFrame:
    """Names and types from the schema; the NULL token is recognised after leading blanks are trimmed."""
    return null_nan(
        spark.read.schema(schema).option("nullValue", null_value).option("ignoreLeadingWhiteSpace", True).csv(path)
    )


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None
) -> DataFrame:
    """A CSV file with header, read with a declared schema; only the wanted columns are parsed."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return null_nan(df if columns is None else df.select(*[col(c) for c in columns]))


def write_results(results: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    results.write.mode(mode).format(fmt).save(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def write_rules(rules: DataFrame, path: str) -> None:
    rules.write.mode("overwrite").json(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Saved rules; a field that is absent or NULL takes its default."""
    loaded = spark.read.schema(RULES_SCHEMA).json(path)
    types = {f.name: f.dataType for f in RULES_SCHEMA}

    def default(name: str):
        value = DEFAULT_RULE[name]
        if value == []:
            return F.array().cast(types[name])
        if value == {}:
            return F.create_map().cast(types[name])
        return F.lit(value).cast(types[name])

    return loaded.select(
        *[F.coalesce(col(n), default(n)).alias(n) if n in DEFAULT_RULE else col(n) for n in RULES_SCHEMA.names]
    )


def register_datasets(datasets: DataFrame, path: str, batch: str | None = None) -> None:
    """Append registrations with the time they were made; ``batch`` as for ``append_table``."""
    append_table(datasets.withColumn("registered_at", F.current_timestamp()), path, batch)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry with one record per dataset: the last one."""
    return latest_registrations(spark.read.parquet(path).drop("batch"))


def append_table(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Append rows (validation results, fix effects or their states) to a Parquet table.

    With a ``batch`` name the rows are that batch's, and writing it again replaces them, so a run that is tried again adds nothing twice.
    A table is written either always or never by batches; reading it then shows the name as a column ``batch``.
    """
    if batch is None:
        rows.write.mode("append").parquet(path)
        return
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"a batch name holds letters, digits, '_', '.' and '-' only: {batch!r}")
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All batches of a table as one, without the batch names."""
    wanted = spark.createDataFrame([], schema).schema
    return spark.read.schema(wanted).parquet(path).select(*[col(n) for n in wanted.names])
