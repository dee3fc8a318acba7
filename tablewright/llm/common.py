"""Shared pieces: where intermediates are written, reading tables, cutting texts into words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes per Arrow batch; keep a batch of long texts small in a Python worker.
ARROW_ROWS = 200
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches for texts, unless the session names another size itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` or the context's checkpoint folder; a temporary folder only for a local
    session, where all run on one machine. Anything else is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="tablewright-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """The table written once to the shared folder and read back: lineage is cut and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a NULL id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def own_names(df: DataFrame, **columns: str) -> DataFrame:
    """Only the needed columns under given names, so that further columns of any name cannot clash."""
    return df.select(*[F.col(f"`{name}`").alias(alias) for alias, name in columns.items()])


def as_text(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """The id as text: pandas would turn whole numbers beside a NULL into rounded doubles."""
    return df.withColumn(name, F.col(name).cast("string"))


def as_kind(df: DataFrame, kind: str, name: str = "doc_id") -> DataFrame:
    return df.withColumn(name, F.col(name).cast(kind))


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered; none for NULL."""
    return [] if text is None else text.encode("utf-8").lower().split()
