"""Exact deduplication as a stateful stream: one state entry per distinct text, kept for good.

A structured stream reads the files of a table and aggregates by the SHA-256 of the text, in RocksDB state on disk
without a watermark, so no entry expires. An entry holds the number of rows, the largest id and that row's locator (a
hash of file and position). A checkpoint folder that is used again goes on where it ended: only new files are read.

A digest is never trusted alone: the full texts behind each digest are compared, smallest against largest in byte order,
and rows whose texts differ under one digest are told apart by the text itself. All of it is DataFrame code.

Cases: a NULL text counts as empty; a NULL id is smaller than any other; of rows equal in text and id, one locator stays;
an empty table gives an empty table; other columns are carried by :func:`drop_copies` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import fresh_path, stored

LEAST = -(2**63)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bytes of files that one micro-batch takes in.
BATCH_BYTES = 64 << 30
DIGEST_BYTES = 32


def located(rows: DataFrame, doc_id: str, text: str, digest_bytes: int) -> DataFrame:
    """Id, digests, locator and text of every row of a file source."""
    full = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return rows.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LEAST)).alias("id"),
        full.alias("text"),
        F.unhex(F.sha2(full.cast("binary"), 256)).alias("sha"),
        F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("at"),
    ).withColumn("digest", F.substring("sha", 1, digest_bytes))


def stream_state(spark: SparkSession, path: str, schema, doc_id: str, text: str, digest_bytes: int, checkpoint: str, batch_bytes: int) -> DataFrame:
    """Run the stream over all files not yet read; its state as (digest, keep_at, keep_id, n)."""
    session = spark.newSession()
    for key, value in {
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores reserve no disk
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }.items():
        session.conf.set(key, value)
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a path may name one file as well as a folder
    source = session.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(pattern)
    entries = located(source, doc_id, text, digest_bytes).groupBy("digest").agg(F.max_by("at", "id"), F.count(F.lit(1)))
    query = entries.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    state = spark.read.format("statestore").load(checkpoint)
    at, keep_id, n = (F.col(f"value.`{name}`") for name in state.schema["value"].dataType.names)
    return state.select(F.col("key.digest").alias("digest"), at.alias("keep_at"), keep_id.alias("keep_id"), n.alias("n"))


def dedup(
    spark: SparkSession,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    checkpoint: str | None = None,
    batch_bytes: int = BATCH_BYTES,
    digest_bytes: int = DIGEST_BYTES,
) -> DataFrame:
    """One row per row of the Parquet files at ``path``: doc_id, keep_id, group_size, kept, text_sha256, at (locator).

    With ``checkpoint`` given again, entries of earlier runs count as seen; files must not be changed in between.
    ``digest_bytes`` shortens the digest that keys the state (tests use it to force collisions).
    """
    path = path.rstrip("/")
    files = spark.read.parquet(path)
    state = stream_state(spark, path, files.schema, doc_id, text, digest_bytes, checkpoint or fresh_path(spark, "dedup-state"), batch_bytes)
    rows = located(files, doc_id, text, digest_bytes)
    # Full bytes: equal texts are those whose smallest and largest are the same.
    checked = rows.groupBy("digest").agg((F.min("text") == F.max("text")).alias("same"))
    entries = stored(state.join(checked, "digest"), "dedup-entries")
    alike = rows.select("id", "sha", "at", "digest").join(entries.where("same").drop("same"), "digest")
    names = ["id", "sha", "at", "keep_at", "keep_id", "n"]
    found = alike.select(*names)
    differing = entries.where("NOT same").select("digest")
    if not differing.isEmpty():
        apart = rows.join(differing, "digest", "left_semi")
        groups = apart.groupBy("digest", "text").agg(F.max_by("at", "id").alias("keep_at"), F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        found = found.union(apart.join(groups, ["digest", "text"]).select(*names))
    present = lambda c: F.when(F.col(c) > LEAST, F.col(c))
    return found.select(
        present("id").alias("doc_id"),
        present("keep_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("at") == F.col("keep_at")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "at",
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of any table that stay, with all their columns; the table is written once as the store of contents."""
    spark = docs.sparkSession
    path = fresh_path(spark, "dedup-contents")
    docs.write.parquet(path)
    stay = dedup(spark, path, doc_id, text).where("kept").select(F.col("at").alias("__at"))
    contents = spark.read.parquet(path)
    return contents.withColumn("__at", F.xxhash64("_metadata.file_path", "_metadata.row_index")).join(stay, "__at", "left_semi").drop("__at")
