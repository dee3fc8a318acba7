"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. toxicity: documents that the classifier finds toxic go; it learns from the labelled documents among its input.
2. quality: documents that a rule of the cascade rejects go.
3. exact dedup: of equal texts the row with the largest id stays.
4. near dedup: of each group of near-duplicates one row with the smallest id stays, rows without an id last.
5. packing: the pieces of all documents that are left, in windows of 4096 tokens.

All stages but the last return the columns of their input. NULL and empty texts go with the quality rules, repeated rows
with the exact duplicates, and empty tables pass through.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import fresh_path, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the cut."""
    from tablewright.llm.toxicity import CUT, learn, toxicity

    model = learn(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return docs.where(toxicity(model, F.col("text"), spark) < CUT)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    from tablewright.llm.quality import cascade

    return docs.where(cascade(docs)["kept"])


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each distinct text."""
    from tablewright.llm.exact_dedup import drop_copies

    return drop_copies(docs)


def told_apart(docs: DataFrame) -> DataFrame:
    """The table with a number for each row, ``__at``: its place in the files it is read from, or else in a copy."""
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    try:
        placed = docs.withColumn("__at", place)
        rows, places = placed.agg(F.count(F.lit(1)), F.count_distinct("__at")).first()
    except AnalysisException:  # not read from files
        rows, places = 1, 0
    if rows == places:
        return placed
    path = fresh_path(docs.sparkSession, "near-dedup-contents")
    docs.write.parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path).withColumn("__at", place)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates; rows are told apart by their place in the written table, not by id."""
    from tablewright.llm.near_dedup import near_duplicates

    contents = told_apart(docs)
    found = near_duplicates(contents, doc_id="__at").select(F.col("doc_id").alias("__at"), "component_id")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__at")).alias("first")
    stay = contents.select("__at", "doc_id").join(found, "__at").groupBy("component_id").agg(smallest).select("first.__at")
    return contents.join(stay, "__at", "left_semi").drop("__at")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into windows."""
    import public_tokenizers

    from tablewright.llm.packing import pack

    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: SQL cannot train the classifier or tokenise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = fresh_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
