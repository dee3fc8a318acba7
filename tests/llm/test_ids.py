"""Ids beyond 2^53 beside NULL come back exactly."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tablewright.llm import chat_format, lm_score, near_dedup, packing, pieces

BIG = [2**60 + 1, 2**60 + 3, -(2**62) - 1, 0, None]


def chat(docs):
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")
    return chat_format.conversation_digests(chat_format.format_chat(turns)).withColumnRenamed("conv_id", "doc_id")


OPERATORS = {
    "score": lambda docs: lm_score.lm_scores(docs, F.lit(True)),
    "chat": chat,
    "packing": lambda docs: packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")),
    "pieces": lambda docs: pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model")),
    "near": near_dedup.near_duplicates,
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("kind", ["long", "string"])
def test_ids_come_back(spark, name, kind):
    docs = spark.createDataFrame([(i, f"some words of text {n} and more") for n, i in enumerate(BIG)], "doc_id long, text string").coalesce(1)
    found = OPERATORS[name](docs.withColumn("doc_id", F.col("doc_id").cast(kind)))
    assert found.schema["doc_id"].dataType.typeName() == kind
    assert sorted((r["doc_id"] for r in found.select("doc_id").collect()), key=str) == sorted((i if i is None or kind == "long" else str(i) for i in BIG), key=str)
