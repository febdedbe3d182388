"""A corpus from raw documents to packed sequences: five stages, each reading what the one before it kept.

1. toxicity: documents that the grammar's model rejects go;
2. near_dedup: of each component of near duplicates the document with the least id stays;
3. substring_dedup: bytes covered by passages that start in a document with a smaller id are cut out (broken characters
   at the edges go too); a document that loses all its text goes;
4. mixing: sources are brought to their tempered weights; the budget is the least at which every source is written whole
   once, so no document goes and those of rarer sources repeat, up to four times;
5. packing: sequences of at most 2048 tokens.

Null texts count as empty and stay; a null id is linked with nothing, cut by nothing and kept; rows with equal ids are kept or
dropped together in stage 2 and take nothing from each other in stage 3; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.llm.common import shared_dir, table
from weftgraph.llm.mixing import mix
from weftgraph.llm.near_dedup import drop_near_duplicates
from weftgraph.llm.packing import pack_documents
from weftgraph.llm.substring_dedup import cut_documents
from weftgraph.llm.toxicity import drop_toxic, fit

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, budget=None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]
#: Token ids, hash trees and a fitted model are beyond SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_dir(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
