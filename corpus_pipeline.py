"""From raw documents to token files: five stages, each written before the next reads it.

Language ID drops documents whose language cannot be told, near-dedup keeps one document
of each group of texts whose SimHash fingerprints differ in two bits or fewer or that share 0.8
of their word shingles, decontamination drops documents
that hold a benchmark item, mixing repeats or drops documents towards the sources' target
weights, and token output encodes what is left and returns its index.

Defined cases: null and empty texts have no letter and go in the first stage; where no row has
a language all texts with a letter stay; a null source is a source, a null doc_id an id, and of
null ids' near duplicates one stays; equal rows are one document to near-dedup and rows of their
own to language ID; further columns go through all stages but the last, whatever their names; an
empty documents or benchmark table gives what the other stages make of it, without an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdikt.llm.common import documents, shared_dir, written
from verdikt.llm.decontaminate import contaminated
from verdikt.llm.language_id import accepted
from verdikt.llm.mixing import mixed_documents
from verdikt.llm.near_dedup import deduplicated
from verdikt.llm.token_output import read_tokens, token_index, write_tokens


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["doc_id"]), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_tokens(docs, path)
    return token_index(read_tokens(spark, path))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: SQL can express neither the classifiers nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
