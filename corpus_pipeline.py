"""A training corpus from raw documents: quality rules, exact and near deduplication, packed sequences.

Each stage takes all that the one before it kept and returns the columns of documents; the last returns the pieces of the
packed sequences with their token ids.

Every stage takes nulls in any column, repeated rows, empty tables and columns of any other name, which it carries
unchanged and never looks at; what it does with them is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliograph.llm import exactdedup, packing, quality, simhash
from foliograph.llm.common import written
from foliograph.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and come from a host whose documents mostly pass.

    Null and empty texts have no words and go; rows without a source are of one host; repeated rows count as often as they
    occur, and all of them stay or go.
    """
    return quality.apply_rules(docs, "source")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space: the longest, of equals that of the smallest doc_id.

    Null, empty and blank texts are one group; of rows with the same id and text one stays; a null doc_id counts as the largest.
    """
    return exactdedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more), that of the smallest doc_id.

    Groups are those of the links, so two texts may be in one by a third. A text of fewer than five words has one shingle, all
    of it; null and wordless texts are copies of one another alone; a null doc_id counts as the largest.
    """
    return simhash.deduplicate(docs, words=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens.

    Null and empty texts are the end id alone; repeated rows are packed each for itself.
    """
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("packing", pack)]

#: Byte-pair encoding and 64-bit fingerprints are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
