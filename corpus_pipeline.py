"""Corpus pipeline: from raw documents to a sharded mix.

1. language: documents whose language compression cannot tell go.
2. near_duplicates: of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays.
3. decontamination: documents in which ten consecutive words of a benchmark item (or a whole shorter item) occur go.
4. mixing: sources are brought to their target weights; a document taken twice is there twice.
5. sharding: what is left is dealt to shards of near equal bytes, equal texts together.

Every stage is a function (spark, docs, sf_dir) of all that its predecessor kept, which is written as Parquet and read
again.  All but the last return the columns of documents, extra ones included.  What each stage does with nulls, empty
and very long texts, ties, repeated rows and empty tables is stated by its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseweave.llm import decontam, langid, mixing, neardup, sharding
from caseweave.llm.common import table
from caseweave.session import cut


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs.select("doc_id", "text", "lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): the place of every row of the mix."""
    placed = cut(sharding.shard_by_links(sharding.nodes_of(docs)))
    return sharding.number_slots(placed, placed.count()).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixture), ("sharding", shards)]

#: Compression and label propagation are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
