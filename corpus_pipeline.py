"""The corpus pipeline: five stages, each over all rows that the one before kept.

1. toxicity: documents that the tagger scores at its threshold or above go.
2. near copies: of each group of documents linked by 80% of their five-word shingles or more, the one with the smallest
   doc_id stays.
3. repeats: passages of 35 words or more that stand anywhere else are cut from the texts; no document is dropped.
4. benchmark: documents that hold a window of a benchmark item go.
5. mixing: the words to take from each document that is left.

Every stage is written as Parquet in the shared checkpoint folder and read again. Null and empty texts pass stages 1 to 4;
an empty table passes all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lurewatch.llm import decontaminate, jaccard_join, mixing, substring_dedup, toxicity
from lurewatch.llm.common import table
from lurewatch.session import cut_lineage

#: Words of a shingle and least percentage shared of near copies; the query op10 has its own.
NEAR_SIZE, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, table(sf_dir, "labels", spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, size=NEAR_SIZE, percent=NEAR_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(sf_dir, "benchmark", spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, "documents", spark)
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs


#: The tagger's fit has no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None
