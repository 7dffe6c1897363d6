"""A corpus pipeline of five stages: quality rules, near-duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but
the last return the columns of documents. Nulls, empty texts and repeated rows follow the rules of
the operators that the stages call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from formulary.llm import mixing, packing, quality_rules, simhash_dedup, substring_dedup
from formulary.llm.common import dropped, settled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' production policy keeps."""
    return quality_rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near-duplicates: fingerprints pruned by chains, then a Jaccard similarity of 0.8 or more of five-word shingles."""
    return simhash_dedup.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words that a passage of 50 words or more repeats from a document with a smaller id; rows without an id come last."""
    return substring_dedup.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents or runs of them; a document that is taken twice comes twice."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 1024, with the ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packing", packed),
]

#: Fingerprints, the mix's permutations and token ids are outside SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage keeps is written and read again, as the next one's input; what it stored on its way, and then that input, is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
