"""A training corpus from ``documents``: languages, quality, near-duplicates, packing.

Each stage works on all rows that the one before it kept; every stage but the
last returns the columns of ``documents``. Null and empty texts have no
language and go in the first stage; rows without an id stay as long as their
text does; repeated rows are near-duplicates of each other, so one stays. An
empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborlake.llm import lang_id, ngram_join, packing, quality
from arborlake.llm.graph import cut_lineage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled ones teach; rejected: no letters, or words that are mostly of none of them. Ties between languages do not matter here."""
    return lang_id.keep_identified(docs, lang_id.train(docs))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base measures and every quality rule; rows of one text stay or go together."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by five-word shingles at a similarity of 0.8; of repeated rows one."""
    return ngram_join.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens; the pieces and their places."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", rules), ("near_duplicates", near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs


#: Language models, the cascade and packing are beyond SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None
