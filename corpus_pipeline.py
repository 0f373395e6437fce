"""A corpus from raw documents to packed training sequences; each stage's result is written and read again.

In every stage null, empty and blank texts count as texts without words, texts of any length are read as a whole,
repeated rows are judged alike, rows of a null doc_id stay unless their text is rejected, an empty table gives an empty
one, and other columns than doc_id and text are handed on without a look at them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import common, decontam, ngramjoin, packing, quality, tokens, toxicity


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents, doesn't reject; repeated rows all stay or all go."""
    return quality.keep(docs, quality.fit(docs))


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold; labels are learned from these documents. Texts without words stay."""
    return toxicity.keep(docs, toxicity.fit(docs, common.documents(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; texts without words and rows of a null doc_id all stay."""
    return ngramjoin.keep(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; texts without words stay."""
    return decontam.keep(docs, common.documents(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences; texts without words are one end id, repeated rows documents of their own."""
    return packing.pack(docs, tokens.tokenizer_path())


STAGES = [
    ("quality_classifier", keep_good),
    ("toxicity", keep_harmless),
    ("ngram_join", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("packing", pack),
]

#: SQL can't express the trained stages; a test holds the pipeline against brute force on its own stages' inputs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
