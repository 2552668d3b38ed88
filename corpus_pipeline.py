"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The classifiers' stages write
their result themselves, as Python then gets batches of 8 MB, not of 10,000 texts (``common.WHILE_WRITTEN``). Rows with a
null doc_id pass every filtering stage that isn't decided by their text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import table, written
from colloquy.llm.decontaminate import drop_contaminated
from colloquy.llm.language import drop_undetermined, fit_language
from colloquy.llm.near_duplicates import near_duplicates
from colloquy.llm.packing import best_fit_packing
from colloquy.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; learned from the labels outside their held-out fold."""
    return written(drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"))), "stage-toxicity")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determinable language go; learned from those outside the held-out fold."""
    return written(drop_undetermined(docs, fit_language(docs)), "stage-language")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group on five-word shingles stays, once."""
    kept = near_duplicates(docs, words=5).where("kept").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within its error budget, go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences of 2048 tokens."""
    return best_fit_packing(docs)


STAGES = [("toxicity", toxicity), ("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]
#: The classifiers and the tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = docs if hasattr(docs, "written_to") else written(docs, f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
