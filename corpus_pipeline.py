"""The corpus pipeline: each stage is one of the operators, written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir). All but the last return the columns of documents; what a stage decides is carried out.
Extra columns stay, whatever their names; an empty table gives an empty result. Null and empty texts, rows without an id and
repeated rows are defined for each stage below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vistrel.llm.common import materialise, table
from vistrel.llm.decontamination import drop_contaminated
from vistrel.llm.exact_dedup import drop_exact_copies
from vistrel.llm.near_dedup import drop_near_copies
from vistrel.llm.packing import pack
from vistrel.llm.quality import drop_low_quality
from vistrel.llm.queries import tokenizer_file


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text scores as good; a null text scores as an empty one, repeated rows alike, rows without an id as others."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the largest id; null and empty texts are one text, a missing id loses to all others."""
    return drop_exact_copies(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component; texts without words and rows without an id are not linked and stay."""
    return drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds no benchmark item, each judged by its own text; texts without words hold none."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces; a null or empty text is the end mark alone."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: A trained classifier and MinHash links are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the first four stages keep of documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage{k + 1}")
    return docs
