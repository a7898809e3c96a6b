"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage is written as Parquet and reread as the next one's documents. All
but the last keep the columns of ``documents``, extra ones of any name too.
Repeated rows are judged and packed alike, very long texts are taken whole, and
an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import lines, minhash, mixing, packing, quality
from quern.llm.store import staged


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or a rule learned from the labels go; nulls and empty texts are among them."""
    return quality.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three-line windows that came before go; a document that loses all stays, empty, and a null text stays null."""
    return _sized(lines.deduplicated(docs, stats_col=None))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose five-word shingles are those of an earlier one to 0.8 or more; each is compared before it goes.

    Of nulls and texts without words the first stays.
    """
    return minhash.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, one of each source in part; a null source is a source, a text without words goes."""
    return _sized(mixing.repeated(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place. A null text would be its end token alone."""
    return packing.packed(packing.pieces(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: The fingerprints, the learned rules and the packing have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
