"""A pipeline over documents: quality rules, toxicity, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame; the next stage reads it back from a
table in the shared folder. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import host_rules, mixing, sentencepiece_bpe, simhash, toxicity
from lintlake.llm.common import table, written
from lintlake.llm.labelled import fold
from lintlake.llm.queries import piece_model_path


READ = ("doc_id", "text", "source")


def _packed(docs: DataFrame) -> DataFrame:
    """docs with all columns that no stage reads in one, out of the way of those a stage adds."""
    rest = [c for c in docs.columns if c not in READ]
    return docs.select(*READ, F.struct(F.lit(0).alias("__llm_none"), *rest).alias("__llm_rest"))


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    return packed.select(*(c if c in READ else F.col("__llm_rest")[c].alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules themselves and whose host does (a null verdict rejects)."""
    return _unpacked(host_rules.judge(_packed(docs)).where("kept"), docs)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; the model learns from the stage's own input."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    scored = toxicity.with_scores(_packed(docs), model)
    return _unpacked(scored.where("score < 0.5"), docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id (one row of it).

    Linked are fingerprints as in op5 and texts whose five-word shingles are alike to 0.8 or more.
    """
    return simhash.representatives(docs, similar=True).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document: number of ids, digests of the ids and of the decoded text."""
    return sentencepiece_bpe.digests(sentencepiece_bpe.encode_and_decode(docs, piece_model_path()))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_duplicates),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]
#: SQL cannot express the learnt and iterative stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
