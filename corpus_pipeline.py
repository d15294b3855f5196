"""From raw documents to packed training sequences, one written table a stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import dominance_packing, order_minhash, quality_cascade, quality_gbt
from plumbline.llm.common import discard, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts have no words, so they go; repeated rows stay
    repeated; an empty table stays empty; columns other than those of documents are dropped, as in all stages."""
    return quality_cascade.kept_documents(docs, COLUMNS).select(COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for quality. A null text is scored as an empty one and stays null; each
    row is scored, repeated or not; without usable labels all score 0.5 and go."""
    model = quality_gbt.train(docs, table(spark, sf_dir, "labels"))
    return quality_gbt.score_documents(docs.select(COLUMNS), model, COLUMNS).where("score >= 0.7").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of least doc_id (nulls last), then digest. Null and
    empty texts are one class, repeated rows are copies."""
    return order_minhash.one_of_each_class(docs.select(COLUMNS)).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place. A null text is empty and packs as its end id;
    keys may be null or repeat."""
    return dominance_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("quality classifier", quality_classifier), ("minhash near-dedup", near_dedup), ("best-fit packing", packing)]

#: Scores, alignments and packings have no SQL form; tests hold each stage against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)  # a stage's table is of no use once the next one is written
    return STAGES[-1][1](spark, docs, sf_dir)
