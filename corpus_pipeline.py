"""The corpus pipeline: each stage works on all that the one before kept, and is written and read again in between.

Defined results of every stage: an empty table gives an empty table; columns of any name pass through but for packing's; repeated rows are
judged alike by the first two stages, which keep or drop both; rows without doc_id have no label, are judged by their text, pass both
dedup stages untouched and are packed; a null text is an empty one, which the rules drop.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulon.llm import packing, pu_classifier, quality_rules, simhash, substring_dedup
from granulon.llm.common import load, materialise, scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return pu_classifier.keep(docs, load(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list."""
    return quality_rules.keep(docs, load(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: Jaccard similarity of five-word shingles of 0.8 or more."""
    return simhash.keep(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; n_chars follows the text."""
    found = substring_dedup.remove(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in found.columns else found


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality_classifier), ("quality rules", rules), ("near dedup", near_dedup), ("substring dedup", substrings), ("packing", pack)]

#: The learned stages have no SQL; the whole is tested against stage-wise brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, written; what the stages wrote on the way is gone by then."""
    with scratch(spark):
        docs = load(spark, sf_dir, "documents")
        for name, f in STAGES[:-1]:
            docs = materialise(f(spark, docs, sf_dir), name.replace(" ", "-"))
        return materialise(STAGES[-1][1](spark, docs, sf_dir), "pieces", lasting=True)
