"""From raw documents to token ids: quality, toxicity, near-duplicates, mixing, BPE.

Each stage works on all rows that the stage before it kept, which are written as Parquet in the shared folder and read
again, so that the loss of an executor costs a part of one stage. All stages but the last return the columns of the
documents. Rows without an id are kept by every decision that needs an id; rows that share an id are one document to
the near-duplicate stage, of which one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.llm import bpe, mixing, near_dup, quality, toxicity
from cuelight.llm.queries import BYTE_BPE, TARGETS, domain_classifier
from cuelight.llm.store import Scratch, table

#: Documents below this probability of good quality go; so do documents at or above this probability of being toxic.
LEAST_QUALITY, MOST_TOXIC = 0.5, 0.3
#: Words of a shingle and least similarity (percent) of near-duplicates.
SHINGLE, SIMILAR = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model, LEAST_QUALITY)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    labels = toxicity.one_label(table(spark, sf_dir, "labels"))
    model = toxicity.fit(docs.select("doc_id", "text").join(labels, "doc_id"), label="label")
    return toxicity.keep_clean(docs, model, MOST_TOXIC)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates; of rows that share an id, the least in the order of the columns."""
    kept = near_dup.near_duplicates(docs, width=SHINGLE, percent=SIMILAR).filter("kept and doc_id is not null").groupBy("doc_id").count()
    chosen = docs.join(kept, "doc_id").select(*docs.columns, "count")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = chosen.filter("count > 1").groupBy("doc_id").agg(F.min(row).alias("row")).select("row.*")
    return chosen.filter("count = 1").drop("count").unionByName(again).unionByName(docs.filter("doc_id is null")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates say that bring the languages' tokens to their target weights."""
    model = domain_classifier(docs, table(spark, sf_dir, "labels"))
    mixture, _ = mixing.fit_rates(docs.select("doc_id", "text"), model, TARGETS)
    return mixing.mix(docs, mixture)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, lang, source, n_tokens, input_ids, and whether decoding gives the text again."""
    coded = bpe.encode_checked(docs.select("doc_id", "lang", "source", "text"), BYTE_BPE)
    return coded.select("doc_id", "lang", "source", F.size("input_ids").cast("long").alias("n_tokens"), "input_ids", "lossless")


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dup", near_dup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Fitted classifiers and iterated rates have no SQL form; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage returns is stored before the next one reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        out = scratch.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        docs = before = out
    return docs
