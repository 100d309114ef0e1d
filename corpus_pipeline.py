"""From raw documents to packed training sequences.

``run`` applies the stages to the table ``documents``; every stage's result is
written as Parquet in the shared folder and read again before the next one.
All stages but the last return the columns of ``documents``, whatever these are called.

Defined cases: a null or empty text has too few words and is dropped by the quality rules; texts of any length are read
whole; rows that repeat a doc_id are one document to the near-duplicate stage and share its verdict, elsewhere each
counts; a row without a doc_id passes that stage, as no verdict can name it; among near-duplicates the smallest id
stays; without labels of both classes no document is toxic; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import near, packing, pii, quality, toxicity
from pageloom.llm.store import keep
from pageloom.session import ship

#: No stage after the first can be said in SQL; tests/llm/test_pipeline.py holds the whole against plain Python.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules keep."""
    return quality.keep_documents(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled ones among them, calls clean."""
    net, _ = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, net)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest
    id. Rows without an id cannot be named by a verdict and stay."""
    gone = keep(near.near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        .select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near-duplicates", near_dedup),
    ("personal data", redact_pii),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that pass all stages."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
