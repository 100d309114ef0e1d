"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import align, kneser_ney, langid, near, packing, pieces, pii, quality, rabitq, render, tokens, toxicity, whitening
from .oracles import ORACLES  # noqa: F401

QUERIES: dict = {}


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


@query("op4_quality_rules")
def op4(spark, d):
    docs = table(spark, d, "documents")
    return quality.quality_rules(docs, carry=("doc_id",)).select(*quality.OUTPUT)


@query("op7_minhash_near_dedup")
def op7(spark, d):
    return near.near_duplicates(table(spark, d, "documents"))


@query("op6_token_counts")
def op6(spark, d):
    return tokens.token_counts(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_best_fit_packing")
def op5(spark, d):
    return packing.best_fit_packing(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_lm_scoring")
def op9(spark, d):
    return kneser_ney.lm_scores(table(spark, d, "documents"))


@query("op8_toxicity")
def op8(spark, d):
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op2_personal_data")
def op2(spark, d):
    return pii.personal_data(table(spark, d, "documents"))


@query("op3_piece_encoding")
def op3(spark, d):
    return pieces.encode(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_html_rendering")
def op10(spark, d):
    return render.render_pages(table(spark, d, "pages"))


@query("op1_rabitq_neighbours")
def op1(spark, d):
    return rabitq.neighbours(table(spark, d, "embeddings"))


@query("op11_token_alignment")
def op11(spark, d):
    out = align.alignments(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return out.withColumn("groups_sha256", digest).drop("groups")


@query("op12_embedding_whitening")
def op12(spark, d):
    return whitening.whitening(table(spark, d, "embeddings"))


@query("op13_language_id")
def op13(spark, d):
    return langid.languages(table(spark, d, "documents"))
