"""Queries of the training-data operators, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isofield.llm import ann, embed_dedup, exponion, html_text, line_dedup, mixing, ngram_join, oracles, packing, quality, secret_spans, toxicity, turns, warc
from isofield.llm.common import scratch, table


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no URL: their source is the host, their source and language the path."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.read_pages(warc.archive(pages, scratch(spark, "warc")), pages)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near(table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans.scan(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_ngram_jaccard_join, op2_nearest_neighbours, op3_embedding_near_dedup, op4_best_fit_packing, op5_toxicity, op6_html_main_text, op7_site_quality, op8_warc_round_trip, op9_line_dedup, op10_source_mixing,
           op11_secret_spans, op12_conversation_repair, op13_exponion_clusters]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
