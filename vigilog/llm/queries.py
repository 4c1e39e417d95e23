"""The registered queries over the operators of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    decontaminate, graph_search, hard_negatives, html_text, jaccard_join, language_id, license_scan, packing, periodic_runs,
    quality_rules, sharding, suffix_dedup, url_filter,
)
from .common import table


def vocabulary() -> str:
    """The place of the tokenizer file that ``op9_packing`` packs for."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=90)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items", "starts", "ends")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), shards=16)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


#: Verdict, host and path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document its URL names, the number that ends
    its path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", bad.cast("int").alias("label"))
    named = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^?#]*/(\d{1,18})(?:\.html)?/?(?:[?#]|$)", 1)
    of = pages.select("page_id", named.try_cast("bigint").alias("doc_id"))
    return url_filter.judge(pages, of.join(labels, "doc_id").select("page_id", "label").distinct(), URL_RULES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents")).drop("spans")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(periodic_runs.with_periods(table(spark, sf_dir, "documents")))


def op12_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh id has the next of the ten labels."""
    rows = hard_negatives.whole_vectors(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


LLM = {f.__name__: f for f in (
    op1_quality_rules, op2_jaccard_join, op3_decontaminate, op4_language_id, op5_sharding, op6_license_scan,
    op7_html_text, op8_url_filter, op9_packing, op10_suffix_dedup,
    op11_periodic_runs, op12_graph_search, op13_hard_negatives,
)}
