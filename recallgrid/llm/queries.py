"""One query for each operator, over whole tables with production parameters, and SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm import bpe, jaccard, licenses, mixing, quality, secrets, sharding, topk, toxicity, urls


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.score_urls(pages, pages.select("url", urls.weak_label(pages["url"]).alias("bad")))


def op2_secret_scan(spark, sf_dir):
    return secrets.find_secrets(_read(spark, sf_dir, "documents"), secrets.train(secrets.labelled_findings()))


def op3_bpe(spark, sf_dir):
    return bpe.encode_documents(_read(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.schedule(_read(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    judged = quality.apply_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return judged.withColumn("rejected_by", F.array_join("rejected_by", ","))


def op6_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_join(_read(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_license_scan(spark, sf_dir):
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op9_topk_search(spark, sf_dir):
    return topk.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_sharding(spark, sf_dir):
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_secret_scan, op3_bpe, op4_mixing, op5_quality_rules, op6_jaccard_join, op7_toxicity, op8_license_scan, op9_topk_search, op10_sharding)}
ORACLE_SQL = {"op5_quality_rules": quality.sql(), "op6_jaccard_join": jaccard.sql(), "op8_license_scan": licenses.sql(), "op9_topk_search": topk.sql()}
