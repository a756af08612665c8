"""Registered queries of the operators over whole tables, and the SQL they are checked against."""

from textharbor.llm import (
    decontamination, html_extract, manifest, mixing, near_dedup, quality, ranked_search, secrets, sharding,
    substring_dedup, toxicity, url_rules, warc,
)
from textharbor.llm.oracles import ORACLE_SQL  # noqa: F401

URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark, sf_dir):
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contamination_report(docs, benchmark, n=10)


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_near_duplicates(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op4_source_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_warc_normaliser(spark, sf_dir):
    return warc.warc_report(table(spark, sf_dir, "pages"), min_bytes=0)


def op6_quality_cascade(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op8_byte_shards(spark, sf_dir):
    return sharding.shard_report(table(spark, sf_dir, "documents"), shards=40)


def op9_url_filter(spark, sf_dir):
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup.repeat_report(table(spark, sf_dir, "documents"), length=50)


def op11_html_extract(spark, sf_dir):
    return html_extract.extraction_report(table(spark, sf_dir, "pages"))


def op12_ranked_search(spark, sf_dir):
    index = ranked_search.build_index(table(spark, sf_dir, "documents"))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark"), k=50)


def op13_merkle_manifest(spark, sf_dir):
    return manifest.tamper_report(table(spark, sf_dir, "documents"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_decontamination, op2_toxicity, op3_near_duplicates, op4_source_mixing, op5_warc_normaliser,
        op6_quality_cascade, op7_secret_scan, op8_byte_shards, op9_url_filter, op10_substring_dedup, op11_html_extract,
        op12_ranked_search, op13_merkle_manifest,
    )
}
