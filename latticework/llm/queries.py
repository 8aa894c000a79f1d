"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from latticework.llm import (
    decontaminate, html_paths, line_align, ngram_join, oracles, packing, periodic_runs, quality_mil, rule_forest,
    spelling_variants, suffix_dedup, toxicity, url_templates, warc,
)
from latticework.llm.tables import read_table, shared_path
from latticework.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op2_ngram_join": oracles.jaccard_sql(), "op8_warc": oracles.warc_sql(), "op10_url_templates": oracles.url_sql(),
    "op11_spelling_variants": oracles.variants_sql(), "op12_suffix_dedup": oracles.repeats_sql(),
    "op13_periodic_runs": oracles.runs_sql(),
}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, folder: fn(configure(spark), folder)
    return fn


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    side = toxicity.remainder(F.col("doc_id"), 4)
    model = toxicity.fit(docs, labels, train=side != 2)
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(side == 2, F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"),
        F.col("toxic").cast("int").alias("predicted"), F.col("toxic_clauses").alias("n_clauses"),
    )


@query
def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_classes(read_table(spark, folder, "documents"))


@query
def op3_quality_mil(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    side = toxicity.remainder(F.col("doc_id"), 5)
    model = quality_mil.fit(docs, labels, where=side != 0)
    return quality_mil.score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(side == 0, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"),
        F.col("good").cast("int").alias("predicted"), "n_passages", "top_attention",
    )


@query
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query
def op5_html_paths(spark: SparkSession, folder: str) -> DataFrame:
    return html_paths.extracted(read_table(spark, folder, "pages").select("page_id", "url", "html"))


@query
def op6_rule_forest(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    forest = rule_forest.fit(docs, labels)
    return rule_forest.judged(docs.select("doc_id", "text"), forest).drop("text")


@query
def op7_line_align(spark: SparkSession, folder: str) -> DataFrame:
    return line_align.deduplicated(read_table(spark, folder, "documents").select("doc_id", "text"))


@query
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    path = shared_path(spark, "warc")
    warc.write(read_table(spark, folder, "pages").select("page_id", "url", "html"), path, compression="gzip")
    return warc.read(spark, path).filter("gap is null").select(
        warc.page_of(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest",
        "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


@query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(read_table(spark, folder, "documents"), tokenizer_path())


@query
def op10_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Labels come from the document that a url names: bad if of low quality or toxic."""
    pages, labels = read_table(spark, folder, "pages"), read_table(spark, folder, "labels")
    known = labels.groupBy(F.col("doc_id").alias("document")).agg(
        F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")
    )
    urls = pages.select("page_id", "url", url_templates.document_of(url_templates.path_of(F.col("url"))).alias("document"))
    urls = urls.join(known, "document", "left").drop("document")
    return url_templates.judged(urls).select("page_id", "host", "path", "rule", "verdict", "template", F.round("bad_share", 6).alias("bad_share"))


@query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.spelling_variants(read_table(spark, folder, "documents"))


@query
def op12_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.without_repeats(read_table(spark, folder, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["length"])
    return cut.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = periodic_runs.planted(read_table(spark, folder, "documents"))
    return periodic_runs.digests(periodic_runs.with_runs(docs))
