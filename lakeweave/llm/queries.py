"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import _common as c
from lakeweave.llm import bpe, classifier, html_main, license_scan, mpeg_audio, packing, quality_rules, simhash, url_filter, warc


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = c.materialize(quality_rules.with_counts(docs, drop_text=True), "op3-counts")
    judged = quality_rules.judge(counted)
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "host_blocked")


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files are; operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    return bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), keep_ids=False)


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mpeg_audio.store_and_read(c.table(spark, sf_dir, "documents"))
    return found.withColumn("seek_offsets", F.array_join(F.col("seek_offsets").cast("array<string>"), ","))  # as text, which any comparison can order


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(c.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


#: The rules that the url query is asked to apply.
URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(c.table(spark, sf_dir, "pages"), URL_RULES)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = classifier.train(docs, c.table(spark, sf_dir, "labels"))
    scored = classifier.with_score(docs, weights, drop_text=True)
    return scored.select("doc_id", F.coalesce(classifier.remainder() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(c.table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan(docs, license_scan.train(license_scan.background(docs)))
    sure = F.filter("findings", lambda f: f["confirmed"])
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(sure).cast("long").alias("n_licensed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda f: f["family"]))), ",").alias("families"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = c.table(spark, sf_dir, "pages")
    captures = warc.archive(pages, warc.new_folder(spark))
    return warc.read_pages(captures, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    prints = c.materialize(simhash.fingerprints(docs), "op10-prints")
    found = simhash.near_duplicates(prints)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict:
    return {
        "op1_mpeg_audio": op1_mpeg_audio,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_quality_rules": op3_quality_rules,
        "op4_bpe": op4_bpe,
        "op5_url_filter": op5_url_filter,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_html_extraction": op7_html_extraction,
        "op8_license_scan": op8_license_scan,
        "op9_warc": op9_warc,
        "op10_simhash": op10_simhash,
    }
