"""The thin opN_ queries: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact, hamerly, html_crf, mixing, packing, paragraphs, repair, simhash, toxicity, urlrules, vqcodes, warc


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages")).where("record_type is not null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(_read(spark, sf_dir, "documents"), least=paragraphs.LEAST, every=False)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return urlrules.judge(pages, mined=urlrules.mine(urlrules.rule_labels(pages).where("not held_out")))


def op7_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(_read(spark, sf_dir, "pages")).drop("n_blocks")


def op8_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vqcodes.compress(_read(spark, sf_dir, "embeddings"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op13_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly.cluster(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}
