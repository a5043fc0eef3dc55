"""The text operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common as C


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(C.table(spark, sf_dir, "documents")).drop("text_hash")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    docs = C.table(spark, sf_dir, "documents")
    out = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False)
    return out.drop("ids")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")).drop("text_hash")


def op4_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    out = shard_by_bytes(C.table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import plan_revisits, read_archives, write_archives

    C.tune(spark)
    path = C.Scratch(spark, "warc").path("archives")
    write_archives(plan_revisits(C.table(spark, sf_dir, "pages")), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_items

    return find_items(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("text_hash")


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import line_first

    out = line_first(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(C.table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(C.table(spark, sf_dir, "documents")).drop("kept_text")


#: Host and path rules of the URL query.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(C.table(spark, sf_dir, "pages"), URL_RULES).drop("score")


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import interactions

    return interactions(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op12_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rolling_median import rolling_medians

    return rolling_medians(C.table(spark, sf_dir, "clicks")).select("click_id", "kind", "n", "median2", "mad4", "far")


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources, taken

    mixed = mix_sources(C.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", taken().alias("taken"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
