"""One query for each operator over its whole table, and DuckDB's SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.llm import bpe, decontaminate, filter_audit, html_extract, near_duplicates, preference, prefix_free, quality, rlz, sharding, sketches, url_filter, whitening
from voxelspark.llm.common import read

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(read(spark, sf_dir, "documents"), tokenizer_path())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("item_ids", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(read(spark, sf_dir, "documents")).drop("clean_text")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rlz.dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_free.dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"))


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preference.format_pairs(preference.pair_up(read(spark, sf_dir, "conversations")))
    spans = lambda m: F.array_join(F.transform(m, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias(m)
    return out.select("pair_id", "n_prefix", "prompt", "chosen", spans("chosen_mask"), "rejected", spans("rejected_mask"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.labelled(pages, read(spark, sf_dir, "labels")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings")).drop("deviation_digits")


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.near_duplicates(read(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_decontaminate, op3_html_extract, op4_ngram_jaccard, op5_quality, op6_substring_dedup, op7_suffix_array_dedup, op8_sharding, op9_preference, op10_url_filter, op11_whitening, op12_minhash, op13_filter_audit)}
ORACLE_SQL = {
    "op2_decontaminate": decontaminate.SCAN_SQL,
    "op5_quality": quality.MEASURE_SQL,
    "op6_substring_dedup": rlz.DEDUP_SQL,
    "op9_preference": preference.PAIRS_SQL,
    "op13_filter_audit": filter_audit.AUDIT_SQL,
    "op10_url_filter": url_filter.SQL.format(pages="pages", outcomes=f"({url_filter.OUTCOMES_SQL})"),
}
