"""The operators as queries over the tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination
from .html_text import extract_pages
from .license_scan import license_scan
from .merkle import edited_fingerprints
from .oracles import oracle_sql
from .packing import pack_documents
from .prefix_trie import branched_trie
from .quality import quality_rules
from .resample import resample
from .secret_scan import secret_scan
from .simhash import simhash_groups
from .substring import remove_repeats
from .token_count import count_tokens, repeated_line_edits
from .token_files import read_token_files, write_token_files

__all__ = ["oracle_sql", "queries"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = license_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    place = F.transform(F.col("license.base"), lambda b: b["place"])
    return x.select(
        "doc_id", F.col("license.n_words").alias("n_words"), F.size(place).cast("long").alias("n_base"), F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
        F.array_join("license.base_labels", ",").alias("base_labels"), F.array_join("license.labels", ",").alias("labels"), F.col("license.score").alias("score"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return x.select(
        "doc_id", F.col("leak.n_words").alias("n_words"), F.col("leak.n_hit").alias("n_hit"), F.size("leak.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.item_ids", ","), 256).alias("items_sha256"), F.col("leak.contaminated").alias("contaminated"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edits remove lines that equal an earlier line of the text."""
    return count_tokens(_table(spark, sf_dir, "documents"), edits=repeated_line_edits)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = simhash_groups(_table(spark, sf_dir, "documents"))
    return x.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(_table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", removed.alias("n_removed"), "kept_sha256")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = secret_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col("secrets.spans")
    count = lambda k: F.size(F.filter(found, lambda s: s["kind"] == k)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter(found, lambda s: s["kind_order"] < 3)
    return x.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(found).alias("spans"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return x.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")])


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branched_trie(_table(spark, sf_dir, "conversations"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = edited_fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    p = F.col("prints")
    return x.select("doc_id", p["n_chars"].alias("n_chars"), F.sha2(p["edited"], 256).alias("edited_sha256"), *[p[c].alias(c) for c in ("fingerprint", "edited_fingerprint", "near_edited", "near_next")])


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_decontamination, op3_token_counts, op4_simhash, op5_token_files, op6_packing, op7_substring_dedup, op8_html_extraction, op9_secret_scan, op10_quality_rules, op11_prefix_trie, op12_fingerprints, op13_resample)}
