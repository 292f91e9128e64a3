"""The queries op1 to op10 over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLE_SQL
from .shared import written


def tokenizer(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_store

    path = token_store.write_store(_documents(spark, sf_dir), *tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_store.read_store(spark, path)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    found = decontaminate.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", items, decontaminate.is_contaminated().alias("contaminated"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan

    return secret_scan.scan_secrets(_documents(spark, sf_dir), *tokenizer("byte_bpe_50k.tiktoken"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_extract

    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan

    return license_scan.scan_licenses(_documents(spark, sf_dir)).drop("detections")


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import shard

    return shard.shard_digest(_documents(spark, sf_dir), shards=24)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.digests(_documents(spark, sf_dir), *tokenizer("byte_bpe_50k.json"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dup

    return near_dup.near_duplicates(_documents(spark, sf_dir), size=2, percent=80)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    ledger = quality.apply_policy(quality.rule_ledger(_documents(spark, sf_dir)), quality.V2)
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.fails(quality.BASE).alias("base_failed"), "kept", "fail_mask")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring

    return substring.find_repeats(_documents(spark, sf_dir), length=35).drop("repeats")


# Parts of the above that SQL can tell, each against its twin.


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.ablations(quality.rule_ledger(_documents(spark, sf_dir)), quality.V2)


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def shard_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and checksums, and of each document's shard that its slots are
    gapless from 0 and its bytes within the law."""
    from . import shard

    out = written(op6_shard(spark, sf_dir), "shards")
    of_all = out.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.coalesce(F.max("size"), F.lit(0)).alias("largest")).first()
    share = of_all.total / shard.SHARDS
    slots = (F.min("slot") == 0) & (F.max("slot") == F.count(F.lit(1)) - 1) & (F.countDistinct("slot") == F.count(F.lit(1)))
    even = F.abs(F.sum("size") - share) <= of_all.largest + 2 * shard.TOLERANCE * share + 1
    told = out.groupBy("shard").agg(slots.alias("gapless"), even.alias("even"))
    return out.join(told, "shard").select("doc_id", "size", "text_crc32", "gapless", "even")


__all__ = ["ORACLE_SQL", "QUERIES", "tokenizer"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_decontaminate": op2_decontaminate,
    "op3_secret_scan": op3_secret_scan,
    "op4_html_extract": op4_html_extract,
    "op5_license_scan": op5_license_scan,
    "op6_shard": op6_shard,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_quality_rules": op9_quality_rules,
    "op10_substring_dedup": op10_substring_dedup,
    "quality_ablations": quality_ablations,
    "license_base": license_base,
    "secret_base": secret_base,
    "shard_facts": shard_facts,
}


