"""A training-corpus pipeline over `documents`, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. The first four return the columns of documents, with rejected documents
gone and secrets masked; the last returns token ids. No stage that drops rows
looks at anything but its own input and the benchmark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakestrata.llm import bpe, decontaminate, near_dup, quality, secret_scan
from lakestrata.llm.queries import tokenizer
from lakestrata.llm.shared import scratch, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go."""
    return quality.keep_good(docs, policy=quality.V2)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, 0.8);
    rows are judged one by one, whatever their ids."""
    return near_dup.keep_one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which any benchmark window occurs go, however long they are."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, all documents stay."""
    return secret_scan.redact(docs, *tokenizer("byte_bpe_50k.tiktoken"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of what they decode to.
    A small memo, given back by every task: workers go on to other stages."""
    return bpe.digests(docs, *tokenizer("byte_bpe_50k.json"), with_ids=True, memo=60_000, piece=1 << 20, keep=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("BPE encoding and decoding", tokens),
]

#: Tokenization has no SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage wrote aside, and the table it
    read, is deleted once its result is written.

    Null texts and texts without words go with the quality rules, repeated rows
    and copies without an id with near-dedup (one stays); extra columns are
    carried through the first four stages; an empty table gives an empty result
    with the same columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        for name, stage in STAGES[:-1]:
            with scratch(spark):
                docs = written(stage(spark, docs, sf_dir), name.split()[0], keep=True)
        docs = written(STAGES[-1][1](spark, docs, sf_dir), "pipeline", keep=True)
    return docs
