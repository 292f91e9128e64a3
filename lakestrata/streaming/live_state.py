"""The log fold as a stream.

A log that grows in a directory is folded micro-batch by micro-batch: each batch
is reduced to its last operation per key and written as one more delta, named
by the batch's number, so a batch that runs again after a crash replaces its own
delta. Readers fold all deltas; `compact` joins them into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.kv_log import fold, live
from ..sources import fs


def start(spark: SparkSession, source: str, schema: StructType | str, target: str, trigger: dict | None = None, **options: str) -> StreamingQuery:
    """Follows Parquet log rows (seq, key, op, ...) under `source`."""
    rows = spark.readStream.schema(schema).options(**options).parquet(source)

    def add(batch: DataFrame, number: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{target}/deltas/{number:020d}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{target}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def state(spark: SparkSession, target: str) -> DataFrame:
    """Last operations over all deltas."""
    names = [n for n in fs.listing(spark, f"{target}/deltas") if not n.startswith("_")]
    return fold(spark.read.parquet(*[f"{target}/deltas/{n}" for n in names]))


def live_rows(spark: SparkSession, target: str) -> DataFrame:
    return live(state(spark, target))


def compact(spark: SparkSession, target: str) -> None:
    """One delta instead of many, named like the last of them. Run it between
    triggers; a crash in the middle leaves deltas that fold to the same state."""
    names = [n for n in fs.listing(spark, f"{target}/deltas") if n.isdigit()]
    if len(names) < 2:
        return
    state(spark, target).write.mode("overwrite").parquet(f"{target}/compacting")
    spark.read.parquet(f"{target}/compacting").write.mode("overwrite").parquet(f"{target}/deltas/{names[-1]}")
    for n in names[:-1]:
        fs.delete(spark, f"{target}/deltas/{n}")
    fs.delete(spark, f"{target}/compacting")
