"""Logs, packs and layers derived from the driver's tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = 1024
RENEWED = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log; batches of 16, committed or not, some aborted after."""
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    data = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.expr("event_id div 16").alias("batch_id"), op.alias("op"), F.col("user_id").alias("key"), F.col("props").alias("value"), (F.col("user_id") % 3).cast("int").alias("shard")
    )
    batches = data.select("batch_id").distinct()
    none = [F.lit(None).cast("long").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("int").alias("shard")]
    mark = lambda df, name, n: df.select((F.lit(10**12) + F.col("batch_id") * 2 + n).alias("seq"), "batch_id", F.lit(name).alias("op"), *none)
    return data.unionByName(mark(batches.where("batch_id % 5 <> 0"), "batch_commit", 0)).unionByName(mark(batches.where("batch_id % 7 = 0"), "batch_abort", 1))


KV_SQL = """
WITH log AS (
  SELECT event_id AS seq, event_id // 16 AS batch_id, user_id AS key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op,
         props AS value, CAST(user_id % 3 AS INTEGER) AS shard FROM events),
vis AS (SELECT * FROM log WHERE batch_id = 0 OR (batch_id % 5 <> 0 AND batch_id % 7 <> 0)),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM vis) WHERE rn = 1),
live AS (SELECT * FROM last WHERE op = 'put')
"""


def pack_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a file."""
    docs = table(spark, sf_dir, "documents")
    return docs.select((F.col("doc_id") + 1).alias("entry"), F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def pack_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document again: some edited, some moved, some under a new entry (so
    an old one goes and a new one comes)."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    name = F.concat("doc_id", F.lit(".txt"))
    path = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("moved/"), name)).otherwise(F.concat_ws("/", "source", "lang", name))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" [rev2]"))).when(F.col("doc_id") % 5 == 0, F.concat(F.lit("X"), F.substring("text", 2, 1 << 30))).otherwise(F.col("text"))
    entry = F.col("doc_id") + 1 + F.when(F.col("doc_id") % 7 == 0, RENEWED).otherwise(0)
    return docs.select(entry.alias("entry"), path.alias("path"), text.alias("text"))


PACK_SQL = """
WITH v1 AS (SELECT doc_id + 1 AS entry, source || '/' || lang || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS text FROM documents),
v2 AS (
  SELECT doc_id + 1 + CASE WHEN doc_id % 7 = 0 THEN 1000000000 ELSE 0 END AS entry, CASE WHEN doc_id % 13 = 0 THEN 'moved/' || doc_id || '.txt' ELSE source || '/' || lang || '/' || doc_id || '.txt' END AS path,
         CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || ' [rev2]' WHEN doc_id % 5 = 0 THEN 'X' || substr(coalesce(text, ''), 2) ELSE coalesce(text, '') END AS text
  FROM documents),
p1 AS (SELECT entry, CAST(page AS INTEGER) AS page, substr(text, CAST(page AS BIGINT) * 1024 + 1, 1024) AS raw FROM (SELECT entry, text, unnest(range((length(text) + 1023) // 1024)) AS page FROM v1)),
p2 AS (SELECT entry, CAST(page AS INTEGER) AS page, substr(text, CAST(page AS BIGINT) * 1024 + 1, 1024) AS raw FROM (SELECT entry, text, unnest(range((length(text) + 1023) // 1024)) AS page FROM v2)),
b1 AS (SELECT entry, CAST(page AS INTEGER) AS page, encode(text)[CAST(page AS BIGINT) * 4096 + 1:CAST(page AS BIGINT) * 4096 + 4096] AS raw FROM (SELECT entry, text, unnest(range((strlen(text) + 4095) // 4096)) AS page FROM v1)),
b2 AS (SELECT entry, CAST(page AS INTEGER) AS page, encode(text)[CAST(page AS BIGINT) * 4096 + 1:CAST(page AS BIGINT) * 4096 + 4096] AS raw FROM (SELECT entry, text, unnest(range((strlen(text) + 4095) // 4096)) AS page FROM v2))
"""


def text_pages(files: DataFrame) -> DataFrame:
    """(entry, page, raw): 1024-character pages of the texts."""
    from ..sources.pack import explode_pages

    return explode_pages(files.select("entry", "text", F.lit(PAGE).alias("page_size")), "text", length=F.char_length).select("entry", "page", "raw")


def layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, tombstones, paths) of three layers: v1 at 10, a third of v2 and
    some tombstones at 20, more tombstones at 30."""
    low, high = pack_v1(spark, sf_dir).withColumn("priority", F.lit(10)), pack_v2(spark, sf_dir).where("entry % 3 = 0").withColumn("priority", F.lit(20))
    files = low.unionByName(high)
    everything = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("entry"))
    tombs = everything.where("entry % 19 = 0").withColumn("priority", F.lit(20)).unionByName(everything.where("entry % 17 = 0").withColumn("priority", F.lit(30)))
    return files, tombs, files.select("path", "entry", F.lit(0).cast("long").alias("flags"), "priority")


LAYER_SQL = (
    PACK_SQL
    + """
, files AS (SELECT entry, path, text, 10 AS priority FROM v1 UNION ALL SELECT entry, path, text, 20 FROM v2 WHERE entry % 3 = 0),
tombs AS (SELECT doc_id + 1 AS entry, 20 AS priority FROM documents WHERE (doc_id + 1) % 19 = 0 UNION ALL SELECT doc_id + 1, 30 FROM documents WHERE (doc_id + 1) % 17 = 0),
marks AS (SELECT entry, priority, 0 AS dead, text FROM files UNION ALL SELECT entry, priority, 1, NULL FROM tombs),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY priority DESC, dead DESC) AS rn FROM marks) WHERE rn = 1 AND dead = 0),
named AS (SELECT * FROM (SELECT path, entry, priority, row_number() OVER (PARTITION BY path ORDER BY priority DESC) AS rn FROM files) WHERE rn = 1)
"""
)


def pack_inputs(files: DataFrame, page_size: int, codec: str = "none", strategy: str = "auto") -> DataFrame:
    """Pack build inputs from (entry, path, text)."""
    return files.select(
        F.col("entry").alias("ordinal"), "path", "entry", F.encode("text", "UTF-8").alias("data"), F.lit(page_size).alias("page_size"), F.lit(codec).alias("codec"), F.lit(0).alias("level"), F.lit(strategy).alias("strategy")
    )
