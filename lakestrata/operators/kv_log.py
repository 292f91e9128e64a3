"""The key/value log as a table, and what follows from it.

Log rows: seq (order, unique), batch_id (0: no batch), op, key, value, shard.
Operations are put and delete; batch_begin, batch_commit and batch_abort mark
batches. Everything visible is derived from the log; nothing is updated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.running import before, running_max, running_sums

DATA_OPS = ("put", "delete")
BYTES_STEP = 1 << 28  # a step of an order by byte offsets


def committed(log: DataFrame) -> DataFrame:
    """Data rows that count: outside batches, or of a batch with a commit and no
    later abort. One scan; only the marks are joined."""
    mark = lambda op: F.max(F.when(F.col("op") == op, F.col("seq")))
    marks = log.where(F.col("op").isin("batch_commit", "batch_abort")).groupBy("batch_id").agg(mark("batch_commit").alias("_commit"), mark("batch_abort").alias("_abort"))
    good = marks.where("_commit is not null and (_abort is null or _abort < _commit)").select("batch_id", F.lit(True).alias("_good"))
    data = log.where(F.col("op").isin(*DATA_OPS))
    return data.join(good, "batch_id", "left").where("batch_id = 0 or _good").select(*log.columns)


def torn_prefix(journal: DataFrame, good: Column) -> DataFrame:
    """Rows before the first bad one: a journal is read up to its torn tail."""
    bad = journal.agg(F.min(F.when(~good, F.col("seq")))).first()[0]
    return journal if bad is None else journal.where(F.col("seq") < bad)


def fold(rows: DataFrame) -> DataFrame:
    """The last operation of every key, deletes included. Partial aggregation
    runs before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in rows.columns if c != "key"]
    return rows.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("_last")).select("key", "_last.*")


def live(rows: DataFrame) -> DataFrame:
    return fold(rows).where("op = 'put'")


def key_state(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """live, deleted (known, last operation a delete) or unknown, for each key."""
    last = fold(rows).select("key", F.col("op").alias("_op"))
    state = F.when(F.col("_op").isNull(), "unknown").when(F.col("_op") == "delete", "deleted").otherwise("live")
    return keys.join(last, "key", "left").select(*keys.columns, state.alias("state"))


def versions(rows: DataFrame) -> DataFrame:
    """Puts with their version: 1 for a first put and after a delete, else one
    more than before, in log order. Counted by steps of the log, so that a hot
    key is no single task's work."""
    counted = running_sums(rows, ["key"], "seq", {"_era": (F.col("op") == "delete").cast("int"), "_puts": (F.col("op") == "put").cast("int")}).where("op = 'put'")
    first = counted.groupBy("key", "_era").agg(F.min("_puts").alias("_first"))
    return counted.join(first, ["key", "_era"]).select(*rows.columns, (F.col("_puts") - F.col("_first") + 1).alias("version"))


def as_of(rows: DataFrame, seq: int) -> DataFrame:
    """What was live after a point of the log: a stable snapshot."""
    return live(rows.where(F.col("seq") <= seq))


def get(rows: DataFrame, key) -> DataFrame:
    """The live row of one key, or no row. The filter reaches the scan."""
    return live(rows.where(F.col("key") == key))


def get_many(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Live values for a list of keys, null where there is none."""
    asked = keys.select("key").distinct()
    return keys.join(live(rows.join(asked, "key", "left_semi")), "key", "left")


def route(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def shard_stats(rows: DataFrame, size: Column) -> DataFrame:
    """For each shard: log entries, put bytes, live keys and live bytes."""
    log = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.when(F.col("op") == "put", size)), F.lit(0)).alias("data_bytes"))
    now = live(rows).groupBy("shard").agg(F.count(F.lit(1)).alias("live_keys"), F.sum(size).alias("live_bytes"))
    return log.join(now, "shard", "left").na.fill(0, ["live_keys", "live_bytes"])


def layout(puts: DataFrame, size: Column) -> DataFrame:
    """Puts laid out one after the other in each shard: size and offset."""
    return running_sums(puts.withColumn("size", size.cast("long")), ["shard"], "seq", {"offset": F.col("size")})


def holes(placed: DataFrame, live_seqs: DataFrame) -> DataFrame:
    """Maximal garbage intervals of each shard: rows of the layout that are not
    live, touching ones merged (offset, size, n_records)."""
    marked = placed.join(live_seqs.select("seq", F.lit(1).alias("_live")), "seq", "left")
    island = running_sums(marked, ["shard"], "seq", {"_island": F.coalesce("_live", F.lit(0))})
    garbage = island.where("_live is null")
    return garbage.groupBy("shard", "_island").agg(F.min("offset").alias("offset"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_records")).drop("_island")


def free_tails(holes_: DataFrame, placed: DataFrame) -> DataFrame:
    """The hole that ends at a shard's tail, if there is one: what can be cut."""
    tails = placed.groupBy("shard").agg(F.max(F.col("offset") + F.col("size")).alias("tail"))
    return holes_.join(tails, "shard").where("offset + size = tail").select("shard", "offset", "size", "tail")


def merge_intervals(blocks: DataFrame) -> DataFrame:
    """Touching or overlapping blocks (shard, offset, size) merged."""
    blocks = blocks.groupBy("shard", "offset").agg(F.max("size").alias("size"))
    seen = running_max(blocks, ["shard"], "offset", F.col("offset") + F.col("size"), "_reach", BYTES_STEP)
    opens = F.when(F.col("_reach").isNull() | (F.col("offset") > F.col("_reach")), 1).otherwise(0)
    named = running_sums(seen.withColumn("_new", opens), ["shard"], "offset", {"_before": F.col("_new")}, BYTES_STEP)
    end = F.max(F.col("offset") + F.col("size"))
    merged = named.groupBy("shard", (F.col("_before") + F.col("_new")).alias("_island")).agg(F.min("offset").alias("offset"), (end - F.min("offset")).alias("size"))
    return merged.drop("_island")


# ------------------------------------------------------------- verification

ISSUE_KINDS = ("corruption", "checksum_mismatch", "dangling_index", "orphan_record", "duplicate_key", "invalid_superblock", "invalid_region", "invalid_record")


def verify(records: DataFrame, index: DataFrame, known: DataFrame, free: DataFrame, size_limit: int = 1 << 32) -> DataFrame:
    """Issues (kind, shard, offset, key) of a store.

    records: (shard, offset, size, key, crc, stored_crc); index: live entries
    (shard, offset, key); known: keys any index layer has heard of; free: holes
    (shard, offset, size). Superseded and deleted records are known, so they are
    no orphans.
    """
    issue = lambda df, kind: df.select(F.lit(kind).alias("kind"), "shard", "offset", "key")
    intact = records.where("crc = stored_crc")
    found = [
        issue(records.where("crc <> stored_crc"), "checksum_mismatch"),
        issue(records.where(f"size < 0 or size >= {size_limit} or key is null"), "invalid_record"),
        issue(index.join(intact, ["shard", "offset", "key"], "left_anti"), "dangling_index"),
        issue(index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("shard").alias("shard"), F.min("offset").alias("offset")).where("n > 1"), "duplicate_key"),
    ]
    used = intact.join(index, ["shard", "offset", "key"], "left_anti").join(known.select("key").distinct(), "key", "left_anti")
    # Holes and records meet in the order of their offsets: a record lies in a
    # hole if one that begins at or before it reaches beyond it.
    places = free.select("shard", (F.col("offset") * 2).alias("_at"), (F.col("offset") + F.col("size")).alias("_end"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast(used.schema["key"].dataType).alias("key"))
    places = places.unionByName(used.select("shard", (F.col("offset") * 2 + 1).alias("_at"), F.lit(None).cast("long").alias("_end"), F.col("offset").cast("long").alias("offset"), "key"))
    met = running_max(places, ["shard"], "_at", F.col("_end"), "_reach", 2 * BYTES_STEP)
    found.append(issue(met.where("offset is not null and (_reach is null or offset >= _reach)"), "orphan_record"))
    overlap = running_max(free, ["shard"], "offset", F.col("offset") + F.col("size"), "_end", BYTES_STEP)
    found.append(issue(overlap.where("offset < _end or size <= 0").withColumn("key", F.lit(None).cast(records.schema["key"].dataType)), "invalid_region"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def verify_order(index: DataFrame) -> DataFrame:
    """Rows of a sorted index (bucket, position, key) that break its order: a
    key not above the one before it in its bucket."""
    return before(index, ["bucket"], "position", "key", "_before").where("_before is not null and key <= _before").drop("_before")
