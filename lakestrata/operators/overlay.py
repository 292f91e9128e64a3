"""Resolution over layers: which file, page and bytes are visible.

Layer tables carry `priority` (higher wins, unique per mount). A tombstone hides
an entry in its own layer and below. Path and entry are resolved apart: a path
names an entry by the highest layer that has the path, and the entry's content
comes from the highest layer that has the entry.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK = "priority"


def resolve_paths(paths: DataFrame, key: str = "path") -> DataFrame:
    """(path, entry, flags, priority) of the highest layer that has the path."""
    rest = [c for c in paths.columns if c != key]
    return paths.groupBy(key).agg(F.max_by(F.struct(*rest), RANK).alias("_top")).select(key, "_top.*")


def resolve_entries(files: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The visible row of every entry. Files and tombstones are judged by their
    keys alone; contents join afterwards only for the winners, so no payload is
    shuffled for a file that is hidden."""
    rank = F.col(RANK).cast("long") * 2  # a tombstone is just above the files of its layer
    marks = files.select("entry", rank.alias("_rank")).unionByName(tombstones.select("entry", (rank + 1).alias("_rank")))
    top = marks.groupBy("entry").agg(F.max("_rank").alias("_rank")).where("_rank % 2 = 0")
    return files.join(top.select("entry", F.expr("_rank div 2").cast(files.schema[RANK].dataType).alias(RANK)), ["entry", RANK])


def open_paths(paths: DataFrame, files: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Visible files by path: content priority may differ from path priority."""
    named = resolve_paths(paths).select("path", "entry", F.col(RANK).alias("path_priority"))
    return named.join(resolve_entries(files, tombstones), "entry")


def stat(files: DataFrame) -> DataFrame:
    """entry, size and page size of the first block (0 without blocks)."""
    return files.select("entry", "size", F.coalesce(F.get("blocks", F.lit(0)).getField("page_size"), F.lit(0)).alias("page_size"))


def resolve_pages(top: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Pages by key: the top layer's, else the base's; a placeholder on top ends
    the search, so its page is missing. Returns rows of the winning layer with
    `layer` 'top' or 'base'."""
    rest = [c for c in top.columns if c not in keys]
    t = top.select(*keys, F.struct(*rest).alias("_t"))
    b = base.select(*keys, F.struct(*rest).alias("_b"))
    both = t.join(b, keys, "full")
    found = both.select(*keys, F.coalesce("_t", "_b").alias("_p"), F.when(F.col("_t").isNotNull(), "top").otherwise("base").alias("layer"))
    return found.where("_p.kind <> 'placeholder'").select(*keys, "_p.*", "layer")


def expected_pages(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row for each page that a file's blocks promise: block, page, where it
    starts in the file, its size, codec and, for explicit blocks, its reference."""
    keep = keep or ["entry"]
    blocks = files.select(*keep, "page_refs", F.posexplode("blocks").alias("block", "b"))
    pages = blocks.where("b.page_count > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("b.page_count") - 1)).alias("page"))
    start = F.col("b.raw_offset") + F.col("page").cast("long") * F.col("b.page_size")
    size = F.least(F.col("b.page_size").cast("long"), F.col("b.raw_size") - F.col("page").cast("long") * F.col("b.page_size"))
    explicit = F.col("b.flags").bitwiseAND(F.lit(1)) != 0
    ref = F.when(explicit, F.get("page_refs", (F.col("b.page_ref_offset") + F.col("page")).cast("int")))
    return pages.select(*keep, "block", "page", start.alias("start"), size.alias("size"), explicit.alias("explicit"), ref.alias("ref"))


def overlapping(pages: DataFrame, offset: Column, length: Column) -> DataFrame:
    """Pages that hold bytes of [offset, offset + length)."""
    return pages.where((F.col("start") < offset + length) & (F.col("start") + F.col("size") > offset))


def clip(pages: DataFrame, offset: Column, length: Column, raw: str = "raw") -> DataFrame:
    """The bytes of each page within the range, as `bytes` at `at`."""
    begin = F.greatest(offset - F.col("start"), F.lit(0))
    end = F.least(offset + length - F.col("start"), F.col("size"))
    return pages.withColumn("at", F.col("start") + begin).withColumn("bytes", F.substring(F.col(raw), (begin + 1).cast("int"), (end - begin).cast("int")))


@lru_cache(maxsize=1)
def _join_udf():
    @F.arrow_udf("binary")
    def join(parts: pa.Array) -> pa.Array:
        return pa.array([None if p is None else b"".join(p) for p in parts.to_pylist()], pa.binary())

    return join


def assemble(parts: DataFrame, by: list[str], at: str = "at", data: str = "bytes") -> DataFrame:
    """Parts of a file put together in order of their place (binary)."""
    gathered = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(data).alias("data")))).alias("_parts"))
    return gathered.select(*by, _join_udf()(F.col("_parts.data")).alias("data"))


def match_generation(refs: DataFrame, mounts: DataFrame) -> DataFrame:
    """The mount that serves references (pack_id, generation): the exact version
    first, then a later one, then any; within a class the highest priority."""
    m = mounts.select("pack_id", F.col("pack_version").alias("_v"), "mount", F.col(RANK).alias("_r"))
    rank = F.when(F.col("_v") == F.col("generation"), 0).when(F.col("_v") >= F.col("generation"), 1).otherwise(2)
    asked = refs.select("pack_id", "generation").distinct()
    return asked.join(F.broadcast(m), "pack_id").groupBy("pack_id", "generation").agg(F.min_by("mount", F.struct(rank, -F.col("_r"))).alias("mount"))
