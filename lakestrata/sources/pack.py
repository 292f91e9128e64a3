"""Packs: files cut into pages, as five tables.

files       entry, version, size, content_hash, flags, blocks[], page_refs[]
pages       entry, block, page, kind, codec, raw_size, stored_size, raw_crc,
            stored_crc, content_hash, payload, shard
paths       path, entry, flags
tombstones  entry, version, reason
manifest    one JSON object

A pack on disk is a directory of immutable versions and a pointer (CURRENT, in
two slots with a CRC: a damaged one leaves the version before); a
build writes a new version and then swaps the pointer, so readers see all of a
version or none of it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..errors import Corruption, InvalidArgument, KeyCollision, UnsupportedCodec
from ..functions import codecs
from ..functions.checksums import crc32c_many
from ..functions.paths import checked_path
from . import fs

BLOCK = "raw_offset:long,raw_size:long,page_size:int,page_count:int,codec:string,codec_level:int,block_hash:string,flags:long,page_ref_offset:long"
REF = "pack_id:long,generation:long,entry:long,block:int,page:int,raw_crc:long,content_hash:string"
FILES = f"entry long, version long, size long, content_hash string, flags long, strategy string, blocks array<struct<{BLOCK}>>, page_refs array<struct<{REF}>>"
PAGES = "entry long, block int, page int, kind string, codec string, raw_size long, stored_size long, raw_crc long, stored_crc long, content_hash string, payload binary, shard int"
PATHS = "path string, entry long, flags long"
TOMBSTONES = "entry long, version long, reason string"
TABLES = {"files": FILES, "pages": PAGES, "paths": PATHS, "tombstones": TOMBSTONES}

EXPLICIT_REFS = 1  # flag of a block whose pages are named by page_refs
OVERLAY = 1  # flag of a pack that lies over a base


@dataclass(frozen=True)
class Pack:
    manifest: dict
    files: DataFrame
    pages: DataFrame
    paths: DataFrame
    tombstones: DataFrame

    @property
    def id(self) -> int:
        return self.manifest["pack_id"]

    @property
    def version(self) -> int:
        return self.manifest["pack_version"]

    @property
    def is_overlay(self) -> bool:
        return bool(self.manifest.get("flags", 0) & OVERLAY)

    def with_(self, **tables) -> Pack:
        return replace(self, **tables)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def empty_pack(spark: SparkSession, pack_id: int, version: int, **more) -> Pack:
    manifest = {"pack_id": pack_id, "pack_version": version, "build_id": 0, "flags": 0, "explicit_refs": False, "file_count": 0, "tombstone_count": 0, "content_hash": "", "shards": 1} | more
    return Pack(manifest, *(empty_table(spark, t) for t in TABLES))


def shard_of(entry: Column, shards: int) -> Column:
    """All objects of a file share a shard; entry 0 and single shards are 0."""
    return F.when((F.lit(shards) <= 1) | (entry == 0), F.lit(0)).otherwise(F.pmod(F.xxhash64(entry), F.lit(shards)).cast("int"))


def page_count(size: Column, page_size: Column) -> Column:
    return F.ceil(size / page_size).cast("int")


def explode_pages(files: DataFrame, data: str = "data", page_size: str = "page_size", length=F.octet_length) -> DataFrame:
    """One row for each page of a file's bytes (with length=char_length: of a
    text's characters): block 0, page, raw. Empty files have no page."""
    n = page_count(length(data), F.col(page_size))
    each = files.where(length(data) > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("page"))
    raw = F.substring(F.col(data), F.col("page") * F.col(page_size) + 1, F.col(page_size))
    return each.withColumn("raw", raw).withColumn("block", F.lit(0)).drop(data)


def encode_pages(raw_pages: DataFrame, shards: int = 1) -> DataFrame:
    """Pages from (entry, block, page, codec, raw): payload, sizes and checksums,
    a batch of pages at a time."""
    ddl = "entry long, block int, page int, kind string, codec string, raw_size long, stored_size long, raw_crc long, stored_crc long, payload binary, _hash binary"
    out = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = part.column("raw").to_pylist()
                made = [codecs.encode(c, r) for c, r in zip(part.column("codec").to_pylist(), raw, strict=True)]
                payload = [p for _, p in made]
                columns = [
                    part.column("entry"), part.column("block"), part.column("page"), ["page"] * len(raw), [c for c, _ in made], [len(r) for r in raw], [len(p) for p in payload],
                    crc32c_many(raw), crc32c_many(payload), payload, [hashlib.sha256(r).digest() for r in raw],
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    rows = raw_pages.select(F.col("entry").cast("long"), F.col("block").cast("int"), F.col("page").cast("int"), "codec", "raw").mapInArrow(run, ddl)
    rows = rows.withColumn("content_hash", F.lower(F.hex("_hash"))).withColumn("shard", shard_of(F.col("entry"), shards).cast("int"))
    return rows.select(*[c.split()[0] for c in PAGES.split(", ")])


def decode_pages(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds raw to page rows; placeholders have none. Damage fails the query."""
    keep = keep or [c for c in pages.columns if c != "payload"]
    ddl = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", raw binary"
    out = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = {c: batch.column(c).to_pylist() for c in ("kind", "codec", "payload", "raw_size")}
            raw = [codecs.decode(c, p, n) if k == "page" else None for k, c, p, n in zip(*part.values(), strict=True)]
            stated, computed = batch.column("raw_crc").to_pylist(), crc32c_many(raw)
            if bad := [i for i, r in enumerate(raw) if r is not None and stated[i] != int(computed[i])]:
                raise Corruption(f"page checksum in row {bad[0]}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(out.field(c).type) for c in keep), pa.array(raw, pa.binary())], schema=out)

    return pages.mapInArrow(run, ddl)


def conflicts(files: DataFrame, key: str) -> DataFrame:
    """(key, n): entries, or normalised paths, that several files claim."""
    named = files.select((checked_path(F.col("path")) if key == "path" else F.col(key)).alias(key))
    return named.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_inputs(files: DataFrame) -> None:
    """Duplicate entries or paths are KeyCollision; entry 0 and page size 0 are
    InvalidArgument; codecs without an encoder UnsupportedCodec. One pass."""
    usable = [c for c, caps in codecs.CODECS.items() if caps.compress]
    seen = files.select("entry", checked_path(F.col("path")).alias("path"), "page_size", "codec")
    bad = seen.agg(
        F.max(F.when((F.col("entry") == 0) | (F.col("page_size") <= 0), 1)).alias("argument"),
        F.max(F.when(~F.col("codec").isin(usable), 1)).alias("codec"),
    ).first()
    if bad.argument:
        raise InvalidArgument("entry 0 or page size 0")
    if bad.codec:
        raise UnsupportedCodec("codec")
    for key in ("entry", "path"):
        twice = conflicts(seen, key).limit(1).collect()
        if twice:
            raise KeyCollision(f"{key} {twice[0][0]}")


def directory_facts(paths: DataFrame, file_count: int) -> dict:
    """Counts of the directory manifest: all directories above the paths."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    named = paths.where(F.contains("path", F.lit("/"))).select(F.explode(above).alias("directory"))
    return {"directory_count": named.distinct().count(), "file_count": file_count, "flags": 0}


HASH_STEP = 1 << 16


def pack_content_hash(files: DataFrame) -> str:
    """SHA-256 over the files in input order, of entry (64-bit little-endian),
    path, a zero byte and the file's hash. Runs of files are hashed where they
    are; with more than one run the result is the hash of the runs' hashes.
    files: (ordinal, entry, path, content_hash)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h = hashlib.sha256()
        for r in sorted(table.to_pylist(), key=lambda r: r["ordinal"]):
            h.update(r["entry"].to_bytes(8, "little", signed=False) + r["path"].encode() + b"\0" + bytes.fromhex(r["content_hash"]))
        return pa.table({"step": pa.array([key[0].as_py()], pa.int64()), "digest": pa.array([h.digest()], pa.binary())})

    steps = files.select((F.col("ordinal") / HASH_STEP).cast("long").alias("step"), "ordinal", "entry", "path", "content_hash").groupBy("step").applyInArrow(run, "step long, digest binary")
    digests = [bytes(r.digest) for r in steps.orderBy("step").collect()]
    return digests[0].hex() if len(digests) == 1 else hashlib.sha256(b"".join(digests)).hexdigest()


def build_pack(files: DataFrame, pack_id: int, version: int, shards: int = 1, name: str = "pack", build_id: int = 0, tombstones: DataFrame | None = None, **manifest) -> Pack:
    """A pack from files(ordinal, path, entry, data, page_size, codec, level[,
    strategy]). Lazy but for the checks and the content hash."""
    spark = files.sparkSession
    check_inputs(files)
    files = files.withColumn("path", checked_path(F.col("path"))).withColumn("content_hash", F.sha2("data", 256))
    size = F.octet_length("data").cast("long")
    block = F.struct(
        F.lit(0).cast("long").alias("raw_offset"), size.alias("raw_size"), F.col("page_size").cast("int").alias("page_size"), page_count(size, F.col("page_size")).alias("page_count"), F.col("codec").alias("codec"),
        F.col("level").cast("int").alias("codec_level"), F.col("content_hash").alias("block_hash"), F.lit(0).cast("long").alias("flags"), F.lit(0).cast("long").alias("page_ref_offset"),
    )
    strategy = F.col("strategy") if "strategy" in files.columns else F.lit("auto")
    file_rows = files.select(
        F.col("entry").cast("long").alias("entry"), F.lit(1).cast("long").alias("version"), size.alias("size"), "content_hash", F.lit(0).cast("long").alias("flags"), strategy.alias("strategy"),
        F.when(size > 0, F.array(block)).otherwise(F.array().cast(f"array<struct<{BLOCK}>>")).alias("blocks"), F.array().cast(f"array<struct<{REF}>>").alias("page_refs"),
    )
    pages = encode_pages(explode_pages(files.select("entry", "data", "page_size", "codec")), shards)
    paths = files.select("path", F.col("entry").cast("long").alias("entry"), F.lit(0).cast("long").alias("flags"))
    tombstones = tombstones if tombstones is not None else empty_table(spark, "tombstones")
    n_files = files.count()
    facts = {
        "directory": directory_facts(paths, n_files), "pack_id": pack_id, "pack_version": version, "pack_name": name, "build_id": build_id, "flags": 0, "explicit_refs": False, "shards": shards, "file_count": n_files, "tombstone_count": tombstones.count(),
        "content_hash": pack_content_hash(files) if files.limit(1).count() else hashlib.sha256(b"").hexdigest(),
    }
    return Pack(facts | manifest, file_rows, pages, paths, tombstones)


def write_pack(pack: Pack, path: str) -> Pack:
    """Writes a new version of the pack at a path and swaps the pointer."""
    spark, name = pack.files.sparkSession, uuid.uuid4().hex
    for table in TABLES:
        df = getattr(pack, table)
        if table == "pages":
            df = df.repartition("shard", "entry").sortWithinPartitions("entry", "block", "page")
        df.write.parquet(f"{path}/versions/{name}/{table}")
    fs.write_json(spark, f"{path}/versions/{name}/manifest.json", pack.manifest)
    publish(spark, path, name)
    return read_pack(spark, path)


def exists(spark: SparkSession, path: str) -> bool:
    return fs.pointer_exists(spark, f"{path}/CURRENT")


def current(spark: SparkSession, path: str) -> dict:
    """The newest pointer of the pack at a path that is whole and whose version
    is there."""
    return fs.read_pointer(spark, f"{path}/CURRENT", lambda v: fs.exists(spark, f"{path}/versions/{v['version']}/manifest.json"))


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Makes a written version the current one."""
    epoch = current(spark, path)["epoch"] + 1 if exists(spark, path) else 1
    fs.write_pointer(spark, f"{path}/CURRENT", {"version": version, "epoch": epoch})


def read_pack(spark: SparkSession, path: str) -> Pack:
    """The current version of the pack at a path."""
    root = f"{path}/versions/{current(spark, path)['version']}"
    tables = {t: spark.read.schema(ddl).parquet(f"{root}/{t}") for t, ddl in TABLES.items()}
    return Pack(fs.read_json(spark, f"{root}/manifest.json"), **tables)


def prune(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Deletes versions of a pack that no pointer names, but for the newest
    `keep` of the others; returns their names."""
    named = current(spark, path)["version"]
    others = [v for v in fs.listing(spark, f"{path}/versions") if v != named]
    gone = others[: max(0, len(others) - keep + 1)] if keep > 1 else others
    for v in gone:
        fs.delete(spark, f"{path}/versions/{v}")
    return gone


# -------------------------------------------------------- incremental builds

CACHE = "entry long, path string, source_hash string, size long, page_size int, codec string, level int, strategy string, pack_id long, pack_version long, shards int"
_COMPARED = [c.split()[0] for c in CACHE.split(", ") if c.split()[0] != "entry"]


def build_state(files: DataFrame, pack_id: int, version: int, shards: int) -> DataFrame:
    """What decides whether a file has to be built again."""
    strategy = F.col("strategy") if "strategy" in files.columns else F.lit("auto")
    return files.select(
        F.col("entry").cast("long").alias("entry"), "path", F.sha2("data", 256).alias("source_hash"), F.octet_length("data").cast("long").alias("size"), F.col("page_size").cast("int").alias("page_size"), "codec",
        F.col("level").cast("int").alias("level"), strategy.alias("strategy"), F.lit(pack_id).cast("long").alias("pack_id"), F.lit(version).cast("long").alias("pack_version"), F.lit(shards).cast("int").alias("shards"),
    )


def build_changes(before: DataFrame, now: DataFrame, compared: list[str] | None = None) -> DataFrame:
    """(entry, change): new, changed, same or removed, by a full outer join."""
    compared = compared or _COMPARED
    old = before.select("entry", F.struct(*compared).alias("_old"))
    new = now.select("entry", F.struct(*compared).alias("_new"))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "same").otherwise("changed")
    return old.join(new, "entry", "full").select("entry", change.alias("change"))


@dataclass(frozen=True)
class BuildResult:
    pack: Pack
    rebuilt: int
    skipped: int


def build_incremental(files: DataFrame, path: str, pack_id: int, version: int, shards: int = 1) -> BuildResult:
    """Builds the pack at a path unless nothing has changed since the last
    build; any change, also a removed file or a damaged cache, builds all."""
    spark = files.sparkSession
    now = build_state(files, pack_id, version, shards)
    n = now.count()
    try:
        if exists(spark, path):
            before = spark.read.schema(CACHE).parquet(f"{path}/cache/{current(spark, path)['version']}")
            if build_changes(before, now).where("change <> 'same'").limit(1).count() == 0:
                return BuildResult(read_pack(spark, path), 0, n)
    except Exception as e:  # a cache that can't be read only costs a build
        spark._jvm.org.apache.logging.log4j.LogManager.getLogger("lakestrata").warn(f"build cache of {path}: {e}")
    pack = write_pack(build_pack(files, pack_id, version, shards), path)
    now.write.mode("overwrite").parquet(f"{path}/cache/{current(spark, path)['version']}")
    return BuildResult(pack, n, 0)
