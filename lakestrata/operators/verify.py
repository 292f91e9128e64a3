"""Integrity of a pack: what each issue kind means as a join or a filter."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..errors import StoreError
from ..functions.checksums import crc32c_many
from ..functions.codecs import CODECS, decode
from ..functions.paths import normalize_path
from ..sources import fs
from ..sources import pack as pack_source
from ..sources.pack import TABLES, Pack
from .overlay import expected_pages

#: Names of the issue kinds.
ISSUE_KINDS = (
    "db_verify_failed", "object_read_failed", "unknown_object", "pack_manifest_missing", "pack_manifest_invalid", "pack_manifest_key_mismatch", "path_index_missing", "path_index_invalid",
    "path_index_key_mismatch", "path_hash_mismatch", "duplicate_file_entry", "file_manifest_missing", "file_manifest_invalid", "file_manifest_key_mismatch", "file_manifest_shape_invalid",
    "page_missing", "page_invalid", "page_key_mismatch", "page_ref_pack_missing", "page_ref_missing", "page_ref_identity_mismatch", "page_ref_hash_mismatch", "orphan_page", "tombstone_invalid",
    "tombstone_key_mismatch", "manifest_file_count_mismatch", "manifest_tombstone_count_mismatch", "volume_manifest_invalid", "patch_in_progress", "page_placeholder_invalid", "placeholder_in_non_overlay",
)

_KEY = ["entry", "block", "page"]
ISSUES = "kind string, entry long, block int, page int, path string"


def _issue(df: DataFrame, kind: str | Column) -> DataFrame:
    have = set(df.columns)
    return df.select((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in (("entry", "long"), ("block", "int"), ("page", "int"), ("path", "string"))])


def shape_problems(files: DataFrame) -> DataFrame:
    """Entries whose blocks do not start where the last one ended, hold another
    number of pages than their bytes need, or do not add up to the file."""
    blocks = files.select("entry", "size", F.posexplode("blocks").alias("n", "b"))
    order = Window.partitionBy("entry").orderBy("n")
    cursor = F.coalesce(F.sum("b.raw_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    need = F.when(F.col("b.raw_size") == 0, 0).otherwise(F.ceil(F.col("b.raw_size") / F.greatest(F.col("b.page_size"), F.lit(1))))
    wrong = (F.col("b.raw_offset") != cursor) | ((F.col("b.page_count") != 0) & (F.col("b.page_size") <= 0)) | (F.col("b.page_count") != need)
    of_blocks = blocks.select("entry", wrong.alias("wrong")).where("wrong").select("entry")
    total = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b["raw_size"])
    return of_blocks.unionByName(files.where(total != F.col("size")).select("entry")).distinct()


def missing_pages(expected: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    return expected.join(pages.select(*key), key, "left_anti")


def orphan_pages(expected: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    return pages.join(expected.select(*key).distinct(), key, "left_anti")


def duplicate_entries(paths: DataFrame) -> DataFrame:
    """Paths beyond the first of an entry."""
    return paths.withColumn("_n", F.row_number().over(Window.partitionBy("entry").orderBy("path"))).where("_n > 1").drop("_n")


def only_entries(pack: Pack, entries: DataFrame) -> Pack:
    """The part of a pack that concerns some entries."""
    part = lambda df: df.join(entries.select("entry").distinct(), "entry", "left_semi")
    return pack.with_(files=part(pack.files), pages=part(pack.pages), paths=part(pack.paths), tombstones=part(pack.tombstones))


def verify_pack(pack: Pack, base: Pack | None = None, counts: bool = True) -> DataFrame:
    """Issues (kind, entry, block, page, path). counts=False leaves out the
    manifest's counts, for a part of a pack. An overlay may leave pages and
    manifests to its base; with the base given, both are looked at together."""
    files, over = pack.files, pack.is_overlay
    spark = files.sparkSession
    found: list[DataFrame] = []
    add = lambda df, kind: found.append(_issue(df, kind))
    nothing = spark.range(1).select()

    m = pack.manifest
    if not isinstance(m.get("pack_id"), int) or not isinstance(m.get("pack_version"), int) or m.get("pack_version", 0) < 1:
        add(nothing, "pack_manifest_invalid")
    if m.get("patch_in_progress"):
        add(nothing, "patch_in_progress")
    if not over and counts:
        for table, kind, count in ((files, "manifest_file_count_mismatch", m.get("file_count")), (pack.tombstones, "manifest_tombstone_count_mismatch", m.get("tombstone_count"))):
            add(table.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != count).select(), kind)

    add(pack.paths.where(F.coalesce(normalize_path(F.col("path")) != F.col("path"), F.lit(True))), "path_index_invalid")
    add(pack.paths.where("entry is null or entry = 0"), "path_index_key_mismatch")
    if "path_hash" in pack.paths.columns:
        add(pack.paths.where(F.col("path_hash") != F.xxhash64("path")), "path_hash_mismatch")
    add(duplicate_entries(pack.paths), "duplicate_file_entry")
    known = files.select("entry") if base is None else files.select("entry").unionByName(base.files.select("entry"))
    add(pack.paths.join(known, "entry", "left_anti"), "file_manifest_missing")
    add(files.where("entry is null or entry = 0 or size < 0 or blocks is null"), "file_manifest_invalid")
    add(files.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "file_manifest_key_mismatch")
    add(shape_problems(files), "file_manifest_shape_invalid")
    add(pack.tombstones.where("entry is null or entry = 0"), "tombstone_invalid")
    add(pack.tombstones.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "tombstone_key_mismatch")

    refs = expected_pages(files).where("explicit").select(F.col("entry").alias("file"), F.col("page").alias("place"), "ref", "ref.*")
    add(refs.where("ref is null"), "page_ref_missing")
    foreign = (F.col("pack_id") != pack.id) | (F.col("generation") > pack.version)
    if base is None:
        add(refs.where(foreign), "page_ref_pack_missing")
    own = refs.where("ref is not null").where(~foreign)
    add(own.where("entry is null or entry = 0 or page < 0"), "page_ref_identity_mismatch")
    found.append(page_issues(pack, base, own))
    return reduce(DataFrame.unionByName, found)


#: What is wrong with a stored page row by itself, as bits.
_INVALID, _PAYLOAD_OF_NONE, _UNKNOWN, _PLACEHOLDER = 1, 2, 4, 8


def page_facts(pages: DataFrame) -> DataFrame:
    """(entry, block, page, bad, raw_crc, content_hash): every page is decoded
    and compared with all that its row says of it; payloads go no further."""
    ddl = "entry long, block int, page int, bad int, raw_crc long, content_hash string"
    out = to_arrow_schema(StructType.fromDDL(ddl))

    def judge(codec: str | None, payload: bytes | None, raw_size: int | None, stored_size: int | None, content_hash: str | None) -> tuple[bytes | None, bool]:
        if codec not in CODECS or payload is None or len(payload) != stored_size or raw_size is None:
            return None, False
        try:
            raw = decode(codec, payload, raw_size)
        except StoreError:
            return None, False
        return raw, hashlib.sha256(raw).hexdigest() == content_hash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                kinds, codec, payload, crc, stored = (part.column(c).to_pylist() for c in ("kind", "codec", "payload", "raw_crc", "stored_crc"))
                judged = [judge(*row) for row in zip(codec, payload, *(part.column(c).to_pylist() for c in ("raw_size", "stored_size", "content_hash")), strict=True)]
                of_payload = crc32c_many(payload)
                of_raw = crc32c_many([raw for raw, _ in judged])
                bad = []
                for i, kind in enumerate(kinds):
                    if kind == "page":
                        good = judged[i][1] and stored[i] == int(of_payload[i]) and crc[i] == int(of_raw[i])
                        bad.append(0 if good else _INVALID)
                    elif kind == "placeholder":
                        bad.append(_PLACEHOLDER | (_PAYLOAD_OF_NONE if payload[i] is not None else 0))
                    else:
                        bad.append(_UNKNOWN)
                hashes = part.column("content_hash").to_pylist()
                told = [pa.array([v if k == "page" else None for k, v in zip(kinds, values, strict=True)], t) for values, t in ((crc, pa.int64()), (hashes, pa.string()))]
                columns = [part.column("entry"), part.column("block"), part.column("page"), pa.array(bad, pa.int32()), *told]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return pages.select("entry", "block", "page", "kind", "codec", "raw_size", "stored_size", "raw_crc", "stored_crc", "content_hash", "payload").mapInArrow(run, ddl)


def page_issues(pack: Pack, base: Pack | None, own_refs: DataFrame) -> DataFrame:
    """Issues of pages: stored rows, expected pages and references meet in one
    aggregation by key, with partial sums before the shuffle, so that a page
    which very many files name is no task of its own."""
    over, none = pack.is_overlay, F.lit(None)
    row = lambda df, **have: df.select(*_KEY, *[have.get(c, F.lit(d)).cast(t).alias(c) for c, d, t in (("n", 0, "int"), ("bad", 0, "int"), ("implicit", 0, "int"), ("explicit", 0, "int"), ("named", 0, "int"), ("below", 0, "int"))], have.get("raw_crc", none).cast("long").alias("raw_crc"), have.get("content_hash", none).cast("string").alias("content_hash"))
    one = F.lit(1)
    parts = [
        row(page_facts(pack.pages), n=one, bad=F.col("bad"), raw_crc=F.col("raw_crc"), content_hash=F.col("content_hash")),
        row(expected_pages(pack.files).where("not explicit"), implicit=one, named=one),
        row(own_refs, explicit=one, named=one, raw_crc=F.col("raw_crc"), content_hash=F.col("content_hash")),
        row(expected_pages(pack.files).where("explicit and ref is not null").select("ref.*"), named=one),
    ]
    if base is not None:
        expected = expected_pages(base.files)
        parts += [row(expected.where("not explicit"), named=one), row(expected.where("explicit and ref is not null").select("ref.*"), named=one), row(base.pages, below=one)]
    sums = [F.sum("n").alias("n"), F.bit_or("bad").alias("bad"), *[F.max(c).alias(c) for c in ("implicit", "explicit", "named", "below")]]
    differ = (F.min("raw_crc") != F.max("raw_crc")) | (F.min("content_hash") != F.max("content_hash"))
    by_key = reduce(DataFrame.unionByName, parts).groupBy(*_KEY).agg(*sums, F.coalesce(differ, F.lit(False)).alias("differ"))

    missing = F.col("n") == 0
    absent = (F.col("implicit") == 1) & missing & (F.col("below") == 0) & F.lit(not over or base is not None)
    bit = lambda b: F.col("bad").bitwiseAND(F.lit(b)) != 0
    kinds = {
        "page_missing": absent,
        "page_ref_missing": (F.col("explicit") == 1) & missing & F.lit(not over),
        "page_ref_hash_mismatch": (F.col("explicit") == 1) & ~missing & F.col("differ"),
        "orphan_page": ~missing & (F.col("named") == 0),
        "page_key_mismatch": F.col("n") > 1,
        "page_invalid": bit(_INVALID),
        "page_placeholder_invalid": bit(_PAYLOAD_OF_NONE),
        "placeholder_in_non_overlay": bit(_PLACEHOLDER) & F.lit(not over),
        "unknown_object": bit(_UNKNOWN),
    }
    said = F.filter(F.array(*[F.when(when, F.lit(kind)) for kind, when in kinds.items()]), lambda k: k.isNotNull())
    return _issue(by_key.select(*_KEY, F.explode(said).alias("found")), F.col("found"))


def verify_stored(spark: SparkSession, path: str, base: Pack | None = None, expect: tuple[int, int] | None = None) -> DataFrame:
    """Issues of a pack on disk: first that it can be read at all (pointer,
    manifest, every table), then of its contents, then of a patch that has begun
    and not ended. `expect`: the pack id and version that it should have."""
    found: list[DataFrame] = []
    add = lambda kind: found.append(_issue(spark.range(1).select(), kind))
    if fs.damaged_slots(spark, f"{path}/CURRENT"):
        add("db_verify_failed")
    if fs.exists(spark, f"{path}/intent.json"):
        add("patch_in_progress")
    try:
        root = f"{path}/versions/{pack_source.current(spark, path)['version']}"
    except StoreError:
        add("pack_manifest_missing")
        return reduce(DataFrame.unionByName, found)
    absent = {"paths": "path_index_missing", "files": "file_manifest_missing"}
    readable = True
    for table in TABLES:
        if not fs.exists(spark, f"{root}/{table}"):
            add(absent.get(table, "object_read_failed"))
            readable = False
            continue
        try:
            spark.read.schema(TABLES[table]).parquet(f"{root}/{table}").write.format("noop").mode("overwrite").save()
        except Exception:  # whatever the reader makes of a damaged file
            add("object_read_failed")
            readable = False
    try:
        manifest = fs.read_json(spark, f"{root}/manifest.json")
        if expect is not None and (manifest.get("pack_id"), manifest.get("pack_version")) != tuple(expect):
            add("pack_manifest_key_mismatch")
    except (ValueError, AttributeError):
        add("pack_manifest_invalid")
        readable = False
    if readable:
        found.append(verify_pack(pack_source.read_pack(spark, path), base))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], ISSUES)
