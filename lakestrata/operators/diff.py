"""Differences between two versions of a pack.

Files, pages, tombstones and paths are compared by full outer joins on their
keys. A block's strategy says how its changed pages travel: `replace` sends
them whole, `page` as a delta per page, `logical` as one delta for the block's
raw bytes. Deltas that save too little are sent whole after all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..errors import InvalidArgument, UnsupportedFeature
from ..functions import bindiff, codecs
from ..functions.checksums import crc_sequence_hash
from ..sources import fs
from ..sources.pack import Pack

#: Limits of the strategy decision.
MIN_DELTA_BLOCK = 4096
MAX_LOGICAL_BLOCK = 64 << 20
MAX_DELTA_PERMILLE = 900

#: Flags of a unit.
NEW_BLOCK, CFG_OVERRIDE, DOWNGRADED_LAYOUT, DOWNGRADED_RATIO = 1, 2, 4, 8

#: Order of units within one diff: block deltas, page writes, deletes.
KIND_ORDER = {"put_block_ldelta": 0, "put_page_raw": 1, "put_page_pdelta": 1, "delete_page": 2}

UNITS = (
    "kind string, entry long, block int, page int, strategy string, flags long, shard int, codec string, codec_tag string, raw_size long, stored_size long, raw_crc long, stored_crc long, content_hash string, "
    "old_stored_crc long, old_block_hash string, new_block_hash string, page_size int, page_count int, crc_sequence long, payload binary"
)
_UNIT = [c.split()[0] for c in UNITS.split(", ")]
TABLES = ("units", "file_ops", "path_delta")


@dataclass(frozen=True)
class Diff:
    manifest: dict
    units: DataFrame
    file_ops: DataFrame
    path_delta: DataFrame


def file_changes(base: DataFrame, target: DataFrame, compared: list[str] | None = None) -> DataFrame:
    """(entry, change): added, changed, unchanged or removed."""
    compared = compared or [c for c in target.columns if c not in ("entry", "version")]
    old = base.select("entry", F.struct(*compared).alias("_old"))
    new = target.select("entry", F.struct(*compared).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return old.join(new, "entry", "full").select("entry", change.alias("change"))


def path_changes(base: DataFrame, target: DataFrame) -> DataFrame:
    """(op, path, entry, flags): add for new or different paths, remove for gone ones."""
    old = base.select("path", F.struct("entry", "flags").alias("_old"))
    new = target.select("path", F.struct("entry", "flags").alias("_new"))
    both = old.join(new, "path", "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    op = F.when(F.col("_new").isNull(), "remove").otherwise("add")
    return both.select(op.alias("op"), "path", F.coalesce("_new.entry", "_old.entry").alias("entry"), F.coalesce("_new.flags", "_old.flags").alias("flags"))


def tombstone_changes(base: DataFrame, target: DataFrame) -> DataFrame:
    """(op, entry, version, reason) for tombstones put or deleted."""
    old = base.select("entry", F.struct("version", "reason").alias("_old"))
    new = target.select("entry", F.struct("version", "reason").alias("_new"))
    both = old.join(new, "entry", "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    op = F.when(F.col("_new").isNull(), "delete_entry_tombstone").otherwise("put_entry_tombstone")
    return both.select(op.alias("op"), "entry", "_new.version", "_new.reason")


def page_changes(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Keys with status put (new or different) or delete (gone); equal pages drop out."""
    a = old.select(*keys, F.struct(*compared).alias("_old"))
    b = new.select(*keys, F.struct(*compared).alias("_new"))
    both = a.join(b, keys, "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select(*keys, F.when(F.col("_new").isNull(), "delete_page").otherwise("put_page_raw").alias("kind"))


def decide(override: Column, old_codec: Column, new_codec: Column, new_size: Column, is_new: Column) -> Column:
    """struct(strategy, flags) of a block."""
    can = lambda c, what: F.coalesce(c.isin([k for k, v in codecs.CODECS.items() if getattr(v, what)]), F.lit(False))
    runs = can(new_codec, "compress") & can(new_codec, "decompress") & can(old_codec, "decompress")
    said = lambda strategy, flags: F.struct(F.lit(strategy).alias("strategy"), F.lit(flags).cast("long").alias("flags"))
    return (
        F.when(is_new, said("replace", NEW_BLOCK))
        .when(override == "replace", said("replace", CFG_OVERRIDE))
        .when(override == "page", said("page", CFG_OVERRIDE))
        .when((override == "logical") & runs, said("logical", CFG_OVERRIDE))
        .when(override == "logical", said("page", CFG_OVERRIDE | DOWNGRADED_LAYOUT))
        .when(new_size < MIN_DELTA_BLOCK, said("replace", 0))
        .when(runs & can(new_codec, "deterministic") & (new_size <= MAX_LOGICAL_BLOCK), said("logical", 0))
        .when(runs & can(new_codec, "deterministic"), said("page", DOWNGRADED_LAYOUT))
        .otherwise(said("page", 0))
    )


def _blocks(files: DataFrame) -> DataFrame:
    return files.select("entry", "strategy", F.posexplode("blocks").alias("block", "b"))


def block_decisions(base: Pack, target: Pack) -> DataFrame:
    """(entry, block, strategy, flags, same) for the target's blocks. Blocks that
    equal their old form are only compared page by page."""
    old = _blocks(base.files).select("entry", "block", F.col("b").alias("old"))
    new = _blocks(target.files).select("entry", "block", F.col("strategy").alias("override"), F.col("b").alias("new"))
    both = new.join(old, ["entry", "block"], "left")
    same = F.coalesce(F.col("old") == F.col("new"), F.lit(False))
    d = decide(F.col("override"), F.col("old.codec"), F.col("new.codec"), F.col("new.raw_size"), F.col("old").isNull())
    d = F.when(same, F.struct(F.lit("replace").alias("strategy"), F.lit(0).cast("long").alias("flags"))).otherwise(d)
    return both.select(
        "entry", "block", d.alias("d"), F.col("old.block_hash").alias("old_block_hash"), F.col("new.block_hash").alias("new_block_hash"), F.col("new.page_size").alias("page_size"), F.col("new.page_count").alias("page_count"),
    ).select("entry", "block", "d.*", "old_block_hash", "new_block_hash", "page_size", "page_count")


_FACTS = ["codec", "raw_size", "stored_size", "raw_crc", "stored_crc", "content_hash"]


def _unit(values: dict) -> list[Column]:
    types = dict(c.split(" ", 1) for c in UNITS.split(", "))
    return [(values[c] if c in values else F.lit(None)).cast(types[c]).alias(c) for c in _UNIT]


def _pdeltas(rows: DataFrame) -> DataFrame:
    """Makes the deltas among page units; those that save too little become
    whole pages."""
    out = to_arrow_schema(StructType.fromDDL(UNITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                old, whole = row.pop("old_payload"), row["payload"]
                made.append(row)
                if row["kind"] != "put_page_pdelta":
                    continue
                delta = bindiff.diff(old, whole)
                if not whole or len(delta) * 1000 > len(whole) * MAX_DELTA_PERMILLE:
                    row |= {"kind": "put_page_raw", "codec_tag": None, "flags": row["flags"] | DOWNGRADED_RATIO}
                else:
                    row["payload"] = delta
            yield pa.RecordBatch.from_pylist(made, schema=out)

    return rows.mapInArrow(run, UNITS)


def _ldeltas(rows: DataFrame) -> DataFrame:
    """One delta for each block of rows (a row for each old or new page), or
    the whole pages where it saves too little."""
    out = to_arrow_schema(StructType.fromDDL(UNITS))

    def block(pages: list[dict]) -> list[dict]:
        raw = lambda side: b"".join(codecs.decode(r[f"{side}_codec"], r[f"{side}_payload"], r[f"{side}_raw_size"]) for r in pages if r[f"{side}_payload"] is not None)
        new = [r for r in pages if r["new_payload"] is not None]
        delta = bindiff.diff(raw("old"), raw("new"))
        whole = sum(len(r["new_payload"]) for r in new)
        common = {k: new[0][k] for k in ("entry", "block", "strategy", "flags", "shard", "old_block_hash", "new_block_hash", "page_size", "page_count")}
        if not whole or len(delta) * 1000 > whole * MAX_DELTA_PERMILLE:
            return [
                common | {"kind": "put_page_raw", "page": r["page"], "payload": r["new_payload"], "flags": common["flags"] | DOWNGRADED_RATIO, "old_stored_crc": r["old_stored_crc"]}
                | {f: r[f"new_{f}"] for f in _FACTS} for r in new
            ]
        codec = new[0]["block_codec"]
        return [common | {"kind": "put_block_ldelta", "page": 0, "codec": codec, "codec_tag": codecs.build_tag(codec), "raw_size": sum(r["new_raw_size"] for r in new), "crc_sequence": crc_sequence_hash([r["new_raw_crc"] for r in new]), "payload": delta}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pages in batch.column("pages"):  # one block at a time
                yield pa.RecordBatch.from_pylist([{c: m.get(c) for c in _UNIT} for m in block(pages.as_py())], schema=out)

    names = [c for c in rows.columns if c != "page"]
    blocks = rows.groupBy("entry", "block").agg(F.array_sort(F.collect_list(F.struct("page", *names))).alias("pages"))
    changed = blocks.where(F.exists("pages", lambda p: ~p["equal"]))
    return changed.select("pages").mapInArrow(run, UNITS)


def plan_units(base: Pack, target: Pack) -> DataFrame:
    """All units with their payloads."""
    explicit = base.files.select("page_refs").unionByName(target.files.select("page_refs")).where(F.size("page_refs") > 0).limit(1).count()
    if explicit:
        raise UnsupportedFeature("explicit page references")
    side = lambda p, name: p.pages.where("kind = 'page'").select("entry", "block", "page", F.struct(*_FACTS, "payload", "shard").alias(name))
    both = side(base, "o").join(side(target, "n"), ["entry", "block", "page"], "full")
    stored = [F.struct(*[F.col(f"{s}.{c}") for c in ("codec", "stored_size", "stored_crc", "content_hash")]) for s in ("o", "n")]
    equal = F.coalesce(F.col("o").isNotNull() & F.col("n").isNotNull() & (stored[0] == stored[1]), F.lit(False))
    decided = block_decisions(base, target)
    rows = both.withColumn("equal", equal).join(decided, ["entry", "block"], "left")

    # Pages that travel by themselves, in one pass; deltas are made where both
    # payloads are at hand.
    has_old, has_new = F.col("o").isNotNull(), F.col("n").isNotNull()
    kind = F.when(~has_new, "delete_page").when((F.col("strategy") == "page") & has_old, "put_page_pdelta").otherwise("put_page_raw")
    flags = F.when(~has_new, 0).when(~has_old & (F.col("strategy") == "page"), F.col("flags").bitwiseOR(F.lit(NEW_BLOCK).cast("long"))).otherwise(F.col("flags"))
    tag = F.col("n.codec")
    for codec in codecs.CODECS:
        tag = F.when(F.col("n.codec") == codec, codecs.build_tag(codec)).otherwise(tag)
    values = {c: F.col(f"n.{c}") for c in [*_FACTS, "payload"]} | {c: F.when(has_new, F.col(c)) for c in ("old_block_hash", "new_block_hash", "page_size", "page_count")}
    values |= {
        "kind": kind, "entry": F.col("entry"), "block": F.col("block"), "page": F.col("page"), "strategy": F.when(has_new, F.col("strategy")).otherwise("replace"), "flags": flags,
        "shard": F.coalesce("n.shard", "o.shard"), "codec_tag": F.when(kind == "put_page_pdelta", tag), "old_stored_crc": F.col("o.stored_crc"),
    }
    single = rows.where("n is null or (not equal and strategy in ('replace', 'page'))")
    single = _pdeltas(single.select(*_unit(values), F.when(kind == "put_page_pdelta", F.col("o.payload")).alias("old_payload")))
    names = _blocks(target.files).select("entry", "block", F.col("b.codec").alias("block_codec"))
    of_block = rows.where("strategy = 'logical'").join(names, ["entry", "block"]).select(
        "entry", "block", "page", "equal", "strategy", "flags", "block_codec", F.coalesce("n.shard", "o.shard").alias("shard"), "old_block_hash", "new_block_hash", "page_size", "page_count",
        *[F.col(f"{s}.{c}").alias(f"{t}_{c}") for s, t in (("o", "old"), ("n", "new")) for c in [*_FACTS, "payload"]],
    )
    return single.unionByName(_ldeltas(of_block))


def canonical_order(units: DataFrame) -> DataFrame:
    """Shard, deletes last, entry, block, page."""
    return units.orderBy("shard", F.col("kind") == "delete_page", "entry", "block", "page")


def diff_packs(base: Pack, target: Pack) -> Diff:
    """What turns base into target: two versions of one pack."""
    if base.id != target.id or base.version == target.version:
        raise InvalidArgument("a diff needs two versions of one pack")
    units = plan_units(base, target)
    row = target.files.columns
    changes = file_changes(base.files, target.files)
    put = target.files.join(changes.where("change in ('added', 'changed')").select("entry"), "entry", "left_semi")
    ops = put.select(F.lit("put_file_manifest").alias("op"), "entry", "version", F.lit(None).cast("string").alias("reason"), F.struct(*row).alias("file"))
    none = F.lit(None).cast(ops.schema["file"].dataType)
    gone = changes.where("change = 'removed'").select(F.lit("delete_file_manifest").alias("op"), "entry", F.lit(None).cast("long").alias("version"), F.lit(None).cast("string").alias("reason"), none.alias("file"))
    marks = tombstone_changes(base.tombstones, target.tombstones).withColumn("file", none)
    ops = ops.unionByName(gone).unionByName(marks)
    if target.manifest.get("directory") != base.manifest.get("directory"):  # put when changed, never deleted
        one = target.files.sparkSession.range(1)
        put = one.select(F.lit("put_directory_manifest").alias("op"), F.lit(0).cast("long").alias("entry"), F.lit(None).cast("long").alias("version"), F.lit(None).cast("string").alias("reason"), none.alias("file"))
        ops = ops.unionByName(put)
    diff = Diff({}, units, ops, path_changes(base.paths, target.paths))
    facts = {k: target.manifest.get(k) for k in ("file_count", "tombstone_count", "build_id", "flags", "pack_name", "directory")}
    manifest = {"pack_id": base.id, "base_version": base.version, "target_version": target.version, "base_content_hash": base.manifest["content_hash"], "target_content_hash": target.manifest["content_hash"], "target": facts}
    return Diff(manifest, diff.units, diff.file_ops, diff.path_delta)


def statistics(units: DataFrame) -> DataFrame:
    """For each shard: units, payload bytes, and counts by kind and flag."""
    count = lambda c: F.count(F.when(c, 1))
    flag = lambda f: count(F.col("flags").bitwiseAND(F.lit(f).cast("long")) != 0)
    return units.groupBy("shard").agg(
        F.count(F.lit(1)).alias("units"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("payload_bytes"), *[count(F.col("kind") == k).alias(k) for k in KIND_ORDER],
        flag(NEW_BLOCK).alias("new_block"), flag(DOWNGRADED_RATIO).alias("downgraded_ratio"), flag(DOWNGRADED_LAYOUT).alias("downgraded_layout"), flag(CFG_OVERRIDE).alias("cfg_override"),
    )


def write_diff(diff: Diff, path: str) -> Diff:
    """Tables first, manifest last: a directory with a manifest is whole."""
    spark = diff.units.sparkSession
    fs.delete(spark, path)
    for table in TABLES:
        df = getattr(diff, table)
        if table == "units":
            df = df.repartitionByRange("shard", "entry", "block", "page").sortWithinPartitions("shard", F.col("kind") == "delete_page", "entry", "block", "page")
        df.write.parquet(f"{path}/{table}")
    units = spark.read.parquet(f"{path}/units")
    facts = units.agg(F.count(F.lit(1)).alias("unit_count"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("payload_bytes")).first().asDict()
    counts = {f"{t}_count": spark.read.parquet(f"{path}/{t}").count() for t in ("file_ops", "path_delta")}
    identity = "|".join(str(diff.manifest[k]) for k in ("pack_id", "base_version", "target_version", "base_content_hash", "target_content_hash"))
    fs.write_json(spark, f"{path}/manifest.json", diff.manifest | facts | counts | {"diff_id": hashlib.sha256(identity.encode()).hexdigest()[:16]})
    return read_diff(spark, path)


def read_diff(spark: SparkSession, path: str) -> Diff:
    manifest = fs.read_json(spark, f"{path}/manifest.json")
    return Diff(manifest, *(spark.read.parquet(f"{path}/{t}") for t in TABLES))


def verify_diff(diff: Diff) -> DataFrame:
    """(kind, entry, block, page): units without the payload their kind needs,
    with one it must not have, or with a delta whose header makes no sense; page
    units that two units claim; counts that the manifest states otherwise."""
    @F.arrow_udf("boolean")
    def sound(delta: pa.Array) -> pa.Array:
        return pa.array([d is not None and bindiff.header_ok(d) for d in delta.to_pylist()])

    is_delta = F.col("kind").isin("put_page_pdelta", "put_block_ldelta")
    problem = (
        F.when(~F.col("kind").isin(*KIND_ORDER), "unknown_kind")
        .when((F.col("kind") == "delete_page") & F.col("payload").isNotNull(), "payload_not_empty")
        .when((F.col("kind") != "delete_page") & F.col("payload").isNull(), "payload_missing")
        .when(is_delta & ~F.col("sound"), "delta_header")
    )
    found = diff.units.withColumn("sound", sound(F.col("payload"))).withColumn("kind", problem).where("kind is not null").select("kind", "entry", "block", "page")
    twice = diff.units.groupBy("entry", "block", "page").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = found.unionByName(twice.select(F.lit("duplicate_unit").alias("kind"), "entry", "block", "page"))
    sums = diff.units.agg(F.count(F.lit(1)).alias("unit_count"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("payload_bytes"))
    for fact in diff.manifest.keys() & {"unit_count", "payload_bytes"}:
        wrong = sums.where(F.col(fact) != F.lit(diff.manifest[fact]))
        found = found.unionByName(wrong.select(F.lit(f"{fact}_mismatch").alias("kind"), *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("entry", "block", "page")]))
    return found
