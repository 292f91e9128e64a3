"""A volume: packs mounted by priority, read as one file system."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..errors import Busy, ChecksumMismatch, Corruption, InvalidArgument, NotFound, OverlayBaseMismatch
from ..functions import codecs
from ..functions.checksums import crc32c_many
from ..functions.paths import checked_path, normalize
from ..sources import fs
from ..sources.pack import BLOCK, EXPLICIT_REFS, OVERLAY, REF, Pack, decode_pages, empty_pack, encode_pages, explode_pages, page_count, read_pack, write_pack
from ..sources.pack import exists as pack_exists
from . import overlay

WRITABLE_PRIORITY = (1 << 32) - 1
PAGE_KEY = ["entry", "block", "page"]


@dataclass(frozen=True)
class Mount:
    number: int  # order of mounting
    pack: Pack
    priority: int
    path: str | None = None


def create_overlay(spark: SparkSession, base: Pack, pack_id: int | None = None) -> Pack:
    """An empty pack over a base; it records the base's version."""
    if base.is_overlay:
        raise InvalidArgument("an overlay can't lie over an overlay")
    return empty_pack(spark, base.id if pack_id is None else pack_id, base.version, flags=OVERLAY, base_pack_version=base.version, shards=base.manifest.get("shards", 1))


def check_overlay(over: Pack, base: Pack) -> None:
    if not over.is_overlay or base.is_overlay or over.id != base.id:
        raise InvalidArgument("not an overlay of this base")
    if over.manifest["base_pack_version"] != base.version:
        raise OverlayBaseMismatch(f"{over.manifest['base_pack_version']} and {base.version}")


class Volume:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.mounts: list[Mount] = []
        self.writable: str | None = None
        self._open = 0

    # ---------------------------------------------------------------- mounts

    def mount(self, pack: Pack | str, priority: int) -> None:
        path = pack if isinstance(pack, str) else None
        pack = read_pack(self.spark, pack) if isinstance(pack, str) else pack
        if any(m.priority == priority for m in self.mounts):
            raise InvalidArgument(f"priority {priority} is taken")
        for m in self.mounts:
            if m.pack.id != pack.id:
                continue
            if pack.is_overlay and m.pack.is_overlay:
                raise InvalidArgument("two overlays of one pack")
            for over, base, above in ((pack, m.pack, priority > m.priority), (m.pack, pack, m.priority > priority)):
                if over.is_overlay and (over.manifest["base_pack_version"] != base.version or not above):
                    raise InvalidArgument("an overlay lies above the base version it was made for")
        self.mounts.append(Mount(len(self.mounts), pack, priority, path))
        self.mounts.sort(key=lambda m: -m.priority)

    def mount_writable(self, path: str, pack_id: int = 1, page_size: int = 65536) -> None:
        """The pack that takes writes, made if missing; one at most, on top."""
        if self.writable:
            raise InvalidArgument("there is a writable pack")
        if not pack_exists(self.spark, path):
            write_pack(empty_pack(self.spark, pack_id, 1), path)
        self.mount(path, WRITABLE_PRIORITY)
        self.writable, self.page_size = path, page_size

    def mount_table(self) -> DataFrame:
        """(mount, pack_id, pack_version, priority, top, base): top and base are
        the mounts that serve implicit pages of a file found in `mount`."""
        rows = []
        for m in self.mounts:
            same = [x for x in self.mounts if x.pack.id == m.pack.id]
            over, base = next((x for x in same if x.pack.is_overlay), None), next((x for x in same if not x.pack.is_overlay), None)
            rows.append((m.number, m.pack.id, m.pack.version, m.priority, over.number if over else m.number, base.number if over and base else None))
        listed = ", ".join("({})".format(", ".join("cast(null as int)" if x is None else str(x) for x in r)) for r in rows)
        found = self.spark.sql(f"SELECT * FROM VALUES {listed} AS t(mount, pack_id, pack_version, priority, top, base)")
        return found.select("mount", *[F.col(c).cast("long").alias(c) for c in ("pack_id", "pack_version", "priority")], "top", "base")

    def _layers(self, table: str) -> DataFrame:
        if not self.mounts:
            raise NotFound("nothing is mounted")
        return reduce(DataFrame.unionByName, [getattr(m.pack, table).select("*", F.lit(m.number).alias("mount"), F.lit(m.priority).cast("long").alias("priority")) for m in self.mounts])

    # ----------------------------------------------------------------- reads

    def entries(self) -> DataFrame:
        """Visible entries with their file rows and the mount they come from."""
        return overlay.resolve_entries(self._layers("files"), self._layers("tombstones"))

    def files(self) -> DataFrame:
        """Visible files by path."""
        return overlay.open_paths(self._layers("paths"), self._layers("files"), self._layers("tombstones"))

    def stat(self, path: str) -> tuple[int, int, int]:
        """(entry, size, page size) of a path."""
        row = overlay.stat(self.files().where(F.col("path") == normalize(path))).first()
        if row is None:
            raise NotFound(path)
        return tuple(row)

    def stat_entry(self, entry: int) -> tuple[int, int, int]:
        row = overlay.stat(self.entries().where(F.col("entry") == entry)).first()
        if row is None:
            raise NotFound(str(entry))
        return tuple(row)

    def page_sources(self, entries: DataFrame, offset: int | None = None, length: int | None = None) -> DataFrame:
        """Every page that the entries (rows of `entries()`) promise, or those of
        a byte range, with the stored page that serves it (kind is null if there
        is none). The range cuts the list before any page is joined."""
        mounts = self.mount_table()
        wanted = overlay.expected_pages(entries, ["entry", "mount"])
        if offset is not None:
            wanted = overlay.overlapping(wanted, F.lit(offset), F.lit(length))
        stored = self._layers("pages").drop("priority", "shard")
        served = mounts.select("mount", "top", "base", F.col("pack_id").alias("_pack"), F.col("pack_version").alias("_version"))

        implicit = wanted.where("not explicit").join(F.broadcast(served), "mount")
        keys = ["entry", "mount", *PAGE_KEY[1:], "start", "size"]
        top = implicit.alias("w").join(stored.withColumnRenamed("mount", "top"), ["entry", "block", "page", "top"]).select(*keys, *_PAGE, F.col("top").alias("source"))
        below = implicit.where("base is not null").join(stored.withColumnRenamed("mount", "base"), ["entry", "block", "page", "base"]).select(*keys, *_PAGE, F.col("base").alias("source"))
        found = overlay.resolve_pages(top, below, keys).drop("layer")
        all_implicit = implicit.select(*keys).join(found, keys, "left")

        refs = wanted.where("explicit").select("entry", "mount", "block", "page", "start", "size", F.col("ref.pack_id").alias("pack_id"), F.col("ref.generation").alias("generation"), "ref")
        by_pack = refs.join(F.broadcast(overlay.match_generation(refs, mounts).withColumnRenamed("mount", "source")), ["pack_id", "generation"], "left")
        target = stored.select(*[F.col(k).alias(f"_{k}") for k in PAGE_KEY], F.col("mount").alias("source"), *_PAGE)
        hit = by_pack.withColumn("_entry", F.col("ref.entry")).withColumn("_block", F.col("ref.block")).withColumn("_page", F.col("ref.page")).join(target, ["source", "_entry", "_block", "_page"], "left")
        good = (F.col("raw_crc") == F.col("ref.raw_crc")) & (F.col("content_hash") == F.col("ref.content_hash"))
        checked = F.when(F.col("kind").isNull() | good, F.col("kind")).otherwise(F.raise_error("checksum_mismatch: page reference"))
        explicit = hit.withColumn("kind", checked).select(*keys, *_PAGE, "source")
        return all_implicit.unionByName(explicit)

    def contents(self, entries: DataFrame | None = None) -> DataFrame:
        """(entry, data, missing) of all visible entries or the given ones, in
        one job. A file with missing pages has null data.

        Files are partitioned by entry and so are the stored pages, once; each
        file is then put together where its pages are.
        """
        entries = self.entries() if entries is None else entries
        explicit = F.exists("blocks", lambda b: b["flags"].bitwiseAND(F.lit(EXPLICIT_REFS)) != 0)
        plain = self._whole_files(entries.where(~explicit))
        if not any(m.pack.manifest.get("explicit_refs", True) for m in self.mounts):
            return plain
        return plain.unionByName(self._referenced_files(entries.where(explicit)))

    def _whole_files(self, entries: DataFrame) -> DataFrame:
        """Files whose pages go by their own keys, in the top or base layer."""
        served = self.mount_table().select("mount", "top", "base")
        files = entries.select("entry", "mount", "blocks").join(F.broadcast(served), "mount").drop("mount")
        stored = self._layers("pages").select("entry", "mount", F.struct("block", "page", "kind", "codec", "raw_size", "raw_crc", "payload").alias("p"))
        wanted = files.select("entry", "top", "base")
        mine = stored.join(wanted, "entry").where("mount = top or mount = base")
        held = mine.groupBy("entry").agg(F.collect_list(F.struct((F.col("mount") == F.col("top")).alias("is_top"), "p.*")).alias("pages"))
        joined = files.select("entry", F.transform("blocks", lambda b: F.struct(b["page_count"].alias("n"))).alias("blocks")).join(held, "entry", "left")
        ddl = "entry long, data binary, missing long"
        out = to_arrow_schema(StructType.fromDDL(ddl))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    data, missing = _assemble(part.column("blocks").to_pylist(), part.column("pages").to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column("entry").cast(pa.int64()), pa.array(data, pa.binary()), pa.array(missing, pa.int64())], schema=out)

        return joined.mapInArrow(run, ddl)

    def _referenced_files(self, entries: DataFrame) -> DataFrame:
        """Files whose pages may stand anywhere."""
        pages = self.page_sources(entries)
        raw = decode_pages(pages.where("kind = 'page'"), ["entry", "start"])
        whole = overlay.assemble(raw, ["entry"], "start", "raw")
        missing = pages.groupBy("entry").agg(F.count(F.when(F.col("kind").isNull(), 1)).alias("missing"))
        out = entries.select("entry", "size").join(missing, "entry", "left").join(whole, "entry", "left")
        data = F.when(F.coalesce("missing", F.lit(0)) == 0, F.coalesce("data", F.lit(b"")))
        return out.select("entry", data.alias("data"), F.coalesce("missing", F.lit(0)).alias("missing"))

    def read_entry(self, entry: int, offset: int = 0, length: int | None = None) -> bytes:
        """Bytes of a file; a range beyond its end is cut, a missing page is NotFound."""
        one = self.entries().where(F.col("entry") == entry)
        row = one.select("size").first()
        if row is None:
            raise NotFound(str(entry))
        length = min(row.size - offset, row.size if length is None else length)
        if length <= 0:
            return b""
        pages = self.page_sources(one, offset, length)
        raw = decode_pages(pages.where("kind is not null"), ["entry", "start", "size"])
        parts = overlay.clip(raw, F.lit(offset), F.lit(length)).select("at", "bytes").orderBy("at").collect()
        data = b"".join(bytes(p.bytes) for p in parts)
        if len(data) != length:
            raise NotFound(f"page of {entry}")
        return data

    def read(self, path: str, offset: int = 0, length: int | None = None) -> bytes:
        row = overlay.resolve_paths(self._layers("paths").where(F.col("path") == normalize(path))).first()
        if row is None:
            raise NotFound(path)
        return self.read_entry(row.entry, offset, length)

    # ---------------------------------------------------------------- writes

    def _writable(self) -> Pack:
        if not self.writable:
            raise InvalidArgument("no writable pack")
        return next(m.pack for m in self.mounts if m.priority == WRITABLE_PRIORITY)

    def _swap(self, pack: Pack) -> None:
        pack = write_pack(pack, self.writable)
        self.mounts = [Mount(m.number, pack, m.priority, m.path) if m.priority == WRITABLE_PRIORITY else m for m in self.mounts]

    def write_files(self, files: DataFrame) -> None:
        """Whole files (entry, data[, path]) into the writable pack. A page equal
        to the visible file's page at the same place is referenced, the others
        are written. A tombstone of the entry in this pack goes."""
        own, page_size = self._writable(), self.page_size
        generation = own.version + 1
        new = explode_pages(files.select("entry", "data", F.lit(page_size).alias("page_size"), F.lit("none").alias("codec"))).withColumn("content_hash", F.sha2("raw", 256))
        asked = files.select("entry").distinct()
        visible = self.entries().join(asked, "entry", "left_semi")
        old = self.page_sources(visible).where("kind = 'page' and block = 0")
        mounts = self.mount_table().select(F.col("mount").alias("source"), F.col("pack_id").alias("_pack"), F.col("pack_version").alias("_version"))
        refs = visible.select("entry", F.explode_outer("page_refs").alias("r")).where("r is not null").select("entry", F.struct("r.*").alias("r"))
        named = overlay.expected_pages(visible).where("explicit and block = 0").select("entry", "page", "ref")
        old = old.join(F.broadcast(mounts), "source").join(named, ["entry", "page"], "left").drop("size")
        generation_of = F.when(F.col("_pack") == own.id, F.lit(generation)).otherwise(F.col("_version"))
        kept = F.struct(
            F.col("_pack").alias("pack_id"), generation_of.cast("long").alias("generation"), F.coalesce("ref.entry", "entry").alias("entry"), F.coalesce("ref.block", "block").alias("block"),
            F.coalesce("ref.page", "page").alias("page"), F.col("raw_crc").alias("raw_crc"), F.col("content_hash").alias("content_hash"),
        )
        reusable = old.select("entry", "page", "content_hash", kept.alias("kept"))
        matched = new.join(reusable, ["entry", "page", "content_hash"], "left")
        pages = encode_pages(matched.where("kept is null"), own.manifest.get("shards", 1))
        fresh = F.struct(F.lit(own.id).cast("long").alias("pack_id"), F.lit(generation).cast("long").alias("generation"), "entry", "block", "page", "raw_crc", "content_hash")
        all_refs = matched.where("kept is not null").select("entry", "page", "kept").unionByName(pages.select("entry", "page", fresh.alias("kept")))
        gathered = all_refs.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("page", "kept"))).alias("refs"))
        size = F.octet_length("data").cast("long")
        block = F.struct(
            F.lit(0).cast("long").alias("raw_offset"), size.alias("raw_size"), F.lit(page_size).alias("page_size"), page_count(size, F.lit(page_size)).alias("page_count"), F.lit("none").alias("codec"), F.lit(0).alias("codec_level"),
            F.sha2("data", 256).alias("block_hash"), F.lit(EXPLICIT_REFS).cast("long").alias("flags"), F.lit(0).cast("long").alias("page_ref_offset"),
        )
        rows = files.join(gathered, "entry", "left").select(
            "entry", F.lit(generation).cast("long").alias("version"), size.alias("size"), F.sha2("data", 256).alias("content_hash"), F.lit(0).cast("long").alias("flags"), F.lit("auto").alias("strategy"),
            F.when(size > 0, F.array(block)).otherwise(F.array().cast(f"array<struct<{BLOCK}>>")).alias("blocks"), F.coalesce(F.col("refs.kept"), F.array()).cast(f"array<struct<{REF}>>").alias("page_refs"),
        )
        kept_pages = own.pages.join(pages.select(*PAGE_KEY), PAGE_KEY, "left_anti")
        paths = own.paths
        if "path" in files.columns:
            added = files.where("path is not null").select(checked_path(F.col("path")).alias("path"), "entry")
            before = own.paths.select("path", "flags")
            added = added.join(before, "path", "left").select("path", "entry", F.coalesce("flags", F.lit(0).cast("long")).alias("flags"))
            paths = own.paths.join(added.select("path"), "path", "left_anti").unionByName(added)
        file_rows = own.files.join(asked, "entry", "left_anti").unionByName(rows)
        tombs = own.tombstones.join(asked, "entry", "left_anti")
        self._swap(self._next(own, files=file_rows, pages=kept_pages.unionByName(pages), paths=paths, tombstones=tombs))

    def write_path(self, path: str, entry: int, data: bytes) -> None:
        self.write_files(self.spark.createDataFrame([(entry, bytearray(data), normalize(path))], "entry long, data binary, path string"))

    def delete_entry(self, entry: int) -> None:
        """A tombstone in the writable pack."""
        own = self._writable()
        row = self.spark.createDataFrame([(entry, own.version + 1, "deleted")], "entry long, version long, reason string")
        self._swap(self._next(own, tombstones=own.tombstones.where(F.col("entry") != entry).unionByName(row)))

    @staticmethod
    def _next(own: Pack, **tables) -> Pack:
        pack = own.with_(**tables)
        listed = pack.files.select(F.xxhash64("entry", "content_hash").cast("decimal(38,0)").alias("h")).agg(F.sum("h")).first()[0]
        facts = {"explicit_refs": True, "pack_version": own.version + 1, "build_id": own.manifest.get("build_id", 0) + 1, "file_count": pack.files.count(), "tombstone_count": pack.tombstones.count(), "content_hash": f"{int(listed or 0) & (1 << 256) - 1:x}"}
        return pack.with_(manifest=own.manifest | facts)

    # ----------------------------------------------------- the mount list itself

    def open(self, path: str) -> int:
        """Counts an open file; a volume with open files can't be closed."""
        entry = self.stat(path)[0]
        self._open += 1
        return entry

    def close_file(self) -> None:
        self._open -= 1

    def close(self) -> None:
        if self._open:
            raise Busy("open files")
        self.mounts = []

    def _manifest(self) -> dict:
        return {"mounts": [{"path": m.path, "priority": m.priority, "pack_id": m.pack.id, "pack_version": m.pack.version} for m in sorted(self.mounts, key=lambda m: m.number)]}

    def commit(self, root: str) -> int:
        """Stores the mount list: prepared, then committed, then the manifest."""
        before = fs.read_json(self.spark, f"{root}/volume.json") if fs.exists(self.spark, f"{root}/volume.json") else {"number": 0}
        if any(m.path is None for m in self.mounts):
            raise InvalidArgument("only stored packs can be committed")
        state = self._manifest() | {"number": before["number"] + 1}
        if problems := verify_mounts(self.spark, state):
            raise Corruption(str(problems))
        for step in ("prepared", "committed"):
            fs.write_json(self.spark, f"{root}/transaction.json", state | {"state": step})
        fs.write_json(self.spark, f"{root}/volume.json", state)
        return state["number"]


def _assemble(blocks: list[list[dict]], pages: list[list[dict] | None]) -> tuple[list[bytes | None], list[int]]:
    """The bytes of some files from what their blocks promise and the pages at
    hand; all pages of the batch are decoded and checked together."""
    chosen: list[list[dict | None]] = []
    for of_file, stored in zip(blocks, pages, strict=True):
        by_key: dict[tuple[int, int], dict] = {}
        for p in stored or []:
            if p["is_top"] or (p["block"], p["page"]) not in by_key:
                by_key[p["block"], p["page"]] = p
        found = [by_key.get((b, n)) for b, block in enumerate(of_file) for n in range(block["n"])]
        chosen.append([p if p and p["kind"] == "page" else None for p in found])
    flat = [p for file in chosen for p in file if p]
    raw = [codecs.decode(p["codec"], p["payload"], p["raw_size"]) for p in flat]
    for p, crc in zip(flat, crc32c_many(raw), strict=True):
        if p["raw_crc"] != int(crc):
            raise ChecksumMismatch("page")
    at, data, missing = 0, [], []
    for file in chosen:
        n = sum(p is not None for p in file)
        missing.append(len(file) - n)
        data.append(b"".join(raw[at : at + n]) if n == len(file) else None)
        at += n
    return data, missing


_PAGE = ["kind", "codec", "raw_size", "stored_size", "raw_crc", "stored_crc", "content_hash", "payload"]


def recover(spark: SparkSession, root: str) -> dict:
    """A committed transaction newer than the manifest is carried out, a
    prepared one is ignored; returns the manifest."""
    state = fs.read_json(spark, f"{root}/volume.json") if fs.exists(spark, f"{root}/volume.json") else None
    if fs.exists(spark, f"{root}/transaction.json"):
        tx = fs.read_json(spark, f"{root}/transaction.json")
        if tx.pop("state") == "committed" and tx["number"] > (state or {"number": 0})["number"]:
            fs.write_json(spark, f"{root}/volume.json", tx)
            state = tx
    if state is None:
        raise NotFound(root)
    return state


def verify_mounts(spark: SparkSession, manifest: dict) -> list[dict]:
    """Mounts whose pack is missing or has another id or version."""
    bad = []
    for m in manifest["mounts"]:
        try:
            pack = read_pack(spark, m["path"])
        except NotFound:
            bad.append(m | {"problem": "missing"})
            continue
        if (pack.id, pack.version) != (m["pack_id"], m["pack_version"]):
            bad.append(m | {"problem": "pack id or version"})
    return bad


def open_volume(spark: SparkSession, root: str) -> Volume:
    volume = Volume(spark)
    for m in recover(spark, root)["mounts"]:
        volume.mount(m["path"], m["priority"])
    return volume
