"""python -m lakestrata.cli <command> ... — key/value stores, packs, diffs.

    kv create|put|get|delete|scan|dump|journal|verify|recover|checkpoint|optimize|info|bench <dir> [...]
    kv import <dir> <parquet of op, key, value>
    pack build <config> | dump|paths|pages|verify|recover|prune <dir>
    pack dump-file <dir> <entry> | extract <dir> <entry> <file>
    diff create <base> <target> <out> | dump|units|verify <diff>
    patch <pack> <diff>... [--to N] [--force] [--verify]
    bench-patch <pack> <diff>...
    overlay create <base> <out>
    volume verify|recover <dir> | put-file <writable pack> <entry> <path> <file>

Rows are printed one a line, all of them, tab-separated under a header.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import StoreError
from .operators import diff, kv_log, patch, verify, volume
from .operators.kv_store import KvStore
from .sources import config, fs, pack


def _print(df: DataFrame) -> int:
    """Every row, a partition at a time; returns their number."""
    print("\t".join(df.columns))
    n = 0
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else v.hex() if isinstance(v, (bytes, bytearray)) else str(v) for v in row))
        n += 1
    return n


def _timed(what: str, run: Callable[[], int]) -> None:
    """Prints seconds and a rate of what was done (a count of bytes)."""
    began = time.time()
    n = run()
    took = time.time() - began
    print(f"{what}: {took:.3f} s, {n / 2**20 / took:.1f} MiB/s")


def _kv(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.action == "create":
        KvStore.create(spark, a.path, int(a.rest[0]) if a.rest else 1)
        return 0
    mode = "read_only" if a.action in ("get", "scan", "dump", "journal", "verify", "info") else "read_write"
    with KvStore(spark, a.path, mode) as store:
        if a.action == "put":
            store.put(a.rest[0].encode(), a.rest[1].encode())
        elif a.action == "get":
            print(store.get(a.rest[0].encode()).decode(errors="replace"))
        elif a.action == "delete":
            store.delete(a.rest[0].encode())
        elif a.action == "import":
            rows = spark.read.parquet(a.rest[0])
            op = F.col("op") if "op" in rows.columns else F.lit("put")
            store.write(rows.select(F.monotonically_increasing_id().alias("n"), op.alias("op"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")))
        elif a.action == "scan":
            _print(store.scan().select(F.col("key").cast("string"), "seq", "shard", F.octet_length("value").alias("size")))
        elif a.action == "dump":
            _print(kv_log.fold(store.log()).select("key", "op", "seq", "shard", "flags", "crc", F.octet_length("value").alias("size")))
        elif a.action == "journal":
            _print(store.log().select("seq", "batch_id", "op", "key", "shard", "crc").orderBy("seq"))
        elif a.action == "info":
            print(store.info())
        elif a.action == "recover":
            print(len(store.recover()), "appends without a marker removed")
        elif a.action in ("checkpoint", "optimize"):
            getattr(store, a.action)()
        elif a.action == "verify":
            return int(_print(store.verify()) > 0)
        elif a.action == "bench":
            rows = spark.range(int(a.rest[0]) if a.rest else 100_000).select(F.col("id").alias("n"), F.lit("put").alias("op"), F.concat(F.lit("bench/"), "id").cast("binary").alias("key"), F.expr("repeat('v', 256)").cast("binary").alias("value"))
            _timed("write", lambda: (store.write(rows), rows.count() * 256)[1])
            _timed("scan", lambda: store.scan().agg(F.sum(F.octet_length("value"))).first()[0] or 0)
            _timed("verify", lambda: store.verify().count() * 0 + store.info().data_bytes)
    return 0


def _pack(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.action == "build":
        c = config.parse(fs.read_bytes(spark, a.path))
        files = config.with_sources(spark, config.plan(spark, c))
        result = pack.build_incremental(files, c.pack_path, c.pack_id, c.pack_version, c.shards)
        print(f"rebuilt={result.rebuilt} skipped={result.skipped}")
        return 0
    if a.action == "verify":
        return int(_print(verify.verify_stored(spark, a.path)) > 0)
    if a.action == "recover":
        print(patch.recover_pack(spark, a.path))
        return 0
    p = pack.read_pack(spark, a.path)
    if a.action == "dump":
        print(p.manifest)
        _print(p.files.select("entry", "version", "size", F.size("blocks").alias("blocks"), "content_hash"))
    elif a.action == "paths":
        _print(p.paths.orderBy("path"))
    elif a.action == "pages":
        _print(p.pages.drop("payload").orderBy("entry", "block", "page"))
    elif a.action == "dump-file":
        entry = F.col("entry") == int(a.rest[0], 0)
        for df in (p.files.where(entry).drop("blocks", "page_refs"), p.files.where(entry).select(F.inline("blocks")), p.files.where(entry).select(F.inline("page_refs")), p.pages.where(entry).drop("payload").orderBy("block", "page"), p.paths.where(entry)):
            _print(df)
    elif a.action == "prune":
        print(*pack.prune(spark, a.path), sep="\n")
    elif a.action == "extract":
        v = volume.Volume(spark)
        v.mount(p, 1)
        with open(a.rest[1], "wb") as f:
            f.write(v.read_entry(int(a.rest[0], 0)))
    return 0


def _diff(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.action == "create":
        base, target = (pack.read_pack(spark, p) for p in (a.path, a.rest[0]))
        print(diff.write_diff(diff.diff_packs(base, target), a.rest[1]).manifest)
        return 0
    d = diff.read_diff(spark, a.path)
    if a.action == "dump":
        print(d.manifest)
        _print(diff.statistics(d.units))
        return 0
    if a.action == "units":
        _print(d.units.select("kind", "entry", "block", "page", "flags", F.octet_length("payload").alias("payload_bytes")))
        return 0
    return int(_print(diff.verify_diff(d)) > 0)


def _volume(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.action == "put-file":
        v = volume.Volume(spark)
        v.mount_writable(a.path)
        with open(a.rest[2], "rb") as f:
            v.write_path(a.rest[1], int(a.rest[0], 0), f.read())
        return 0
    state = volume.recover(spark, a.path)
    bad = volume.verify_mounts(spark, state) if a.action == "verify" else []
    print(state if not bad else bad)
    return int(bool(bad))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("kind", choices=["kv", "pack", "diff", "patch", "bench-patch", "overlay", "volume"])
    parser.add_argument("action")
    parser.add_argument("path", nargs="?")
    parser.add_argument("rest", nargs="*")
    parser.add_argument("--to", type=int)
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--verify", action="store_true")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if a.kind == "patch":
            print(patch.patch_pack(spark, a.action, [p for p in [a.path, *a.rest] if p], a.to, a.force, "full" if a.verify else "none"))
            return 0
        if a.kind == "bench-patch":
            paths = [p for p in [a.path, *a.rest] if p]
            chain = [diff.read_diff(spark, p) for p in paths]
            size = sum(d.manifest["payload_bytes"] for d in chain)
            _timed("read diffs", lambda: (len([d.units.select("payload").write.format("noop").mode("overwrite").save() for d in chain]), size)[1])
            base = pack.read_pack(spark, a.action)
            _timed("apply", lambda: pack.decode_pages(patch.apply_chain(base, chain).pages).agg(F.sum(F.octet_length("raw"))).first()[0] or 0)
            return 0
        if a.kind == "overlay":
            base = pack.read_pack(spark, a.path)
            pack.write_pack(volume.create_overlay(spark, base), a.rest[0])
            return 0
        return {"kv": _kv, "pack": _pack, "diff": _diff, "volume": _volume}[a.kind](spark, a)
    except StoreError as e:
        print(f"{e.status}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
