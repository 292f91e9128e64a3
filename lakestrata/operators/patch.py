"""Applying chains of diffs.

Steps of several diffs are folded first, so that every page is made once:
a later whole page or delete drops what came before it for that page; blocks
that any diff changes by a block delta are replayed as a whole. The result is a
new version of the pack, published by one pointer swap; a crash before that
leaves the old version and an intent, and the same patch can be run again.
"""

from __future__ import annotations

import hashlib
import heapq
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..errors import Cancelled, CodecMismatch, Corruption, InvalidArgument, NoPatchPath, PatchIntentMismatch, PreconditionFailed, StoreError
from ..functions import bindiff, codecs
from ..functions.checksums import crc32c, crc_sequence_hash
from ..sources import fs
from ..sources.pack import PAGES, TABLES, Pack, prune, publish, read_pack
from .diff import KIND_ORDER, Diff, read_diff
from .verify import only_entries, verify_pack

_PAGE = [c.split()[0] for c in PAGES.split(", ")]

# -------------------------------------------------------------------- chains


def select_chain(edges: list[tuple[int, int, int]], start: int, end: int) -> list[int]:
    """Indices of the edges (from, to, payload bytes) of the lightest path; each
    edge weighs its bytes and one more. Driver work: there are as many edges as
    diffs at hand."""
    if start == end:
        return []
    best, came, queue = {start: 0}, {}, [(0, start)]
    while queue:
        weight, at = heapq.heappop(queue)
        if at == end:
            chain = []
            while at != start:
                chain.append(came[at])
                at = edges[came[at]][0]
            return chain[::-1]
        if weight > best[at]:
            continue
        for i, (a, b, size) in enumerate(edges):
            if a == at and weight + size + 1 < best.get(b, float("inf")):
                best[b], came[b] = weight + size + 1, i
                heapq.heappush(queue, (best[b], b))
    raise NoPatchPath(f"{start} to {end}")


def choose(diffs: list[Diff], start: int, end: int) -> list[Diff]:
    if len({d.manifest["pack_id"] for d in diffs}) > 1:
        raise InvalidArgument("diffs of several packs")
    chain = [diffs[i] for i in select_chain([(d.manifest["base_version"], d.manifest["target_version"], d.manifest.get("payload_bytes", 0)) for d in diffs], start, end)]
    for a, b in zip(chain, chain[1:], strict=False):
        if a.manifest["target_version"] != b.manifest["base_version"] or a.manifest["target_content_hash"] != b.manifest["base_content_hash"]:
            raise PreconditionFailed("chain is not continuous")
    return chain


# ---------------------------------------------------------------------- folds


def order_steps(units: DataFrame) -> DataFrame:
    """Adds composite (a block delta is among the block's steps) and place, the
    order of a page's or, for composite blocks, a block's steps."""
    rank = F.lit(1)
    for kind, n in KIND_ORDER.items():
        rank = F.when(F.col("kind") == kind, n).otherwise(rank)
    block = Window.partitionBy("entry", "block")
    return units.withColumn("composite", F.max((F.col("kind") == "put_block_ldelta").cast("int")).over(block) == 1).withColumn("place", F.struct("reader", rank.alias("rank"), "page"))


def fold_pages(steps: DataFrame, key: list[str], order: str) -> DataFrame:
    """Steps of each page from its last reset (a whole page or a delete) on."""
    page = Window.partitionBy(*key)
    reset = F.max(F.when(F.col("kind").isin("put_page_raw", "delete_page"), F.col(order))).over(page)
    return steps.withColumn("_reset", reset).where(F.col("_reset").isNull() | (F.col(order) >= F.col("_reset"))).drop("_reset")


def fold_file_ops(ops: DataFrame) -> DataFrame:
    """The last operation for each (what it acts on, entry). ops has `reader`."""
    target = F.when(F.col("op").endswith("file_manifest"), "file").when(F.col("op").endswith("entry_tombstone"), "tombstone").otherwise("directory")
    rest = [c for c in ops.columns if c not in ("entry",)]
    return ops.withColumn("target", target).groupBy("target", "entry").agg(F.max_by(F.struct(*rest), "reader").alias("_last")).select("target", "entry", "_last.*")


def fold_paths(changes: DataFrame) -> DataFrame:
    """The last change for each path; within a diff, adds come after removes."""
    rest = [c for c in changes.columns if c != "path"]
    order = F.struct("reader", (F.col("op") == "add").cast("int"))
    return changes.groupBy("path").agg(F.max_by(F.struct(*rest), order).alias("_last")).select("path", "_last.*")


# --------------------------------------------------------------------- apply


def _made_page(step: dict, payload: bytes) -> dict:
    """The page that a step leaves, checked against what the step says of it."""
    if crc32c(payload) != step["stored_crc"] or len(payload) != step["stored_size"]:
        raise PreconditionFailed(f"page {step['entry']}/{step['block']}/{step['page']}: result")
    return {"entry": step["entry"], "block": step["block"], "page": step["page"], "kind": "page", "payload": payload, "shard": step["shard"]} | {c: step[c] for c in ("codec", "raw_size", "stored_size", "raw_crc", "stored_crc", "content_hash")}


def apply_page_step(page: dict | None, step: dict) -> dict | None:
    if step["kind"] == "delete_page":
        return None
    if step["kind"] == "put_page_raw":
        return _made_page(step, step["payload"])
    if page is None or page["stored_crc"] != step["old_stored_crc"]:
        raise PreconditionFailed(f"page {step['entry']}/{step['block']}/{step['page']}: old bytes")
    if step["codec"] != "none" and step["codec_tag"] != codecs.build_tag(step["codec"]):
        raise CodecMismatch(step["codec_tag"])
    return _made_page(step, bindiff.patch(page["payload"], step["payload"]))


def apply_page_chain(page: dict | None, steps: list[dict]) -> dict | None:
    """A page after its folded steps. If it already is what they lead to, it
    stays: a patch can be applied again."""
    last = steps[-1]
    if last["kind"] != "delete_page" and page is not None and page["stored_crc"] == last["stored_crc"] and page["content_hash"] == last["content_hash"]:
        return page
    for step in steps:
        page = apply_page_step(page, step)
    return page


def apply_block(pages: dict[int, dict], steps: list[dict]) -> dict[int, dict]:
    """Pages of a composite block after all its steps."""
    delta = next((s for s in reversed(steps) if s["kind"] == "put_block_ldelta"), None)
    if delta is not None and steps[-1] is delta and _fingerprint(pages) == (delta["crc_sequence"], delta["page_count"]):
        return pages
    for step in steps:
        if step["kind"] != "put_block_ldelta":
            made = apply_page_step(pages.get(step["page"]), step)
            pages = {k: v for k, v in pages.items() if k != step["page"]} | ({step["page"]: made} if made else {})
            continue
        raw, n = [], 0
        while n in pages:
            raw.append(codecs.decode(pages[n]["codec"], pages[n]["payload"], pages[n]["raw_size"], pages[n]["raw_crc"]))
            n += 1
        old = b"".join(raw)
        if not _is_block(old, step["old_block_hash"]):
            raise PreconditionFailed(f"block {step['entry']}/{step['block']}: old bytes")
        new = bindiff.patch(old, step["payload"])
        if not _is_block(new, step["new_block_hash"]):
            raise PreconditionFailed(f"block {step['entry']}/{step['block']}: result hash")
        pages = _cut(step, new) | {k: v for k, v in pages.items() if k >= step["page_count"]}
        if _fingerprint({k: v for k, v in pages.items() if k < step["page_count"]}) != (step["crc_sequence"], step["page_count"]):
            raise PreconditionFailed(f"block {step['entry']}/{step['block']}: result")
    return pages


def _is_block(raw: bytes, block_hash: str | None) -> bool:
    """Are these the bytes that a unit names? Units without a hash name none."""
    return block_hash is None or hashlib.sha256(raw).hexdigest() == block_hash


def _fingerprint(pages: dict[int, dict]) -> tuple[int, int]:
    return crc_sequence_hash([pages[k]["raw_crc"] for k in sorted(pages)]), len(pages)


def _cut(step: dict, raw: bytes) -> dict[int, dict]:
    if len(raw) != step["raw_size"]:
        raise PreconditionFailed("block size")

    out, size = {}, step["page_size"]
    for page in range(step["page_count"]):
        piece = raw[page * size : (page + 1) * size]
        codec, payload = codecs.encode(step["codec"], piece)
        out[page] = {
            "entry": step["entry"], "block": step["block"], "page": page, "kind": "page", "codec": codec, "raw_size": len(piece), "stored_size": len(payload), "raw_crc": crc32c(piece), "stored_crc": crc32c(payload),
            "content_hash": hashlib.sha256(piece).hexdigest(), "payload": payload, "shard": step["shard"],
        }
    return out


def _stacked(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.withColumn("reader", F.lit(i)) for i, t in enumerate(tables)])


@dataclass(frozen=True)
class Patched:
    """Pages that the units touch (before and after) and the folded rest."""

    touched: DataFrame
    written: DataFrame
    file_ops: DataFrame
    path_changes: DataFrame


def apply_units(pages: DataFrame, chain: list[Diff]) -> Patched:
    """pages: the visible pages before. written: the pages after, among those
    that the chain touches."""
    out = to_arrow_schema(StructType.fromDDL(PAGES))
    steps = order_steps(_stacked([d.units for d in chain]))
    current = pages.where("kind = 'page'")
    step = [c for c in steps.columns if c not in ("composite", "place")]

    single = fold_pages(steps.where("not composite"), ["entry", "block", "page"], "place")
    chains = single.groupBy("entry", "block", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*step).alias("s")))), lambda x: x["s"]).alias("steps"))
    old = current.select("entry", "block", "page", F.struct(*_PAGE).alias("old"))
    paired = chains.join(old, ["entry", "block", "page"], "left")

    def run_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [apply_page_chain(o, s) for o, s in zip(part.column("old").to_pylist(), part.column("steps").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist([m for m in made if m is not None], schema=out)

    whole = steps.where("composite").groupBy("entry", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*step).alias("s")))), lambda x: x["s"]).alias("steps"))
    of_blocks = current.join(whole.select("entry", "block"), ["entry", "block"], "left_semi").select(*_PAGE)
    held = of_blocks.groupBy("entry", "block").agg(F.collect_list(F.struct(*_PAGE)).alias("pages"))

    def run_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pages, todo in zip(batch.column("pages"), batch.column("steps"), strict=True):  # one block at a time
                made = apply_block({p["page"]: p for p in pages.as_py() or []}, todo.as_py())
                yield pa.RecordBatch.from_pylist([made[k] for k in sorted(made)], schema=out)

    blocks = whole.join(held, ["entry", "block"], "left").select("pages", "steps").mapInArrow(run_blocks, PAGES)
    touched = chains.select("entry", "block", "page").unionByName(of_blocks.select("entry", "block", "page"))
    return Patched(touched.distinct(), paired.select("steps", "old").mapInArrow(run_pages, PAGES).unionByName(blocks), fold_file_ops(_stacked([d.file_ops for d in chain])), fold_paths(_stacked([d.path_delta for d in chain])))


def apply_chain(pack: Pack, chain: list[Diff]) -> Pack:
    """The pack after the chain, in place: whole tables of a new version."""
    if not chain:
        return pack
    first, last = chain[0].manifest, chain[-1].manifest
    if (first["pack_id"], first["base_version"]) != (pack.id, pack.version) or first["base_content_hash"] != pack.manifest["content_hash"]:
        raise PreconditionFailed("the pack is not what the diff was made for")
    p = apply_units(pack.pages, chain)
    key = ["entry", "block", "page"]
    pages = pack.pages.join(p.touched, key, "left_anti").unionByName(p.written)
    files, tombs = _file_ops(pack, p.file_ops)
    paths = pack.paths.join(p.path_changes.select("path"), "path", "left_anti").unionByName(p.path_changes.where("op = 'add'").select("path", "entry", "flags"))
    manifest = pack.manifest | last["target"] | {"pack_version": last["target_version"], "content_hash": last["target_content_hash"]}
    return Pack(manifest, files, pages, paths, tombs)


def _file_ops(pack: Pack, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    of = lambda target: ops.where(F.col("target") == target)
    files = pack.files.join(of("file").select("entry"), "entry", "left_anti").unionByName(of("file").where("op = 'put_file_manifest'").select("file.*"))
    tombs = pack.tombstones.join(of("tombstone").select("entry"), "entry", "left_anti").unionByName(of("tombstone").where("op = 'put_entry_tombstone'").select("entry", "version", "reason"))
    return files, tombs


def apply_overlay(over: Pack, base: Pack, chain: list[Diff]) -> Pack:
    """The overlay after the chain: changed pages above the base, placeholders
    for deleted pages that the base still shows, tombstones for removed files.
    The overlay keeps the base version that it was made for."""
    from .overlay import resolve_pages
    from .volume import check_overlay

    if not chain:
        return over
    check_overlay(over, base)
    first, last = chain[0].manifest, chain[-1].manifest
    if (first["pack_id"], first["base_version"]) != (base.id, base.version) or first["base_content_hash"] != base.manifest["content_hash"]:
        raise PreconditionFailed("the base is not what the diff was made for")
    key = ["entry", "block", "page"]
    visible = resolve_pages(over.pages, base.pages, key).drop("layer").select(*_PAGE)
    p = apply_units(visible, chain)
    gone = p.touched.join(p.written, key, "left_anti").join(base.pages.where("kind = 'page'").select(*key, "shard"), key)
    holes = gone.select(*[(F.col(c) if c in (*key, "shard") else F.lit("placeholder") if c == "kind" else F.lit(None).cast(over.pages.schema[c].dataType)).alias(c) for c in _PAGE])
    pages = over.pages.join(p.touched, key, "left_anti").unionByName(p.written).unionByName(holes)
    files, tombs = _file_ops(over, p.file_ops)
    removed = p.file_ops.where("op = 'delete_file_manifest'").select("entry", F.lit(last["target_version"]).cast("long").alias("version"), F.lit("removed").alias("reason"))
    tombs = tombs.join(removed.select("entry"), "entry", "left_anti").unionByName(removed)
    back = p.file_ops.where("op = 'put_file_manifest'").select("entry")
    tombs = tombs.join(back, "entry", "left_anti")
    paths = over.paths.join(p.path_changes.select("path"), "path", "left_anti").unionByName(p.path_changes.where("op = 'add'").select("path", "entry", "flags"))
    manifest = over.manifest | {"content_version": last["target_version"], "content_hash": last["target_content_hash"]}
    return Pack(manifest, files, pages, paths, tombs)


# ------------------------------------------------------------------- sessions


@dataclass
class Report:
    from_version: int = 0
    to_version: int = 0
    diffs: int = 0
    units: int = 0
    pages_before: int = 0
    pages_after: int = 0
    file_ops: int = 0
    paths_added: int = 0
    paths_removed: int = 0
    payload_bytes: int = 0
    resumed: bool = False
    no_op: bool = False
    seconds: float = 0.0
    steps: list[str] = field(default_factory=list)


#: Points of a session at which `on_step` is called; raising there is a crash.
STEPS = ("intent", "pages", "publish", "done")


def patch_pack(
    spark: SparkSession, path: str, diff_paths: list[str], to_version: int | None = None, force: bool = False, verify: str = "none", on_step: Callable[[str], None] | None = None, owner: str | None = None,
) -> Report:
    """Brings the pack at a path to a version by the lightest chain of diffs.

    verify: none, touched (the entries that the chain touches) or full; it runs
    before the pointer moves.
    """
    if verify not in ("none", "touched", "full"):
        raise InvalidArgument(verify)
    began, report = time.time(), Report()

    def step(name: str) -> None:
        report.steps.append(name)
        if on_step:
            on_step(name)

    with fs.Lock(spark, f"{path}/patch.lock", owner or uuid.uuid4().hex):
        pack = read_pack(spark, path)
        diffs = [read_diff(spark, p) for p in diff_paths]
        intent_path = f"{path}/intent.json"
        intent = fs.read_json(spark, intent_path) if fs.exists(spark, intent_path) else None
        if to_version is None:
            to_version = intent["to_version"] if intent else max((d.manifest["target_version"] for d in diffs), default=pack.version)
        report.from_version, report.to_version = pack.version, to_version
        if pack.version == to_version:
            if intent:
                fs.delete(spark, intent_path)
            report.no_op, report.seconds = True, time.time() - began
            return report
        chain = choose(diffs, pack.version, to_version)
        now = {"from_version": pack.version, "to_version": to_version, "chain": [d.manifest["diff_id"] for d in chain]}
        if intent:
            same = {k: intent[k] for k in now} == now
            if not same and not (force and intent["to_version"] == to_version):
                raise PatchIntentMismatch(str(intent))
            report.resumed = True
        made = apply_chain(pack, chain)
        fs.write_json(spark, intent_path, now | {"started": int(began * 1000)})
        step("intent")
        name = uuid.uuid4().hex
        _stage(made, f"{path}/versions/{name}")
        step("pages")
        if verify != "none":
            staged = _staged(spark, made, f"{path}/versions/{name}")
            if verify == "touched":
                touched = _stacked([d.units.select("entry") for d in chain]).unionByName(_stacked([d.file_ops.select("entry") for d in chain]))
                staged = only_entries(staged, touched)
            bad = verify_pack(staged, counts=verify == "full").limit(1).collect()
            if bad:
                raise Corruption(str(bad[0].asDict()))
        step("publish")
        publish(spark, path, name)
        fs.delete(spark, intent_path)
        step("done")
        report.diffs = len(chain)
        report.units = sum(d.manifest["unit_count"] for d in chain)
        report.payload_bytes = sum(d.manifest["payload_bytes"] for d in chain)
        report.file_ops = sum(d.manifest["file_ops_count"] for d in chain)
        ops = {r.op: r["count"] for r in fold_paths(_stacked([d.path_delta for d in chain])).groupBy("op").count().collect()}
        report.paths_added, report.paths_removed = ops.get("add", 0), ops.get("remove", 0)
        report.pages_before, report.pages_after = pack.pages.count(), read_pack(spark, path).pages.count()
        report.seconds = time.time() - began
    return report


def _stage(pack: Pack, root: str) -> None:

    for table in TABLES:
        getattr(pack, table).write.parquet(f"{root}/{table}")
    fs.write_json(pack.files.sparkSession, f"{root}/manifest.json", pack.manifest)


def _staged(spark: SparkSession, pack: Pack, root: str) -> Pack:

    return Pack(pack.manifest, **{t: spark.read.schema(ddl).parquet(f"{root}/{t}") for t, ddl in TABLES.items()})


def recover_pack(spark: SparkSession, path: str, owner: str | None = None) -> str:
    """Ends a patch that a crash left: `finished` if its version is the current
    one, else `rolled back` (what it had staged goes, the version before holds,
    the patch can be run again); `clean` if there was none."""
    with fs.Lock(spark, f"{path}/patch.lock", owner or uuid.uuid4().hex):
        if not fs.exists(spark, f"{path}/intent.json"):
            return "clean"
        intent = fs.read_json(spark, f"{path}/intent.json")
        done = read_pack(spark, path).version == intent["to_version"]
        if not done:
            prune(spark, path)
        fs.delete(spark, f"{path}/intent.json")
        return "finished" if done else "rolled back"


class PatchTask:
    """A patch on a thread of its own: poll, wait, cancel."""

    def __init__(self, spark: SparkSession, path: str, diff_paths: list[str], **options):
        import threading

        self._cancel, self.report, self.error = threading.Event(), None, None
        self.step = "start"

        def check(name: str) -> None:
            self.step = name
            if self._cancel.is_set() and name != "done":
                raise Cancelled(name)

        def run() -> None:
            try:
                self.report = patch_pack(spark, path, diff_paths, on_step=check, **options)
            except StoreError as e:
                self.error = e

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def poll(self) -> str:
        return "running" if self._thread.is_alive() else "failed" if self.error else "done"

    def cancel(self) -> None:
        self._cancel.set()

    def wait(self) -> Report:
        self._thread.join()
        if self.error:
            raise self.error
        return self.report

    def end(self) -> None:
        self.cancel()
        self._thread.join()
