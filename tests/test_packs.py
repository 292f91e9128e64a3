import shutil

import pytest
from pyspark.sql import functions as F

from lakestrata import cli
from lakestrata.errors import Busy, InvalidArgument, KeyCollision, NoPatchPath, NotFound, OverlayBaseMismatch, PatchIntentMismatch, PreconditionFailed, UnsupportedCodec, UnsupportedFeature
from lakestrata.operators import diff, patch, verify, volume
from lakestrata.sources import config, datasource, fs, pack

from .fixtures import INDEX, KEEP, OLD, PACK_ID, SILENT, TAKE, THUMBS, VERSIONS, files_of, inputs


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Three versions of a pack and the diffs between them, on disk."""
    root = f"file://{tmp_path_factory.mktemp('packs')}"
    packs = {v: pack.write_pack(pack.build_pack(inputs(spark, files_of(v)), PACK_ID, v, shards=2), f"{root}/v{v}") for v in VERSIONS}
    diffs = {(a, b): diff.write_diff(diff.diff_packs(packs[a], packs[b]), f"{root}/d{a}{b}") for a, b in ((1, 2), (2, 3), (1, 3))}
    return root, packs, diffs


def copy(root, name):
    shutil.copytree(root.removeprefix("file://") + "/v1", root.removeprefix("file://") + f"/{name}")
    return f"{root}/{name}"


def contents(p):
    rows = {}
    for t in ("files", "paths", "tombstones"):
        df = getattr(p, t)
        rows[t] = sorted(map(str, df.select(*sorted(df.columns)).collect()))
    pages = sorted((r.entry, r.block, r.page, bytes(r.raw)) for r in pack.decode_pages(p.pages).collect())
    return rows, pages, p.version, p.manifest["content_hash"]


def test_build(spark, world):
    _, packs, _ = world
    for v, p in packs.items():
        assert verify.verify_pack(p).count() == 0
        assert p.manifest["file_count"] == len(VERSIONS[v])
        assert {r.path for r in p.paths.collect()} == {f[0][1:] for f in files_of(v)}
    empty = packs[1].files.where(F.col("entry") == SILENT).first()
    assert empty.size == 0 and empty.blocks == [] and packs[1].pages.where(F.col("entry") == SILENT).count() == 0
    small = pack.build_pack(inputs(spark, [("x", 11, b"lantern", "none", 0)], page_size=3), 1, 1)
    assert [bytes(r.payload) for r in small.pages.orderBy("page").collect()] == [b"lan", b"ter", b"n"]


@pytest.mark.parametrize(
    ("files", "error"),
    [
        ([("a", 1, b"x", "none", 0), ("b", 1, b"y", "none", 0)], KeyCollision),
        ([("a", 1, b"x", "none", 0), ("/a", 2, b"y", "none", 0)], KeyCollision),
        ([("a", 0, b"x", "none", 0)], InvalidArgument),
        ([("a", 1, b"x", "zstd", 0)], UnsupportedCodec),
    ],
)
def test_build_errors(spark, files, error):
    with pytest.raises(error):
        pack.build_pack(inputs(spark, files), 1, 1)


def test_incremental_build(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    files = [("a", 1, b"x" * 100, "lz4", 1), ("b", 2, b"y", "none", 0)]
    build = lambda f: (lambda r: (r.rebuilt, r.skipped))(pack.build_incremental(inputs(spark, f), path, 5, 1))
    assert build(files) == (2, 0)
    assert build(files) == (0, 2)
    assert build([("a", 1, b"x" * 100, "lz4", 2), files[1]]) == (2, 0)
    assert build(files[:1]) == (1, 0)  # a removed file is a change
    assert build(files[:1]) == (0, 1)
    version = pack.current(spark, path)["version"]
    fs.delete(spark, f"{path}/cache/{version}")
    assert build(files[:1]) == (1, 0)  # so is a damaged cache
    assert len(pack.prune(spark, path)) >= 1 and pack.read_pack(spark, path).manifest["file_count"] == 1


def test_config(spark, tmp_path):
    (tmp_path / "src.bin").write_bytes(b"hello")
    text = f"# comment\npack_path=file://{tmp_path}/out\npack_id=0x7\nshards=2\ndefault_codec=lz4\nfile=/v/a.txt|10|{tmp_path}/src.bin\nfile=b|11|{tmp_path}/src.bin|4|none|0|page\n"
    c = config.parse(text.encode())
    rows = config.plan(spark, c).collect()
    assert [(r.path, r.page_size, r.codec, r.strategy) for r in rows] == [("v/a.txt", 65536, "lz4", "auto"), ("b", 4, "none", "page")]
    (tmp_path / "c.cfg").write_text(text)
    assert cli.main(["pack", "build", f"file://{tmp_path}/c.cfg"], spark) == 0
    assert cli.main(["pack", "verify", f"file://{tmp_path}/out"], spark) == 0
    assert cli.main(["pack", "extract", f"file://{tmp_path}/out", "11", f"{tmp_path}/x"], spark) == 0
    assert (tmp_path / "x").read_bytes() == b"hello"
    for bad in ("pack_path=x\n", "nonsense=1\n", "pack_path=x\nfile=a|1\n", "pack_path=x\nshards=0\nfile=a|1|b\n", "pack_path=x\nfile=a|1|b|4|rar\n"):
        with pytest.raises(InvalidArgument):
            config.parse(bad.encode())


def test_data_source(spark, world):
    root, packs, _ = world
    datasource.register(spark)
    raw = spark.read.format("strata_pack").load(f"{root}/v2")
    whole = raw.groupBy("entry").agg(F.sum(F.octet_length("raw")).alias("n"))
    assert {r.entry: r.n for r in whole.collect()} == {e: len(d) for e, d in VERSIONS[2].items()}
    assert spark.read.format("strata_pack").option("table", "paths").load(f"{root}/v2").count() == packs[2].paths.count()


# --------------------------------------------------------------------- volumes


def test_priorities_renames_and_tombstones(spark):
    low = pack.build_pack(inputs(spark, [("old", 5, b"low", "none", 0), ("same", 6, b"six", "none", 0)]), 1, 1)
    high = pack.build_pack(inputs(spark, [("new", 5, b"high", "none", 0)]), 2, 1)
    v = volume.Volume(spark)
    v.mount(low, 1)
    v.mount(high, 10)
    with pytest.raises(InvalidArgument):
        v.mount(pack.empty_pack(spark, 9, 1), 1)
    assert v.read("old") == v.read("new") == b"high" and v.read("same", 1) == b"ix" and v.read("same", 9) == b""
    grave = pack.empty_pack(spark, 3, 1).with_(tombstones=spark.createDataFrame([(5, 1, "x")], pack.TOMBSTONES))
    v.mount(grave, 20)
    for path in ("old", "new"):
        with pytest.raises(NotFound):
            v.read(path)
    assert {r.entry for r in v.contents().collect()} == {6}
    v.open("same")
    with pytest.raises(Busy):
        v.close()
    v.close_file()
    v.close()


def test_overlay_pages_and_placeholders(spark):
    base = pack.build_pack(inputs(spark, [("f", 7, b"redgreenblue", "none", 0)], page_size=4), 1, 4)
    over = volume.create_overlay(spark, base)
    page = pack.encode_pages(spark.createDataFrame([(7, 0, 1, "none", bytearray(b"RUST"))], "entry long, block int, page int, codec string, raw binary"))
    hole = spark.createDataFrame([(7, 0, 2, "placeholder", None, None, None, None, None, None, None, 0)], pack.PAGES)
    v = volume.Volume(spark)
    v.mount(base, 1)
    v.mount(over.with_(pages=page.unionByName(hole)), 5)
    assert v.read("f", 0, 8) == b"redgRUST"
    with pytest.raises(NotFound):
        v.read("f", 4, 8)
    assert v.contents().first().missing == 1
    with pytest.raises(InvalidArgument):
        v.mount(volume.create_overlay(spark, base), 9)
    newer = pack.build_pack(inputs(spark, [("f", 7, b"x", "none", 0)]), 1, 5)
    with pytest.raises(OverlayBaseMismatch):
        volume.check_overlay(over, newer)


def test_writable_pack(spark, tmp_path):
    base = pack.write_pack(pack.build_pack(inputs(spark, [("f", 7, b"ironzincgold", "none", 0), ("g", 8, b"gone", "none", 0)], page_size=4), 10, 1), f"file://{tmp_path}/base")
    v = volume.Volume(spark)
    v.mount(f"file://{tmp_path}/base", 1)
    v.mount_writable(f"file://{tmp_path}/w", 1, page_size=4)
    v.write_files(spark.createDataFrame([(7, bytearray(b"ironLEADgold"))], "entry long, data binary"))
    assert v.read("f") == b"ironLEADgold"
    refs = v._writable().files.where("entry = 7").first().page_refs
    assert [r.pack_id for r in refs] == [10, 1, 10] and v._writable().pages.count() == 1
    v.delete_entry(8)
    with pytest.raises(NotFound):
        v.read("g")
    v.write_path("g", 8, b"back")
    assert v.read("g") == b"back"
    v.commit(f"file://{tmp_path}/vol")
    again = volume.open_volume(spark, f"file://{tmp_path}/vol")
    assert again.read("f", 4, 4) == b"LEAD"
    state = volume.recover(spark, f"file://{tmp_path}/vol")
    for step, number in (("prepared", 1), ("committed", 2)):
        fs.write_json(spark, f"file://{tmp_path}/vol/transaction.json", state | {"number": 2, "state": step})
        assert volume.recover(spark, f"file://{tmp_path}/vol")["number"] == number
    assert volume.verify_mounts(spark, {"mounts": [{"path": f"file://{tmp_path}/base", "pack_id": 10, "pack_version": 2}]})
    only = volume.Volume(spark)
    only.mount(f"file://{tmp_path}/w", 1)  # the pack that it refers to is not mounted
    with pytest.raises(NotFound):
        only.read_entry(7)
    assert base.id == 10


# ----------------------------------------------------------------------- diffs


def test_diff_facts(world):
    _, _, diffs = world
    units = {(r.kind, r.entry, r.page) for r in diffs[1, 2].units.select("kind", "entry", "page").collect()}
    assert ("put_block_ldelta", INDEX, 0) in units and ("delete_page", OLD, 0) in units and {e for _, e, _ in units if e == KEEP} == set()
    assert all(f.flags & diff.NEW_BLOCK for f in diffs[1, 2].units.where(F.col("entry") == TAKE).collect())
    ops = [r.op for r in diffs[1, 2].file_ops.collect()]
    assert ops.count("put_file_manifest") == 4 and ops.count("delete_file_manifest") == 1
    assert sorted((r.op, r.path) for r in diffs[1, 2].path_delta.collect()) == [("add", "audio/take.pcm"), ("remove", "notes/old.txt")]
    assert ("delete_page", INDEX, 2) in {(r.kind, r.entry, r.page) for r in diffs[2, 3].units.collect()}
    for d in diffs.values():
        assert diff.verify_diff(d).count() == 0
        stats = diff.statistics(d.units).agg(F.sum("units").alias("n"), F.sum("payload_bytes").alias("b")).first()
        assert (stats.n, stats.b) == (d.manifest["unit_count"], d.manifest["payload_bytes"])


def test_diff_errors(spark, world):
    _, packs, _ = world
    with pytest.raises(InvalidArgument):
        diff.diff_packs(packs[1], packs[1])
    ref = packs[2].files.withColumn("page_refs", F.array(F.struct(*[F.lit(1).cast(t.split(":")[1]).alias(t.split(":")[0]) for t in pack.REF.split(",")])))
    with pytest.raises(UnsupportedFeature):
        diff.diff_packs(packs[1], packs[2].with_(files=ref))


@pytest.mark.parametrize("strategy", ["page", "replace"])
def test_other_strategies(spark, world, strategy):
    _, packs, _ = world
    target = pack.build_pack(inputs(spark, files_of(3), strategy=strategy), PACK_ID, 3, shards=2)
    d = diff.diff_packs(packs[1], target)
    kinds = {r.kind for r in d.units.select("kind").distinct().collect()}
    assert ("put_page_pdelta" in kinds) == (strategy == "page") and "put_block_ldelta" not in kinds
    assert contents(patch.apply_chain(packs[1], [d]))[1] == contents(target)[1]


# --------------------------------------------------------------------- patches


def test_patched_equals_built(spark, world):
    root, packs, _ = world
    one = copy(root, "one")
    for to, d in ((2, "d12"), (3, "d23")):
        report = patch.patch_pack(spark, one, [f"{root}/{d}"], verify="full")
        assert report.to_version == to and contents(pack.read_pack(spark, one)) == contents(packs[to])
    merged = copy(root, "merged")
    assert patch.patch_pack(spark, merged, [f"{root}/d12", f"{root}/d23"], 3, verify="touched").diffs == 2
    assert pack.read_pack(spark, merged).manifest["directory"] == {"directory_count": 3, "file_count": 6, "flags": 0}
    assert contents(pack.read_pack(spark, merged)) == contents(packs[3])
    best = copy(root, "best")
    assert patch.patch_pack(spark, best, [f"{root}/{d}" for d in ("d12", "d23", "d13")]).diffs == 1
    assert contents(pack.read_pack(spark, best)) == contents(packs[3])
    assert patch.patch_pack(spark, best, [f"{root}/d13"]).no_op


def test_overlay_patch(spark, world):
    root, packs, diffs = world
    over = patch.apply_overlay(volume.create_overlay(spark, packs[1]), packs[1], [diffs[1, 2], diffs[2, 3]])
    v = volume.Volume(spark)
    v.mount(packs[1], 1)
    v.mount(over, 5)
    assert {r.entry: bytes(r.data) for r in v.contents().collect()} == VERSIONS[3]
    assert verify.verify_pack(over, packs[1]).count() == 0


def test_crashes_and_resume(spark, world):
    root, packs, _ = world

    class Crash(Exception):
        pass

    for step in patch.STEPS[:-1]:
        path = copy(root, f"crash-{step}")

        def fail(name, step=step):
            if name == step:
                raise Crash

        with pytest.raises(Crash):
            patch.patch_pack(spark, path, [f"{root}/d12"], on_step=fail)
        assert contents(pack.read_pack(spark, path)) == contents(packs[1])
        with pytest.raises(PatchIntentMismatch):
            patch.patch_pack(spark, path, [f"{root}/d13"], 3)
        assert "patch_in_progress" in {r.kind for r in verify.verify_stored(spark, path).collect()}
        back = copy(root, f"back-{step}")
        shutil.rmtree(back.removeprefix("file://"))
        shutil.copytree(path.removeprefix("file://"), back.removeprefix("file://"))
        assert patch.recover_pack(spark, back) == "rolled back" and patch.recover_pack(spark, back) == "clean"
        assert contents(pack.read_pack(spark, back)) == contents(packs[1]) and verify.verify_stored(spark, back).count() == 0
        report = patch.patch_pack(spark, path, [f"{root}/d12"])
        assert report.resumed and contents(pack.read_pack(spark, path)) == contents(packs[2])
        assert not fs.exists(spark, f"{path}/intent.json")


def test_preconditions(spark, world):
    root, packs, diffs = world
    path = copy(root, "pre")
    with pytest.raises(NoPatchPath):
        patch.patch_pack(spark, path, [f"{root}/d23"], 3)
    with fs.Lock(spark, f"{path}/patch.lock", "me"), pytest.raises(Busy):
        patch.patch_pack(spark, path, [f"{root}/d12"])
    with pytest.raises(PreconditionFailed):
        patch.apply_chain(packs[1].with_(manifest=packs[1].manifest | {"content_hash": "forged"}), [diffs[1, 2]])
    tampered = packs[1].with_(pages=packs[1].pages.withColumn("payload", F.when(F.col("entry") == THUMBS, F.concat(F.lit(b"!"), F.expr("substring(payload, 2)"))).otherwise(F.col("payload"))))
    with pytest.raises(Exception, match="(?i)checksum|precondition|corruption"):
        patch.apply_chain(tampered, [diffs[1, 2]]).pages.where(F.col("entry") == THUMBS).collect()
    task = patch.PatchTask(spark, path, [f"{root}/d12"])
    assert task.wait().to_version == 2 and task.poll() == "done"


def test_chains():
    edges = [(1, 2, 100), (2, 3, 100), (1, 3, 500), (3, 4, 10)]
    assert patch.select_chain(edges, 1, 3) == [0, 1] and patch.select_chain(edges, 1, 4) == [0, 1, 3] and patch.select_chain(edges, 2, 2) == []
    edges[2] = (1, 3, 150)
    assert patch.select_chain(edges, 1, 3) == [2]
    with pytest.raises(NoPatchPath):
        patch.select_chain(edges, 4, 1)


# ---------------------------------------------------------------- verification


def test_every_damage_has_its_kind(spark, world):
    _, packs, _ = world
    p = packs[2]
    key = F.col("entry")
    block = lambda **change: F.transform("blocks", lambda b: F.struct(*[change.get(c, b[c]).alias(c) for c in (x.split(":")[0] for x in pack.BLOCK.split(","))]))
    damage = {
        "page_missing": p.with_(pages=p.pages.where(f"not (entry = {INDEX} and page = 1)")),
        "orphan_page": p.with_(pages=p.pages.unionByName(p.pages.where(f"entry = {KEEP}").withColumn("entry", F.lit(999).cast("long")))),
        "page_invalid": p.with_(pages=p.pages.withColumn("payload", F.when(key == THUMBS, F.concat("payload", F.lit(b"x"))).otherwise(F.col("payload")))),
        "page_key_mismatch": p.with_(pages=p.pages.unionByName(p.pages.where(f"entry = {KEEP}"))),
        "file_manifest_missing": p.with_(files=p.files.where(f"entry <> {KEEP}")),
        "file_manifest_shape_invalid": p.with_(files=p.files.withColumn("blocks", F.when(key == INDEX, block(page_count=F.lit(9))).otherwise(F.col("blocks")))),
        "duplicate_file_entry": p.with_(paths=p.paths.unionByName(p.paths.where(f"entry = {KEEP}").withColumn("path", F.lit("zz")))),
        "path_index_invalid": p.with_(paths=p.paths.withColumn("path", F.when(key == KEEP, F.lit("/notes/keep.txt")).otherwise(F.col("path")))),
        "manifest_file_count_mismatch": p.with_(manifest=p.manifest | {"file_count": 99}),
        "manifest_tombstone_count_mismatch": p.with_(manifest=p.manifest | {"tombstone_count": 1}),
        "pack_manifest_invalid": p.with_(manifest=p.manifest | {"pack_version": 0}),
        "patch_in_progress": p.with_(manifest=p.manifest | {"patch_in_progress": True}),
        "placeholder_in_non_overlay": p.with_(pages=p.pages.withColumn("kind", F.when(key == KEEP, "placeholder").otherwise(F.col("kind")))),
        "unknown_object": p.with_(pages=p.pages.withColumn("kind", F.when(key == KEEP, "what").otherwise(F.col("kind")))),
    }
    assert set(damage) <= set(verify.ISSUE_KINDS)
    for kind, broken in damage.items():
        assert kind in {r.kind for r in verify.verify_pack(broken).select("kind").distinct().collect()}, kind


def test_damage_within_compressed_pages_and_shared_pages(spark, world):
    """Pages are decoded: facts of the raw page that do not hold are found, and
    so are references that tell another page."""
    _, packs, _ = world
    p = packs[2]
    one = (F.col("entry") == INDEX) & (F.col("page") == 1)
    found = lambda broken, base=None: {(r.kind, r.entry, r.page) for r in verify.verify_pack(broken, base).collect()}
    for column, wrong in (("raw_crc", F.col("raw_crc") + 1), ("content_hash", F.sha2(F.lit("x"), 256)), ("raw_size", F.col("raw_size") + 1), ("stored_crc", F.col("stored_crc") + 1), ("codec", F.lit("none")), ("codec", F.lit("rar"))):
        assert found(p.with_(pages=p.pages.withColumn(column, F.when(one, wrong).otherwise(F.col(column))))) == {("page_invalid", INDEX, 1)}, column
    ref = F.struct(*[v.cast(t).alias(n) for (n, t), v in zip([x.split(":") for x in pack.REF.split(",")], (F.lit(PACK_ID), F.lit(2), F.lit(KEEP), F.lit(0), F.lit(0), F.lit(5), F.lit("?")), strict=True)])
    block = F.transform("blocks", lambda b: F.struct(*[(F.lit(pack.EXPLICIT_REFS).cast("long") if c == "flags" else b[c]).alias(c) for c in (x.split(":")[0] for x in pack.BLOCK.split(","))]))
    shares = F.col("entry") == TAKE
    shared = p.with_(files=p.files.withColumn("page_refs", F.when(shares, F.array_repeat(ref, 2)).otherwise(F.col("page_refs"))).withColumn("blocks", F.when(shares, block).otherwise(F.col("blocks"))))
    assert found(shared) == {("page_ref_hash_mismatch", KEEP, 0), ("orphan_page", TAKE, 0), ("orphan_page", TAKE, 1)}


def test_verify_a_pack_on_disk(spark, world, tmp_path):
    root, packs, _ = world
    kinds = lambda path, **more: {r.kind for r in verify.verify_stored(spark, path, **more).collect()}
    path = copy(root, "stored")
    local = path.removeprefix("file://")
    assert kinds(path) == set() and kinds(path, expect=(PACK_ID, 9)) == {"pack_manifest_key_mismatch"}
    fs.write_json(spark, f"{path}/intent.json", {})
    assert kinds(path) == {"patch_in_progress"}
    fs.delete(spark, f"{path}/intent.json")
    pack.write_pack(packs[2], path)
    slots = [s for s in fs.slot_paths(f"{path}/CURRENT") if fs.exists(spark, s)]
    newest = max(slots, key=lambda s: fs.parse_slot(fs.read_bytes(spark, s))["epoch"])
    fs.write_bytes(spark, newest, b"torn")
    assert pack.read_pack(spark, path).version == 1 and kinds(path) == {"db_verify_failed"}  # the version before holds
    version = f"{local}/versions/{pack.current(spark, path)['version']}"
    for table, kind in (("paths", "path_index_missing"), ("tombstones", "object_read_failed"), ("files", "file_manifest_missing")):
        shutil.move(f"{version}/{table}", f"{tmp_path}/{table}")
        assert kind in kinds(path)
        shutil.move(f"{tmp_path}/{table}", f"{version}/{table}")
    import glob

    with open(glob.glob(f"{version}/pages/*.parquet")[0], "r+b") as f:
        f.truncate(100)
    assert "object_read_failed" in kinds(path)
    shutil.rmtree(version)
    assert "pack_manifest_missing" in kinds(path)


def test_commands_print_everything(spark, world, tmp_path, capsys):
    root, packs, _ = world
    out = lambda *argv: (cli.main(list(argv), spark), capsys.readouterr().out.splitlines())
    code, lines = out("pack", "pages", f"{root}/v3")
    assert code == 0 and len(lines) == 1 + packs[3].pages.count()
    assert len(out("diff", "units", f"{root}/d12")[1]) == 1 + diff.read_diff(spark, f"{root}/d12").units.count()
    assert out("pack", "verify", f"{root}/v3")[0] == 0
    assert any(str(INDEX) in x for x in out("pack", "dump-file", f"{root}/v3", str(INDEX))[1])
    db = f"file://{tmp_path}/db"
    assert out("kv", "create", db)[0] == 0 and len(out("kv", "bench", db, "1500")[1]) == 3
    assert len(out("kv", "scan", db)[1]) == 1501 and len(out("kv", "dump", db)[1]) == 1501 and out("kv", "verify", db) == (0, ["kind\tshard\toffset\tkey"])
    assert len(out("bench-patch", f"{root}/v1", f"{root}/d12")[1]) == 2
    (tmp_path / "f").write_bytes(b"of the caller")
    assert out("volume", "put-file", f"file://{tmp_path}/w", "7", "a/b", str(tmp_path / "f"))[0] == 0
    assert out("pack", "extract", f"file://{tmp_path}/w", "7", str(tmp_path / "g"))[0] == 0 and (tmp_path / "g").read_bytes() == b"of the caller"


def test_blocks_and_diffs_that_do_not_fit(spark, world):
    _, packs, diffs = world
    d = diffs[1, 2]
    delta = F.col("kind") == "put_block_ldelta"
    for column in ("old_block_hash", "new_block_hash"):
        forged = diff.Diff(d.manifest, d.units.withColumn(column, F.when(delta, F.sha2(F.lit("other"), 256)).otherwise(F.col(column))), d.file_ops, d.path_delta)
        with pytest.raises(Exception, match="(?i)block .*(old bytes|result hash)"):
            patch.apply_chain(packs[1], [forged]).pages.collect()
    short = diff.Diff(d.manifest | {"unit_count": 1}, d.units.unionByName(d.units.where(delta)), d.file_ops, d.path_delta)
    assert {r.kind for r in diff.verify_diff(short).collect()} == {"duplicate_unit", "unit_count_mismatch", "payload_bytes_mismatch"}
