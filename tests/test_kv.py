import pytest
from pyspark.sql import functions as F

from lakestrata.errors import AlreadyExists, BatchClosed, BufferTooSmall, InvalidArgument, NotFound, PermissionDenied
from lakestrata.operators import kv_log
from lakestrata.operators.kv_store import KvStore
from lakestrata.sources import fs
from lakestrata.streaming import live_state


def test_put_get_delete_reopen(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    with KvStore.create(spark, path, shards=3) as db:
        db.put(b"a\0b", b"abc")
        assert db.get(b"a\0b") == b"abc" and db.info().pending_ops == 0  # reads commit first
        db.put(b"a\0b", b"abcdef")
        db.put(b"", b"empty key")
        assert db.size(b"a\0b") == 6
        with pytest.raises(BufferTooSmall):
            db.get(b"a\0b", limit=3)
        db.delete(b"a\0b")
        db.delete(b"never there")
    db = KvStore(spark, path, "read_only")
    with pytest.raises(NotFound):
        db.get(b"a\0b")
    assert db.get(b"") == b"empty key"
    states = db.state(spark.createDataFrame([(bytearray(k),) for k in (b"a\0b", b"", b"x")], "key binary"))
    assert {bytes(r.key): r.state for r in states.collect()} == {b"a\0b": "deleted", b"": "live", b"x": "unknown"}
    with pytest.raises(PermissionDenied):
        db.put(b"k", b"v")
    with pytest.raises(PermissionDenied):
        KvStore(spark, path, "write_only").get(b"")
    with pytest.raises(AlreadyExists):
        KvStore.create(spark, path)
    with pytest.raises(InvalidArgument):
        KvStore(spark, path).put(b"k", b"v", shard=3)


def test_batches_and_snapshots(spark, tmp_path):
    db = KvStore.create(spark, f"file://{tmp_path}/db")
    batch = db.batch()
    batch.put(b"k", b"one")
    with pytest.raises(NotFound):
        db.get(b"k")
    batch.commit()
    assert db.get(b"k") == b"one"
    with pytest.raises(BatchClosed):
        batch.put(b"k", b"two")
    lost = db.batch()
    lost.delete(b"k")
    lost.rollback()
    snapshot = db.snapshot()
    db.put(b"k", b"three")
    db.put(b"gone", b"x")
    db.discard()
    db.put(b"k", b"four")
    assert db.get(b"k") == b"four" and snapshot.get(b"k") == b"one" and snapshot.size(b"k") == 3
    with pytest.raises(NotFound):
        db.get(b"gone")


def test_checkpoint_optimize_recover_verify(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    db = KvStore.create(spark, path, shards=2)
    for key, value in ((b"a", b"old"), (b"b", b"b")):
        db.put(key, value)
    db.checkpoint()
    db.put(b"a", b"new-a")
    db.delete(b"b")
    db.put(b"c", b"new-c")
    db.checkpoint()
    live = lambda: {bytes(r.key): bytes(r.value) for r in db.scan().collect()}
    assert live() == {b"a": b"new-a", b"c": b"new-c"}
    assert db.verify().count() == 0
    before = db.info()
    db.optimize()
    assert live() == {b"a": b"new-a", b"c": b"new-c"} and db.info().log_entries <= before.log_entries and db.info().free_bytes == 0
    # an append whose writer died before the marker
    spark.range(1).write.parquet(f"{path}/log/torn")
    assert live() == {b"a": b"new-a", b"c": b"new-c"}
    assert db.recover() == []  # it may still be written
    assert db.recover(older_than=0) == ["torn"]
    many = spark.range(64).select(F.col("id").alias("n"), F.lit("put").alias("op"), F.col("id").cast("string").cast("binary").alias("key"), F.lit(b"v").alias("value"))
    db.write(many)
    assert db.info().key_count == 66 and db.scan().select("shard").distinct().count() == 2


def test_damage_is_reported(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    db = KvStore.create(spark, path)
    db.put(b"k", b"value")
    db.commit()
    name = fs.read_json(spark, f"{path}/commits/{1:020d}.json")["log"]
    rows = spark.read.parquet(f"{path}/log/{name}").withColumn("value", F.lit(b"VALUE")).collect()
    spark.createDataFrame(rows, "seq long, batch_id long, op string, key binary, value binary, flags long, shard int, version long, crc long").write.mode("overwrite").parquet(f"{path}/log/{name}")
    assert "checksum_mismatch" in {r.kind for r in db.verify().collect()}


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both saw the same last commit; the second append gets a number of its own."""
    import threading

    path = f"file://{tmp_path}/db"
    KvStore.create(spark, path)
    one, two = KvStore(spark, path), KvStore(spark, path)
    one.put(b"a", b"1")
    two.put(b"a", b"2")
    two.put(b"b", b"2")
    seen = two._last_commit
    last = seen()
    one.commit()
    two._last_commit = lambda: two.__dict__.pop("_last_commit") and last  # as it was before the other's commit
    assert two.commit() == last + 2
    assert {bytes(r.key): bytes(r.value) for r in KvStore(spark, path).scan().collect()} == {b"a": b"2", b"b": b"2"}
    assert KvStore(spark, path).log().select("seq").distinct().count() == 3 and KvStore(spark, path).verify().count() == 0

    def write(i):
        with KvStore(spark, path) as db:
            db.put(b"w%d" % i, b"v")

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert KvStore(spark, path).info().key_count == 8


def test_a_damaged_pointer_leaves_the_one_before(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    db = KvStore.create(spark, path)
    for i in range(3):
        db.put(b"k", b"%d" % i)
        db.checkpoint()
    newest = max(fs.slot_paths(f"{path}/CURRENT"), key=lambda s: fs.parse_slot(fs.read_bytes(spark, s))["epoch"])
    fs.write_bytes(spark, newest, b"{")
    again = KvStore(spark, path)
    assert again.get(b"k") == b"2" and {r.kind for r in again.verify().collect()} == {"invalid_superblock"}
    again.optimize()
    assert KvStore(spark, path).get(b"k") == b"2" and KvStore(spark, path).verify().count() == 0
    again.put(b"k", b"later")
    assert again.get(b"k") == b"later"


LOG = "seq long, batch_id long, op string, key string, value string, shard int"


def test_committed_filter(spark):
    rows = [
        (1, 0, "put", "a", "1", 0), (2, 7, "batch_begin", None, None, None), (3, 7, "put", "b", "2", 0), (4, 8, "put", "c", "3", 0), (5, 7, "batch_commit", None, None, None),
        (6, 9, "put", "d", "4", 0), (7, 9, "batch_commit", None, None, None), (8, 9, "batch_abort", None, None, None), (9, 8, "put", "a", "5", 0),
    ]
    log = spark.createDataFrame(rows, LOG)
    assert {(r.key, r.value) for r in kv_log.live(kv_log.committed(log)).collect()} == {("a", "1"), ("b", "2")}
    versions = spark.createDataFrame([(i, 0, op, "k", "v", 0) for i, op in enumerate(["put", "put", "delete", "put", "put"])], LOG)
    assert sorted((r.seq, r.version) for r in kv_log.versions(versions).collect()) == [(0, 1), (1, 2), (3, 1), (4, 2)]


def test_orphans_and_order(spark):
    record = "shard int, offset long, size long, key string, crc long, stored_crc long"
    records = spark.createDataFrame([(0, 0, 5, "live", 1, 1), (0, 5, 5, "live", 1, 1), (0, 10, 5, "lost", 1, 1), (0, 15, 5, "bad", 1, 2), (0, 20, 5, "hole", 1, 1)], record)
    index = spark.createDataFrame([(0, 5, "live"), (0, 99, "gone")], "shard int, offset long, key string")
    known, free = spark.createDataFrame([("live",)], "key string"), spark.createDataFrame([(0, 20, 5)], "shard int, offset long, size long")
    found = {(r.kind, r.key) for r in kv_log.verify(records, index, known, free).collect()}
    assert found == {("orphan_record", "lost"), ("checksum_mismatch", "bad"), ("dangling_index", "gone")}
    blocks = spark.createDataFrame([(0, 0, 5), (0, 5, 5), (0, 12, 3), (0, 13, 1)], "shard int, offset long, size long")
    assert sorted(map(tuple, kv_log.merge_intervals(blocks).collect())) == [(0, 0, 10), (0, 12, 3)]


def test_stream_follows_the_log(spark, tmp_path):
    source, target = f"file://{tmp_path}/log", f"file://{tmp_path}/state"
    parts = [[(1, "put", "a", "1"), (2, "put", "b", "2")], [(3, "delete", "a", None), (4, "put", "c", "3")], [(5, "put", "b", "4")]]
    schema = "seq long, op string, key string, value string"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        live_state.start(spark, source, schema, target).awaitTermination()
    want = {("b", "4"), ("c", "3")}
    assert {(r.key, r.value) for r in live_state.live_rows(spark, target).collect()} == want
    live_state.compact(spark, target)
    assert {(r.key, r.value) for r in live_state.live_rows(spark, target).collect()} == want
