"""A durable key/value store on a directory.

    log/<batch>/      one Parquet append per commit
    commits/<n>       a marker per commit; without it an append does not exist
    base/<n>/         a folded snapshot, made by checkpoint or optimize
    CURRENT.A, .B     which base holds, and up to which commit: two slots with
                      a CRC, used in turn; a damaged one leaves the one before

Writers stage operations and commit them in one append; readers fold the base
and the committed log. Reads on a writable store commit staged operations
first, so a writer sees its own writes. A marker is made exclusively: of two
writers that want one number the second numbers its append anew, so no batch
is lost.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AlreadyExists, BatchClosed, BufferTooSmall, InvalidArgument, NotFound, PermissionDenied
from ..functions.checksums import crc32c_column
from ..sources import fs
from . import kv_log

LOG = "seq long, batch_id long, op string, key binary, value binary, flags long, shard int, version long, crc long"
_COLUMNS = [c.split()[0] for c in LOG.split(", ")]
STAGED = "n long, op string, key binary, value binary, flags long, shard int"
MODES = ("read_only", "write_only", "read_write")
DURABILITY = ("none", "async", "sync")  # fixed order, the strongest last


@dataclass(frozen=True)
class Info:
    key_count: int
    data_bytes: int
    log_entries: int
    pending_ops: int
    free_bytes: int
    shards: int


class KvStore:
    def __init__(self, spark: SparkSession, path: str, mode: str = "read_write"):
        if mode not in MODES:
            raise InvalidArgument(mode)
        self.spark, self.path, self.mode = spark, path, mode
        self.config = fs.read_json(spark, f"{path}/store.json")
        self.shards = self.config["shards"]
        self._staged: list[tuple] = []
        self._durability = "none"
        self.closed = False

    @classmethod
    def create(cls, spark: SparkSession, path: str, shards: int = 1) -> KvStore:
        if not 1 <= shards <= 256:
            raise InvalidArgument("1 to 256 shards")
        if fs.exists(spark, f"{path}/store.json"):
            raise AlreadyExists(path)
        fs.write_json(spark, f"{path}/store.json", {"shards": shards})
        fs.write_pointer(spark, f"{path}/CURRENT", {"base": None, "commit": 0, "epoch": 1})
        return cls(spark, path)

    def __enter__(self) -> KvStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Commits what is staged."""
        if not self.closed and self.mode != "read_only":
            self.commit()
        self.closed = True

    # ---------------------------------------------------------------- access

    def _need(self, what: str) -> None:
        if self.closed or self.mode not in (f"{what}_only", "read_write"):
            raise PermissionDenied(what)

    def _check_shard(self, shard: int | None) -> int | None:
        if shard is not None and not 0 <= shard < self.shards:
            raise InvalidArgument(f"shard {shard}")
        return shard

    # ---------------------------------------------------------------- writes

    def put(self, key: bytes, value: bytes, flags: int = 0, shard: int | None = None, durability: str = "none") -> None:
        self._need("write")
        self._staged.append(("put", bytes(key), bytes(value), flags, self._check_shard(shard)))
        self._durability = max(self._durability, durability, key=DURABILITY.index)

    def delete(self, key: bytes, shard: int | None = None, durability: str = "none") -> None:
        """Deleting a key that is not there is fine."""
        self._need("write")
        self._staged.append(("delete", bytes(key), None, 0, self._check_shard(shard)))
        self._durability = max(self._durability, durability, key=DURABILITY.index)

    def discard(self) -> None:
        self._staged, self._durability = [], "none"

    def commit(self, durability: str | None = None) -> int:
        """Publishes the staged operations as one batch; returns its number."""
        self._need("write")
        durability = durability or self._durability
        if durability not in DURABILITY:
            raise InvalidArgument(durability)
        ops, self._staged, self._durability = self._staged, [], "none"
        return self._append(self._rows(ops), durability) if ops else self._last_commit()

    def _rows(self, ops: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame([(i, op, bytearray(k), None if v is None else bytearray(v), f, s) for i, (op, k, v, f, s) in enumerate(ops)], STAGED)

    def write(self, ops: DataFrame, durability: str = "none") -> int:
        """A bulk batch: ops(n, op, key, value[, flags, shard]); n is the order."""
        self._need("write")
        self.commit()
        if "flags" not in ops.columns:
            ops = ops.withColumn("flags", F.lit(0).cast("long"))
        if "shard" not in ops.columns:
            ops = ops.withColumn("shard", F.lit(None).cast("int"))
        wrong = ops.where(f"op not in ('put', 'delete') or key is null or (op = 'put' and value is null) or shard < 0 or shard >= {self.shards}")
        if wrong.limit(1).count():
            raise InvalidArgument("operation, key, value or shard")
        return self._append(ops, durability)

    def _append(self, ops: DataFrame, durability: str) -> int:
        """Data first, the marker last: without it nothing is visible."""
        number, name = self._last_commit() + 1, uuid.uuid4().hex
        numbered = lambda rows, n: rows.select(
            (F.lit(n).cast("long") * F.lit(1 << 40) + F.col("n")).alias("seq"), F.lit(n).cast("long").alias("batch_id"), *_COLUMNS[2:]
        )
        rows = ops.select(
            "n", "op", "key", "value", F.col("flags").cast("long").alias("flags"), F.coalesce("shard", kv_log.route(F.col("key"), self.shards)).cast("int").alias("shard"),
            F.lit(None).cast("long").alias("version"), crc32c_column(F.col("value")).alias("crc"),
        )
        numbered(rows, number).repartition("shard").sortWithinPartitions("seq").write.parquet(f"{self.path}/log/{name}")
        while not self._mark(number, name, durability):
            old, number, renamed = number, self._last_commit() + 1, uuid.uuid4().hex
            again = self.spark.read.schema(LOG).parquet(f"{self.path}/log/{name}").withColumn("n", F.col("seq") - F.lit(old) * F.lit(1 << 40))
            numbered(again, number).write.parquet(f"{self.path}/log/{renamed}")
            fs.delete(self.spark, f"{self.path}/log/{name}")
            name = renamed
        return number

    def _mark(self, number: int, name: str, durability: str) -> bool:
        """Makes the marker of a commit; False if another writer has the number."""
        return fs.write_new(self.spark, f"{self.path}/commits/{number:020d}.json", json.dumps({"log": name, "durability": durability}).encode())

    def _commits(self) -> list[int]:
        return [int(n.split(".")[0]) for n in fs.listing(self.spark, f"{self.path}/commits") if n.endswith(".json")]

    def _current(self) -> dict:
        """The newest pointer that is whole and whose base is there."""
        return fs.read_pointer(self.spark, f"{self.path}/CURRENT", lambda v: v["base"] is None or fs.exists(self.spark, f"{self.path}/base/{v['base']}"))

    def _last_commit(self) -> int:
        return max([self._current()["commit"], *self._commits()])

    def batch(self, shard: int | None = None) -> Batch:
        self._need("write")
        return Batch(self, self._check_shard(shard))

    # ----------------------------------------------------------------- reads

    def log(self, upto: int | None = None) -> DataFrame:
        """Base and committed appends as log rows, up to a commit."""
        current = self._current()
        parts = []
        if current["base"] and (upto is None or upto >= current["commit"]):
            parts.append(self.spark.read.schema(LOG).parquet(f"{self.path}/base/{current['base']}"))
        since = current["commit"] if parts else 0
        names = [fs.read_json(self.spark, f"{self.path}/commits/{n:020d}.json")["log"] for n in self._commits() if n > since and (upto is None or n <= upto)]
        if names:
            parts.append(self.spark.read.schema(LOG).parquet(*[f"{self.path}/log/{n}" for n in names]))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], LOG)

    def _ready(self) -> None:
        self._need("read")
        if self._staged:
            self.commit()

    def scan(self) -> DataFrame:
        """All live rows."""
        self._ready()
        return kv_log.live(self.log())

    def get(self, key: bytes, limit: int | None = None) -> bytes:
        self._ready()
        row = kv_log.get(self.log(), bytearray(key)).select("value").first()
        if row is None:
            raise NotFound(repr(key))
        if limit is not None and len(row.value) > limit:
            raise BufferTooSmall(str(len(row.value)))
        return bytes(row.value)

    def size(self, key: bytes) -> int:
        self._ready()
        row = kv_log.get(self.log(), bytearray(key)).select(F.octet_length("value").alias("n")).first()
        if row is None:
            raise NotFound(repr(key))
        return row.n

    def get_many(self, keys: DataFrame) -> DataFrame:
        self._ready()
        return kv_log.get_many(self.log(), keys).select(*keys.columns, "value")

    def state(self, keys: DataFrame) -> DataFrame:
        self._ready()
        return kv_log.key_state(self.log(), keys)

    def snapshot(self) -> Snapshot:
        self._ready()
        return Snapshot(self, self._last_commit())

    def info(self) -> Info:
        pending = len(self._staged)
        size = F.coalesce(F.octet_length("value"), F.lit(0)).cast("long")
        rows = self.log()
        total = kv_log.shard_stats(rows, size).agg(F.sum("entries").alias("n"), F.sum("data_bytes").alias("d"), F.sum("live_keys").alias("k"), F.sum("live_bytes").alias("b")).first()
        return Info(total.k or 0, total.d or 0, total.n or 0, pending, (total.d or 0) - (total.b or 0), self.shards)

    # ----------------------------------------------------------- maintenance

    def checkpoint(self) -> None:
        """Folds everything committed into a base; the log stays."""
        self._rebase(drop_log=False)

    def optimize(self) -> None:
        """As checkpoint, and deletes the log and bases that no one needs."""
        self._rebase(drop_log=True)

    def _rebase(self, drop_log: bool) -> None:
        self._need("write")
        self.commit()
        last, name = self._last_commit(), uuid.uuid4().hex
        # Without the log behind it a base needs no tombstones.
        rows = kv_log.live(self.log(last)) if drop_log else kv_log.fold(self.log(last))
        rows.select(*_COLUMNS).repartition("shard").sortWithinPartitions("key").write.parquet(f"{self.path}/base/{name}")
        current = self._current()
        fs.write_pointer(self.spark, f"{self.path}/CURRENT", {"base": name, "commit": last, "epoch": current["epoch"] + 1})
        if drop_log:  # the pointer before this one, and what it reads, goes with the log
            fs.write_pointer(self.spark, f"{self.path}/CURRENT", {"base": name, "commit": last, "epoch": current["epoch"] + 2})
            for n in self._commits():
                if n < last:  # the last marker stays, so that its number is not given again
                    fs.delete(self.spark, f"{self.path}/log/{fs.read_json(self.spark, f'{self.path}/commits/{n:020d}.json')['log']}")
                    fs.delete(self.spark, f"{self.path}/commits/{n:020d}.json")
            for b in fs.listing(self.spark, f"{self.path}/base"):
                if b != name:
                    fs.delete(self.spark, f"{self.path}/base/{b}")

    def recover(self, older_than: float = 3600.0) -> list[str]:
        """Deletes appends without a marker that have not changed for so many
        seconds (crashed writers; younger ones may still be written); returns them."""
        named = {fs.read_json(self.spark, f"{self.path}/commits/{n:020d}.json")["log"] for n in self._commits()}
        lost = [n for n in fs.listing(self.spark, f"{self.path}/log") if n not in named and fs.age_s(self.spark, f"{self.path}/log/{n}") >= older_than]
        for n in lost:
            fs.delete(self.spark, f"{self.path}/log/{n}")
        return lost

    def verify(self) -> DataFrame:
        """Issues (kind, shard, offset, key) of committed data and the base."""
        rows = self.log()
        placed = kv_log.layout(rows.where("op = 'put'"), F.octet_length("value"))
        records = placed.select("shard", "offset", F.col("size").alias("size"), "key", crc32c_column(F.col("value")).alias("crc"), F.col("crc").alias("stored_crc"))
        index = placed.join(kv_log.live(rows).select("seq"), "seq", "left_semi").select("shard", "offset", "key")
        free = kv_log.holes(placed, kv_log.live(rows)).select("shard", "offset", "size").where("size > 0")
        found = kv_log.verify(records, index, rows.select("key"), free)
        for kind, n in (("invalid_superblock", len(fs.damaged_slots(self.spark, f"{self.path}/CURRENT"))), ("corruption", self._unreadable())):
            found = found.unionByName(self.spark.range(n).select(F.lit(kind).alias("kind"), *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("shard", "offset", "key")]))
        return found

    def _unreadable(self) -> int:
        """Committed appends of which nothing can be read."""
        names = [fs.read_json(self.spark, f"{self.path}/commits/{n:020d}.json")["log"] for n in self._commits() if n > self._current()["commit"]]
        return sum(not fs.exists(self.spark, f"{self.path}/log/{n}/_SUCCESS") and not any(f.endswith(".parquet") for f in fs.listing(self.spark, f"{self.path}/log/{n}")) for n in names)


class Batch:
    """Operations that become visible together or not at all."""

    def __init__(self, store: KvStore, shard: int | None):
        self.store, self.shard, self.ops, self.open = store, shard, [], True

    def _check(self) -> None:
        if not self.open:
            raise BatchClosed("batch")

    def put(self, key: bytes, value: bytes, flags: int = 0) -> None:
        self._check()
        self.ops.append(("put", bytes(key), bytes(value), flags, self.shard))

    def delete(self, key: bytes) -> None:
        self._check()
        self.ops.append(("delete", bytes(key), None, 0, self.shard))

    def commit(self, durability: str = "none") -> None:
        """The store's own staged operations go first; an empty batch is a no-op."""
        self._check()
        self.open = False
        self.store.commit()
        if self.ops:
            self.store._append(self.store._rows(self.ops), durability)

    def rollback(self) -> None:
        self._check()
        self.open = False


class Snapshot:
    """The store as of a commit; later writes do not show."""

    def __init__(self, store: KvStore, commit: int):
        self.store, self.commit = store, commit
        self._rows = store.log(commit)

    def scan(self) -> DataFrame:
        return kv_log.live(self._rows)

    def get(self, key: bytes) -> bytes:
        row = kv_log.get(self._rows, bytearray(key)).select("value").first()
        if row is None:
            raise NotFound(repr(key))
        return bytes(row.value)

    def size(self, key: bytes) -> int:
        return len(self.get(key))


def by_custom_hash(hash_of: Column, shards: int) -> Column:
    """Routing by a hash of the caller's; identity stays the raw key."""
    return F.pmod(hash_of.cast("long"), F.lit(shards)).cast("int")
