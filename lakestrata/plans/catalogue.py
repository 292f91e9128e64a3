"""Queries over the driver's tables, each with a twin in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checksums import crc32c_column
from ..functions.paths import normalize_path
from ..operators import diff, kv_log, overlay, patch, verify, volume
from ..operators.kv_store import KvStore
from ..sources import pack
from ..sources.work import new_dir
from . import derive
from .derive import KV_SQL, LAYER_SQL, PACK_SQL, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv_log.committed(derive.kv_log(spark, sf_dir))



# ------------------------------------------------------------- key/value log


@query(KV_SQL + "SELECT seq, batch_id, op, key FROM vis")
def kv_committed(spark, sf_dir):
    return _rows(spark, sf_dir).select("seq", "batch_id", "op", "key")


@query(KV_SQL + "SELECT key, seq, value, shard FROM live")
def kv_live(spark, sf_dir):
    return kv_log.live(_rows(spark, sf_dir)).select("key", "seq", "value", "shard")


_KEYS = "SELECT DISTINCT user_id AS key FROM events UNION SELECT DISTINCT user_id + 1000 FROM events"


def _asked(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("key")).distinct()
    return users.union(users.select(F.col("key") + 1000)).distinct()


@query(KV_SQL + f", keys AS ({_KEYS}) SELECT k.key, CASE WHEN l.op IS NULL THEN 'unknown' WHEN l.op = 'delete' THEN 'deleted' ELSE 'live' END AS state FROM keys k LEFT JOIN last l ON k.key = l.key")
def kv_state(spark, sf_dir):
    return kv_log.key_state(_rows(spark, sf_dir), _asked(spark, sf_dir))


@query(KV_SQL + f", keys AS ({_KEYS}) SELECT k.key, l.value FROM keys k LEFT JOIN live l ON k.key = l.key")
def kv_get_many(spark, sf_dir):
    return kv_log.get_many(_rows(spark, sf_dir), _asked(spark, sf_dir)).select("key", "value")


@query(KV_SQL + "SELECT key, value, CAST(length(value) AS BIGINT) AS size FROM live WHERE key = 12")
def kv_get(spark, sf_dir):
    return kv_log.get(_rows(spark, sf_dir), 12).select("key", "value", F.length("value").cast("long").alias("size"))


@query(
    KV_SQL
    + """, era AS (SELECT *, sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS e FROM vis)
SELECT key, seq, row_number() OVER (PARTITION BY key, e ORDER BY seq) AS version FROM era WHERE op = 'put'"""
)
def kv_versions(spark, sf_dir):
    return kv_log.versions(_rows(spark, sf_dir)).select("key", "seq", "version")


@query(
    KV_SQL
    + """SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM vis WHERE seq <= 3000) WHERE n = 1 AND op = 'put'"""
)
def kv_snapshot(spark, sf_dir):
    return kv_log.as_of(_rows(spark, sf_dir), 3000).select("key", "seq", "value")


@query(
    KV_SQL
    + """, a AS (SELECT shard, count(*) AS entries, CAST(sum(CASE WHEN op = 'put' THEN length(value) ELSE 0 END) AS BIGINT) AS data_bytes FROM vis GROUP BY shard),
b AS (SELECT shard, count(*) AS live_keys, CAST(sum(length(value)) AS BIGINT) AS live_bytes FROM live GROUP BY shard)
SELECT a.shard, entries, data_bytes, coalesce(live_keys, 0) AS live_keys, coalesce(live_bytes, 0) AS live_bytes FROM a LEFT JOIN b ON a.shard = b.shard"""
)
def kv_shard_stats(spark, sf_dir):
    return kv_log.shard_stats(_rows(spark, sf_dir), F.length("value").cast("long"))


_LAYOUT_SQL = (
    KV_SQL
    + """, placed AS (SELECT *, CAST(length(value) AS BIGINT) AS size, CAST(coalesce(sum(length(value)) OVER (PARTITION BY shard ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM log WHERE op = 'put'),
marked AS (SELECT p.*, l.seq IS NOT NULL AS alive FROM placed p LEFT JOIN live l ON p.seq = l.seq),
islands AS (SELECT *, coalesce(sum(CASE WHEN alive THEN 1 ELSE 0 END) OVER (PARTITION BY shard ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM marked),
holes AS (SELECT shard, min("offset") AS "offset", CAST(sum(size) AS BIGINT) AS size, count(*) AS n_records FROM islands WHERE NOT alive GROUP BY shard, island)
"""
)


def _placed(spark, sf_dir):
    puts = derive.kv_log(spark, sf_dir).where("op = 'put'")
    return kv_log.layout(puts, F.length("value")), kv_log.live(_rows(spark, sf_dir))


@query(_LAYOUT_SQL + 'SELECT shard, "offset", size, n_records FROM holes')
def kv_holes(spark, sf_dir):
    placed, live = _placed(spark, sf_dir)
    return kv_log.holes(placed, live).select("shard", "offset", "size", "n_records")


@query(
    _LAYOUT_SQL.replace("live AS (SELECT * FROM last WHERE op = 'put')", "live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM vis WHERE seq <= 3000) WHERE n = 1 AND op = 'put')")
    + """, tails AS (SELECT shard, max("offset" + size) AS tail FROM placed GROUP BY shard)
SELECT h.shard, h."offset", h.size, t.tail FROM holes h JOIN tails t ON h.shard = t.shard WHERE h."offset" + h.size = t.tail"""
)
def kv_free_tails(spark, sf_dir):
    """What could be cut if only a snapshot's rows were kept."""
    placed, _ = _placed(spark, sf_dir)
    return kv_log.free_tails(kv_log.holes(placed, kv_log.as_of(_rows(spark, sf_dir), 3000)), placed)


@query(
    """WITH bad AS (SELECT min(event_id) AS b FROM events WHERE event_id % 997 = 996) SELECT event_id AS seq FROM events, bad WHERE b IS NULL OR event_id < b"""
)
def kv_journal_tail(spark, sf_dir):
    journal = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"))
    return kv_log.torn_prefix(journal, F.col("seq") % 997 != 996)


@query(
    _LAYOUT_SQL
    + """, records AS (SELECT shard, "offset", size, key, seq % 211 <> 0 AS good FROM placed),
free AS (SELECT * FROM holes WHERE "offset" % 2 = 0 AND size > 0),
idx AS (SELECT m.shard, m."offset" + CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END AS "offset", key FROM marked m WHERE alive),
known AS (SELECT DISTINCT key FROM vis WHERE key % 10 <> 3)
SELECT 'checksum_mismatch' AS kind, shard, "offset", key FROM records WHERE NOT good
UNION ALL SELECT 'dangling_index', shard, "offset", key FROM idx i WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.good AND r.shard = i.shard AND r."offset" = i."offset" AND r.key = i.key)
UNION ALL SELECT 'orphan_record', shard, "offset", key FROM records r WHERE good AND NOT EXISTS (SELECT 1 FROM idx i WHERE r.shard = i.shard AND r."offset" = i."offset" AND r.key = i.key) AND key NOT IN (SELECT key FROM known)
  AND NOT EXISTS (SELECT 1 FROM free f WHERE f.shard = r.shard AND r."offset" >= f."offset" AND r."offset" < f."offset" + f.size)
UNION ALL SELECT 'invalid_region', shard, "offset", NULL FROM holes WHERE "offset" % 2 = 0 AND size > 0 AND "offset" % 3 = 0"""
)
def kv_verify(spark, sf_dir):
    placed, live = _placed(spark, sf_dir)
    crc = crc32c_column(F.encode("value", "UTF-8"))
    records = placed.select("shard", "offset", "size", "key", crc.alias("crc"), (crc + F.when(F.col("seq") % 211 == 0, 1).otherwise(0)).alias("stored_crc"))
    index = placed.join(live.select("seq"), "seq", "left_semi").select("shard", (F.col("offset") + F.when(F.col("seq") % 5 == 0, 1).otherwise(0)).alias("offset"), "key")
    known = _rows(spark, sf_dir).where("key % 10 <> 3")
    free = kv_log.holes(placed, live).where("offset % 2 = 0 and size > 0").select("shard", "offset", "size")
    free = free.unionByName(free.where("offset % 3 = 0"))  # a few listed twice
    return kv_log.verify(records, index, known, free)


@query(
    """SELECT bucket, position, key FROM (SELECT *, lag(key) OVER (PARTITION BY bucket ORDER BY position) AS b
FROM (SELECT CAST(user_id % 8 AS BIGINT) AS bucket, event_id AS position, event_id * 10 + (user_id * 31) % 40 AS key FROM events)) WHERE b IS NOT NULL AND key <= b"""
)
def kv_index_order(spark, sf_dir):
    index = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("bucket"), F.col("event_id").alias("position"), (F.col("event_id") * 10 + F.col("user_id") * 31 % 40).alias("key"))
    return kv_log.verify_order(index)


@query(
    """WITH b AS (SELECT CAST(user_id % 3 AS INTEGER) AS shard, event_id * 10 AS "offset", CAST(5 + (event_id * 7) % 9 AS BIGINT) AS size FROM events),
r AS (SELECT *, max("offset" + size) OVER (PARTITION BY shard ORDER BY "offset", size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "offset" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY shard ORDER BY "offset", size ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT shard, min("offset") AS "offset", max("offset" + size) - min("offset") AS size FROM i GROUP BY shard, island"""
)
def kv_merge_intervals(spark, sf_dir):
    blocks = table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("int").alias("shard"), (F.col("event_id") * 10).alias("offset"), (5 + F.col("event_id") * 7 % 9).cast("long").alias("size"))
    return kv_log.merge_intervals(blocks)


_STORED_SQL = """WITH log AS (SELECT event_id AS n, CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, props AS value FROM events),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS rn FROM log) WHERE rn = 1)
SELECT key, value FROM last WHERE op = 'put'"""


def _stored(spark, sf_dir) -> KvStore:
    """events committed to a store in two batches, with a checkpoint between."""
    store = KvStore.create(spark, new_dir(spark, "store"), shards=3)
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), op.alias("op"), F.col("user_id").cast("string").cast("binary").alias("key"), F.when(op == "put", F.col("props").cast("binary")).alias("value"))
    half = rows.agg(F.percentile_approx("n", 0.5)).first()[0]
    store.write(rows.where(F.col("n") <= half))
    store.checkpoint()
    store.write(rows.where(F.col("n") > half))
    return store


@query(_STORED_SQL)
def kv_checkpoint(spark, sf_dir):
    return _stored(spark, sf_dir).scan().select(F.col("key").cast("string"), F.col("value").cast("string"))


@query(_STORED_SQL)
def kv_optimize(spark, sf_dir):
    store = _stored(spark, sf_dir)
    store.optimize()
    return store.scan().select(F.col("key").cast("string"), F.col("value").cast("string"))


# ------------------------------------------------------------ paths and pages


@query(
    r"""SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE ltrim(regexp_replace(p, '[/\\]+', '/', 'g'), '/') END AS path
FROM (SELECT doc_id, '\\' || source || '//' || CASE WHEN doc_id % 29 = 0 THEN '..' ELSE lang END || '\/' || doc_id || '.txt' AS p FROM documents)"""
)
def normalize_paths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    raw = F.concat(F.lit("\\\\"), "source", F.lit("//"), F.when(F.col("doc_id") % 29 == 0, "..").otherwise(F.col("lang")), F.lit("\\/"), "doc_id", F.lit(".txt"))
    return docs.select("doc_id", normalize_path(raw).alias("path"))


@query("SELECT path, count(*) AS n FROM (SELECT source || '/' || lang AS path FROM documents) GROUP BY path HAVING count(*) > 1")
def key_conflicts(spark, sf_dir):
    return pack.conflicts(table(spark, sf_dir, "documents").select(F.concat("source", F.lit("//"), "lang").alias("path")), "path")


@query(PACK_SQL + "SELECT entry, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size FROM v1")
def content_hash(spark, sf_dir):
    return pack.build_state(derive.pack_inputs(derive.pack_v1(spark, sf_dir), 4096), 1, 1, 1).select("entry", F.col("source_hash").alias("content_hash"), "size")


#: CRC-32C byte by byte over a table made from the reflected polynomial 0x82F63B78.
_CRC_SQL = """WITH t AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END) AS c FROM range(256) r(i)))
SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(coalesce(text, ''))), lambda i: ('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc
FROM (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents), t"""


@query(_CRC_SQL)
def checksums(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", crc32c_column(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("crc"))


@query(PACK_SQL + "SELECT entry, page, sha256(raw) AS hash FROM p1")
def pages(spark, sf_dir):
    return derive.text_pages(derive.pack_v1(spark, sf_dir)).select("entry", "page", F.sha2("raw", 256).alias("hash"))


@query(PACK_SQL + "SELECT entry, sha256(substr(text, 1001, 2000)) AS hash FROM v1 WHERE length(text) > 1000")
def read_range(spark, sf_dir):
    offset, length = F.lit(1000), F.lit(2000)
    each = derive.text_pages(derive.pack_v1(spark, sf_dir))
    each = each.where(F.col("page").between(1000 // derive.PAGE, 2999 // derive.PAGE)).withColumn("start", F.col("page") * derive.PAGE).withColumn("size", F.char_length("raw"))
    parts = overlay.clip(overlay.overlapping(each, offset, length), offset, length)
    return overlay.assemble(parts.withColumn("bytes", F.encode("bytes", "UTF-8")), ["entry"]).select("entry", F.sha2("data", 256).alias("hash"))


# ----------------------------------------------------------------- overlays


@query(LAYER_SQL + "SELECT entry, CAST(priority AS INTEGER) AS priority, sha256(text) AS hash FROM top")
def overlay_entries(spark, sf_dir):
    files, tombs, _ = derive.layers(spark, sf_dir)
    return overlay.resolve_entries(files, tombs).select("entry", "priority", F.sha2("text", 256).alias("hash"))


@query(LAYER_SQL + "SELECT path, entry, CAST(priority AS INTEGER) AS priority FROM named")
def path_resolve(spark, sf_dir):
    return overlay.resolve_paths(derive.layers(spark, sf_dir)[2]).select("path", "entry", "priority")


@query(LAYER_SQL + "SELECT n.path, n.entry, CAST(n.priority AS INTEGER) AS path_priority, CAST(t.priority AS INTEGER) AS priority, sha256(t.text) AS hash FROM named n JOIN top t ON n.entry = t.entry")
def open_paths(spark, sf_dir):
    files, tombs, paths = derive.layers(spark, sf_dir)
    return overlay.open_paths(paths, files.drop("path"), tombs).select("path", "entry", "path_priority", "priority", F.sha2("text", 256).alias("hash"))


@query(LAYER_SQL + "SELECT entry, CAST(strlen(text) AS BIGINT) AS size, CAST(CASE WHEN text = '' THEN 0 ELSE 4096 END AS INTEGER) AS page_size FROM top")
def stat_entries(spark, sf_dir):
    return overlay.stat(_volume(spark, sf_dir, 4096).entries())


@query(
    PACK_SQL
    + """, t AS (SELECT entry, page, raw, (entry + page) % 7 = 0 AS hole FROM p2 WHERE entry % 3 = 0),
both_ AS (SELECT coalesce(t.entry, b.entry) AS entry, coalesce(t.page, b.page) AS page, t.entry IS NOT NULL AS on_top, coalesce(t.hole, false) AS hole, t.raw AS a, b.raw AS b FROM t FULL JOIN p1 b ON t.entry = b.entry AND t.page = b.page)
SELECT entry, page, CASE WHEN on_top THEN 'top' ELSE 'base' END AS layer, sha256(CASE WHEN on_top THEN a ELSE b END) AS hash FROM both_ WHERE NOT hole"""
)
def page_layers(spark, sf_dir):
    kind = F.when((F.col("entry") + F.col("page")) % 7 == 0, "placeholder").otherwise("page")
    top = derive.text_pages(derive.pack_v2(spark, sf_dir).where("entry % 3 = 0")).withColumn("kind", kind)
    base = derive.text_pages(derive.pack_v1(spark, sf_dir)).withColumn("kind", F.lit("page"))
    return overlay.resolve_pages(top, base, ["entry", "page"]).select("entry", "page", "layer", F.sha2("raw", 256).alias("hash"))


_MOUNTS = [(0, 1, 3, 10), (1, 1, 5, 20), (2, 2, 1, 5), (3, 2, 7, 1)]


@query(
    "WITH m(mount, pack_id, v, r) AS (VALUES "
    + ", ".join(map(str, _MOUNTS))
    + """), refs AS (SELECT DISTINCT CAST(l_suppkey % 3 + 1 AS BIGINT) AS pack_id, CAST(l_linenumber AS BIGINT) AS generation FROM lineitem)
SELECT pack_id, generation, CAST(mount AS INTEGER) AS mount FROM (SELECT refs.pack_id, generation, mount, row_number() OVER (PARTITION BY refs.pack_id, generation ORDER BY CASE WHEN v = generation THEN 0 WHEN v >= generation THEN 1 ELSE 2 END, r DESC) AS n
FROM refs JOIN m ON refs.pack_id = m.pack_id) WHERE n = 1"""
)
def reference_mounts(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 3 + 1).alias("pack_id"), F.col("l_linenumber").cast("long").alias("generation"))
    mounts = spark.createDataFrame(_MOUNTS, "mount int, pack_id long, pack_version long, priority long")
    return overlay.match_generation(refs, mounts)


def _volume(spark, sf_dir, page_size: int, codec: str = "none") -> volume.Volume:
    """v1 at 10, a third of v2 with tombstones at 20, tombstones at 30, as packs."""
    everything = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("entry"), F.lit(1).cast("long").alias("version"), F.lit("removed").alias("reason"))
    v1 = pack.build_pack(derive.pack_inputs(derive.pack_v1(spark, sf_dir), page_size, codec), 1, 1)
    v2 = pack.build_pack(derive.pack_inputs(derive.pack_v2(spark, sf_dir).where("entry % 3 = 0"), page_size, codec), 2, 1, tombstones=everything.where("entry % 19 = 0"))
    marks = pack.empty_pack(spark, 3, 1).with_(tombstones=everything.where("entry % 17 = 0"))
    out = volume.Volume(spark)
    for p, priority in ((v1, 10), (v2, 20), (marks, 30)):
        out.mount(p, priority)
    return out


@query(LAYER_SQL + "SELECT entry, sha256(text) AS hash, CAST(0 AS BIGINT) AS missing FROM top")
def volume_contents(spark, sf_dir):
    found = _volume(spark, sf_dir, 4096, "lz4").contents()
    return found.select("entry", F.sha2("data", 256).alias("hash"), "missing")


@query(PACK_SQL + "SELECT entry, CAST(strlen(text) AS BIGINT) AS size, (strlen(text) + 4095) // 4096 AS n_pages, sha256(text) AS content_hash FROM v1")
def pack_build(spark, sf_dir):
    p = pack.build_pack(derive.pack_inputs(derive.pack_v1(spark, sf_dir), 4096, "lz4"), 1, 1, shards=4)
    n = p.pages.groupBy("entry").agg(F.count(F.lit(1)).alias("n_pages"))
    return p.files.join(n, "entry", "left").select("entry", "size", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), "content_hash")


@query(
    PACK_SQL
    + """SELECT coalesce(a.entry, b.entry) AS entry, CASE WHEN a.entry IS NULL THEN 'new' WHEN b.entry IS NULL THEN 'removed' WHEN a.text = b.text AND a.path = b.path THEN 'same' ELSE 'changed' END AS change FROM v1 a FULL JOIN v2 b ON a.entry = b.entry"""
)
def build_changes(spark, sf_dir):
    state = lambda f: pack.build_state(derive.pack_inputs(f, 4096), 1, 1, 1)
    return pack.build_changes(state(derive.pack_v1(spark, sf_dir)), state(derive.pack_v2(spark, sf_dir)))


@query(
    PACK_SQL
    + """SELECT v2.entry, count(b2.page) FILTER (WHERE b1.raw IS NOT NULL AND b1.raw = b2.raw) AS n_kept, count(b2.page) FILTER (WHERE b1.raw IS NULL OR b1.raw <> b2.raw) AS n_new
FROM v2 LEFT JOIN b2 ON v2.entry = b2.entry LEFT JOIN b1 ON b1.entry = b2.entry AND b1.page = b2.page GROUP BY v2.entry"""
)
def page_reuse(spark, sf_dir):
    """v2 written file by file over v1: references to pages of v1, and new pages."""
    v = volume.Volume(spark)
    v.mount(pack.write_pack(pack.build_pack(derive.pack_inputs(derive.pack_v1(spark, sf_dir), 4096, "lz4"), 1, 1, shards=4), new_dir(spark, "base")), 1)
    v.mount_writable(new_dir(spark, "writable"), 2, page_size=4096)
    v.write_files(derive.pack_inputs(derive.pack_v2(spark, sf_dir), 4096).select("entry", "data", "path"))
    mine = F.size(F.filter("page_refs", lambda r: r["pack_id"] == 2)).cast("long")
    return v._writable().files.select("entry", (F.size("page_refs") - mine).cast("long").alias("n_kept"), mine.alias("n_new"))


# --------------------------------------------------------------------- diffs


@query(
    PACK_SQL
    + """SELECT coalesce(a.entry, b.entry) AS entry, CASE WHEN a.entry IS NULL THEN 'added' WHEN b.entry IS NULL THEN 'removed' WHEN a.text = b.text THEN 'unchanged' ELSE 'changed' END AS change FROM v1 a FULL JOIN v2 b ON a.entry = b.entry"""
)
def file_diff(spark, sf_dir):
    hashed = lambda f: f.select("entry", F.sha2("text", 256).alias("content_hash"))
    return diff.file_changes(hashed(derive.pack_v1(spark, sf_dir)), hashed(derive.pack_v2(spark, sf_dir)), ["content_hash"])


@query(
    PACK_SQL
    + """SELECT coalesce(p1.entry, p2.entry) AS entry, coalesce(p1.page, p2.page) AS page, CASE WHEN p2.entry IS NULL THEN 'delete_page' ELSE 'put_page_raw' END AS kind
FROM p1 FULL JOIN p2 ON p1.entry = p2.entry AND p1.page = p2.page WHERE p1.raw IS DISTINCT FROM p2.raw"""
)
def page_diff(spark, sf_dir):
    return diff.page_changes(derive.text_pages(derive.pack_v1(spark, sf_dir)), derive.text_pages(derive.pack_v2(spark, sf_dir)), ["entry", "page"], ["raw"])


@query(
    PACK_SQL
    + """SELECT CASE WHEN b.path IS NULL THEN 'remove' ELSE 'add' END AS op, coalesce(a.path, b.path) AS path, coalesce(b.entry, a.entry) AS entry FROM v1 a FULL JOIN v2 b ON a.path = b.path WHERE a.entry IS DISTINCT FROM b.entry"""
)
def path_diff(spark, sf_dir):
    named = lambda f: f.select("path", "entry", F.lit(0).cast("long").alias("flags"))
    return diff.path_changes(named(derive.pack_v1(spark, sf_dir)), named(derive.pack_v2(spark, sf_dir))).select("op", "path", "entry")


@query(
    """WITH a AS (SELECT doc_id AS entry, 1 AS version, source AS reason FROM documents WHERE doc_id % 5 = 0), b AS (SELECT doc_id AS entry, 1 + (doc_id % 10) // 10 AS version, CASE WHEN doc_id % 4 = 0 THEN lang ELSE source END AS reason FROM documents WHERE doc_id % 6 < 2)
SELECT CASE WHEN b.entry IS NULL THEN 'delete_entry_tombstone' ELSE 'put_entry_tombstone' END AS op, coalesce(a.entry, b.entry) AS entry, b.reason FROM a FULL JOIN b ON a.entry = b.entry WHERE a.entry IS NULL OR b.entry IS NULL OR a.reason <> b.reason"""
)
def tombstone_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry"), F.lit(1).cast("long").alias("version"), "source", "lang")
    old = docs.where("entry % 5 = 0").select("entry", "version", F.col("source").alias("reason"))
    new = docs.where("entry % 6 < 2").select("entry", "version", F.when(F.col("entry") % 4 == 0, F.col("lang")).otherwise(F.col("source")).alias("reason"))
    return diff.tombstone_changes(old, new).select("op", "entry", "reason")


@query(
    """SELECT p_partkey, CASE WHEN is_new THEN 'replace' WHEN o = 'replace' THEN 'replace' WHEN o = 'page' THEN 'page' WHEN o = 'logical' AND runs THEN 'logical' WHEN o = 'logical' THEN 'page' WHEN size < 4096 THEN 'replace' WHEN runs AND size <= 67108864 THEN 'logical' ELSE 'page' END AS strategy,
CAST(CASE WHEN is_new THEN 1 WHEN o IN ('replace', 'page') THEN 2 WHEN o = 'logical' AND runs THEN 2 WHEN o = 'logical' THEN 6 WHEN size < 4096 THEN 0 WHEN runs AND size <= 67108864 THEN 0 WHEN runs THEN 4 ELSE 0 END AS BIGINT) AS flags
FROM (SELECT p_partkey, p_partkey % 11 = 0 AS is_new, CASE p_partkey % 6 WHEN 0 THEN 'replace' WHEN 1 THEN 'page' WHEN 2 THEN 'logical' ELSE 'auto' END AS o, p_size % 5 <> 0 AND p_size % 7 <> 0 AS runs, CAST(p_size AS BIGINT) * p_size * p_size * 1000 AS size FROM part)"""
)
def strategies(spark, sf_dir):
    size = F.col("p_size").cast("long") * F.col("p_size") * F.col("p_size") * 1000
    override = F.when(F.col("p_partkey") % 6 == 0, "replace").when(F.col("p_partkey") % 6 == 1, "page").when(F.col("p_partkey") % 6 == 2, "logical").otherwise("auto")
    codec = lambda n: F.when(F.col("p_size") % n == 0, "zstd").otherwise("lz4")
    d = diff.decide(override, codec(5), codec(7), size, F.col("p_partkey") % 11 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", d.alias("d")).select("p_partkey", "d.*")


_KIND_SQL = "CASE WHEN l_returnflag = 'A' THEN 'put_page_raw' WHEN l_returnflag = 'R' THEN 'put_page_pdelta' WHEN l_linestatus = 'O' THEN 'put_page_pdelta' ELSE 'delete_page' END"


def _kind():
    return F.expr(_KIND_SQL)


@query(
    f"""SELECT CAST(l_suppkey % 4 AS INTEGER) AS shard, count(*) AS units, CAST(sum(CASE WHEN kind = 'delete_page' THEN 0 ELSE l_linenumber END) AS BIGINT) AS payload_bytes, count(*) FILTER (WHERE kind = 'put_page_raw') AS put_page_raw,
count(*) FILTER (WHERE kind = 'put_page_pdelta') AS put_page_pdelta, count(*) FILTER (WHERE kind = 'delete_page') AS delete_page, count(*) FILTER (WHERE l_linenumber % 2 = 1) AS new_block FROM (SELECT *, {_KIND_SQL} AS kind FROM lineitem) GROUP BY 1"""
)
def diff_statistics(spark, sf_dir):
    units = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).cast("int").alias("shard"), _kind().alias("kind"), F.col("l_linenumber").cast("long").alias("flags"))
    units = units.withColumn("payload", F.when(F.col("kind") != "delete_page", F.repeat(F.lit("x"), F.col("flags").cast("int")).cast("binary")))
    return diff.statistics(units).select("shard", "units", "payload_bytes", "put_page_raw", "put_page_pdelta", "delete_page", "new_block")


_CHANGED_SQL = PACK_SQL + "SELECT coalesce(b1.entry, b2.entry) AS entry, coalesce(b1.page, b2.page) AS page, CASE WHEN b2.entry IS NULL THEN 'delete' ELSE 'put' END AS op FROM b1 FULL JOIN b2 ON b1.entry = b2.entry AND b1.page = b2.page WHERE b1.raw IS DISTINCT FROM b2.raw"


def _changed(units):
    return units.select("entry", "page", F.when(F.col("kind") == "delete_page", "delete").otherwise("put").alias("op"))


@query(_CHANGED_SQL)
def pack_diff(spark, sf_dir):
    """Units of many compressed pages a file, by page deltas."""
    return _changed(_diff(spark, sf_dir, 4096, "lz4", "page")[1].units)


@query(_CHANGED_SQL)
def pack_diff_replaced(spark, sf_dir):
    return _changed(_diff(spark, sf_dir, 4096, "none", "replace")[1].units)


@query(
    PACK_SQL
    + """, changed AS (SELECT coalesce(b1.entry, b2.entry) AS entry, b1.entry IS NULL AS came, b2.entry IS NULL AS went FROM b1 FULL JOIN b2 ON b1.entry = b2.entry AND b1.page = b2.page WHERE b1.raw IS DISTINCT FROM b2.raw)
SELECT entry, count(*) FILTER (WHERE went) AS n_deleted, bool_or(NOT went) AS has_new FROM changed GROUP BY entry"""
)
def pack_diff_logical(spark, sf_dir):
    """The default strategies: what of a file goes, and that the rest is replaced."""
    units = _diff(spark, sf_dir, 4096, "lz4", "auto")[1].units
    return units.groupBy("entry").agg(F.count(F.when(F.col("kind") == "delete_page", 1)).alias("n_deleted"), F.max(F.col("kind") != "delete_page").alias("has_new"))


@query(PACK_SQL + "SELECT entry, sha256(text) AS hash, CAST(0 AS BIGINT) AS missing FROM v2")
def overlay_patch(spark, sf_dir):
    """v1 under an overlay that a diff to v2 fills gives v2; v1 itself stays."""
    old, made = _diff(spark, sf_dir, 4096, "lz4", "page")
    old = pack.write_pack(old, new_dir(spark, "base"))
    over = patch.apply_overlay(volume.create_overlay(spark, old), old, [diff.write_diff(made, new_dir(spark, "diff"))])
    v = volume.Volume(spark)
    v.mount(old, 1)
    v.mount(over, 5)
    return v.contents().select("entry", F.sha2("data", 256).alias("hash"), "missing")


def _diff(spark, sf_dir, page_size, codec, strategy):
    build = lambda f, v: pack.build_pack(derive.pack_inputs(f, page_size, codec, strategy), 7, v)
    old, new = build(derive.pack_v1(spark, sf_dir), 1), build(derive.pack_v2(spark, sf_dir), 2)
    return old, diff.diff_packs(old, new)


# ------------------------------------------------------------------- patches


@query(PACK_SQL + "SELECT entry, sha256(text) AS hash, CAST(0 AS BIGINT) AS missing FROM v2")
def pack_patch(spark, sf_dir):
    """v1 and its logical diff to v2 give v2."""
    old, made = _diff(spark, sf_dir, 4096, "lz4", "auto")
    stored = diff.write_diff(made, new_dir(spark, "diff"))  # its units are read more than once
    out = volume.Volume(spark)
    out.mount(patch.apply_chain(old, [stored]), 1)
    return out.contents().select("entry", F.sha2("data", 256).alias("hash"), "missing")


@query(
    f"""WITH s AS (SELECT l_orderkey AS grp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_linenumber, l_partkey) AS ord, {_KIND_SQL} AS kind FROM lineitem),
r AS (SELECT *, max(CASE WHEN kind IN ('put_page_raw', 'delete_page') THEN ord END) OVER (PARTITION BY grp) AS reset FROM s)
SELECT grp, count(*) AS kept, min(ord) AS first_ord, max(ord) AS last_ord FROM r WHERE reset IS NULL OR ord >= reset GROUP BY grp"""
)
def coalesce_fold(spark, sf_dir):
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_suppkey", "l_linenumber", "l_partkey")).cast("long")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), order.alias("ord"), _kind().alias("kind"))
    return patch.fold_pages(steps, ["grp"], "ord").groupBy("grp").agg(F.count(F.lit(1)).alias("kept"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


@query(
    """SELECT l_orderkey AS entry, count(*) AS steps, max(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 1 THEN 1 ELSE 0 END) = 1 AS composite FROM lineitem GROUP BY l_orderkey"""
)
def composite_blocks(spark, sf_dir):
    kind = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1), "put_block_ldelta").otherwise("put_page_raw")
    units = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry"), F.lit(0).alias("block"), F.col("l_linenumber").alias("page"), kind.alias("kind"), F.lit(0).alias("reader"))
    return patch.order_steps(units).groupBy("entry").agg(F.count(F.lit(1)).alias("steps"), F.max("composite").alias("composite"))


_OP_SQL = "CASE o_orderstatus WHEN 'O' THEN 'put_file_manifest' WHEN 'F' THEN 'delete_file_manifest' ELSE 'put_entry_tombstone' END"


@query(
    f"""SELECT target, entry, op, reader FROM (SELECT *, row_number() OVER (PARTITION BY target, entry ORDER BY reader DESC) AS n FROM (SELECT CASE WHEN op LIKE '%file_manifest' THEN 'file' ELSE 'tombstone' END AS target, * FROM
(SELECT o_custkey AS entry, {_OP_SQL} AS op, o_orderkey AS reader FROM orders))) WHERE n = 1"""
)
def fold_file_ops(spark, sf_dir):
    ops = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entry"), F.expr(_OP_SQL).alias("op"), F.col("o_orderkey").alias("reader"))
    return patch.fold_file_ops(ops).select("target", "entry", "op", "reader")


@query(
    """SELECT path, op, reader FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY reader DESC, CASE WHEN op = 'add' THEN 1 ELSE 0 END DESC) AS n FROM
(SELECT DISTINCT 'c/' || o_custkey AS path, CASE WHEN o_orderstatus = 'O' THEN 'add' ELSE 'remove' END AS op, o_orderkey // 8 AS reader FROM orders)) WHERE n = 1"""
)
def fold_paths(spark, sf_dir):
    changes = table(spark, sf_dir, "orders").select(F.concat(F.lit("c/"), "o_custkey").alias("path"), F.when(F.col("o_orderstatus") == "O", "add").otherwise("remove").alias("op"), F.expr("o_orderkey div 8").alias("reader"))
    return patch.fold_paths(changes).select("path", "op", "reader")


@query(
    """WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_nationkey % 6 AS BIGINT) AS a, CAST(n_nationkey % 6 + 1 + n_regionkey % 3 AS BIGINT) AS b, CAST((n_nationkey * 37) % 101 + 1 AS BIGINT) AS w FROM nation),
p(node, weight, chain) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT e.b, p.weight + e.w, list_append(p.chain, e.i) FROM p JOIN e ON e.a = p.node)
SELECT generate_subscripts(chain, 1) - 1 AS step, unnest(chain) AS edge FROM (SELECT chain FROM p WHERE node = 6 ORDER BY weight, chain LIMIT 1)"""
)
def patch_chain(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # one row per diff at hand
    edges = [(r.n_nationkey % 6, r.n_nationkey % 6 + 1 + r.n_regionkey % 3, r.n_nationkey * 37 % 101) for r in rows]
    return spark.createDataFrame(list(enumerate(patch.select_chain(edges, 0, 6))), "step long, edge long")


# -------------------------------------------------------------- verification


@query(
    """SELECT doc_id + 1 AS entry FROM documents WHERE text <> '' AND ((doc_id + 1) % 31 = 0 OR (doc_id + 1) % 37 = 0 OR (doc_id + 1) % 41 = 0)"""
)
def shape_check(spark, sf_dir):
    size = F.octet_length("text").cast("long")
    raw = size - F.when(F.col("entry") % 37 == 0, 1).otherwise(0)
    block = F.struct(F.when(F.col("entry") % 31 == 0, 1).otherwise(0).cast("long").alias("raw_offset"), raw.alias("raw_size"), F.lit(1024).alias("page_size"), (pack.page_count(raw, F.lit(1024)) + F.when(F.col("entry") % 41 == 0, 1).otherwise(0)).alias("page_count"))
    docs = table(spark, sf_dir, "documents").where("text <> ''").withColumn("entry", F.col("doc_id") + 1)
    return verify.shape_problems(docs.select("entry", size.alias("size"), F.array(block).alias("blocks")))


@query("SELECT path, entry FROM (SELECT lang || '/' || doc_id AS path, doc_id // 3 AS entry, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY lang || '/' || doc_id) AS n FROM documents) WHERE n > 1")
def duplicate_entries(spark, sf_dir):
    return verify.duplicate_entries(table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "doc_id").alias("path"), F.expr("doc_id div 3").alias("entry")))


@query(
    PACK_SQL
    + """, stored AS (SELECT entry, page FROM p1 WHERE (entry + page) % 23 <> 0 UNION ALL SELECT entry + 1000000, page FROM p1 WHERE entry % 41 = 0)
SELECT 'page_missing' AS kind, entry, page FROM p1 a WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.entry = a.entry AND s.page = a.page)
UNION ALL SELECT 'orphan_page', entry, page FROM stored s WHERE NOT EXISTS (SELECT 1 FROM p1 a WHERE s.entry = a.entry AND s.page = a.page)"""
)
def orphan_missing(spark, sf_dir):
    key = ["entry", "page"]
    expected = derive.text_pages(derive.pack_v1(spark, sf_dir)).select(*key)
    stored = expected.where("(entry + page) % 23 <> 0").union(expected.where("entry % 41 = 0").select(F.col("entry") + 1000000, "page"))
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), *key)
    return named(verify.missing_pages(expected, stored, key), "page_missing").union(named(verify.orphan_pages(expected, stored, key), "orphan_page"))


@query(
    PACK_SQL
    + """, pages AS (SELECT entry, unnest(range((strlen(text) + 4095) // 4096)) AS page FROM v1),
judged AS (SELECT *, (entry + page) % 43 = 0 AS gone, entry % 47 = 0 AS unlisted, (entry + page) % 53 = 0 OR (entry + page) % 59 = 0 OR (entry + page) % 61 = 0 AS bad FROM pages)
SELECT 'page_missing' AS kind, entry, page FROM judged WHERE gone AND NOT unlisted
UNION ALL SELECT 'orphan_page', entry, page FROM judged WHERE unlisted AND NOT gone
UNION ALL SELECT 'page_invalid', entry, page FROM judged WHERE bad AND NOT gone
UNION ALL SELECT 'file_manifest_missing', entry, NULL FROM v1 WHERE entry % 47 = 0
UNION ALL SELECT 'manifest_file_count_mismatch', NULL, NULL WHERE EXISTS (SELECT 1 FROM v1 WHERE entry % 47 = 0)"""
)
def pack_verify(spark, sf_dir):
    """Damage of several kinds to compressed pages, many a file: facts of the raw
    page, facts of the stored page, the payload itself."""
    p = pack.build_pack(derive.pack_inputs(derive.pack_v1(spark, sf_dir), 4096, "lz4"), 1, 1)
    place = F.col("entry") + F.col("page")
    pages = p.pages.where(place % 43 != 0)
    pages = pages.withColumn("raw_crc", F.when(place % 53 == 0, F.col("raw_crc") + 1).otherwise(F.col("raw_crc")))
    pages = pages.withColumn("content_hash", F.when(place % 59 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")))
    pages = pages.withColumn("payload", F.when(place % 61 == 0, F.concat("payload", F.lit("!").cast("binary"))).otherwise(F.col("payload")))
    return verify.verify_pack(p.with_(files=p.files.where("entry % 47 <> 0"), pages=pages)).select("kind", "entry", F.col("page").cast("long").alias("page"))
