"""Sharding by histogram sort.

DataFrame functions only. Documents are ordered by the key (h, i, t): hash of
the text, document id, tie number. Equal texts stand together and sources are
mixed. The shards are stretches of that order with nearly equal bytes (the law
`bytes`).

1. Splitters are found by probing: bytes below candidate boundaries are counted
   exactly, over all partitions at once, and every boundary still open is looked
   for again between its two nearest candidates, until the bytes below it miss
   the target by no more than a tolerance, or nothing lies between two
   candidates any more. A round sends a bounded number of sums to the driver
   (probes x open boundaries), whatever the table's size.
2. A group of equal texts is no obstacle: inside one hash the probes go on over
   the document ids. Where a boundary falls among rows equal in text and id, the
   rows of that text are numbered, in a written table, and the probes go on over
   the numbers.
3. One exchange moves every document to its cell, a stretch of the order of
   about CELL_BYTES: some thousand cells at most are found by probing, and each
   is cut into equal steps of the key's range. So the largest task does not grow
   with the table.
4. A document's slot is the number of documents in earlier cells of its shard,
   from exact counts, and its place in its cell.

Defined results: a null text has no bytes and the CRC of none; null ids sort
first; rows equal in text and id count as different documents; all columns are
carried along, but those named size, shard or slot are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions_for, scratch, written

SHARDS = 24
CELL_BYTES = 32 << 20
CELLS_PROBED = 4096  # cells found by probing, at most; more are steps within these
PROBES = 64  # candidates for each open boundary and round
TOLERANCE = 0.001  # of a shard's bytes
FIXED_BYTES = 8  # what a document counts besides its text
_LEAST, _MOST = -(2**63), 2**63 - 1
KEY = ("h", "i", "t")
Key = tuple[int, int, int]


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + FIXED_BYTES


def _after(key: Key) -> Key:
    """The least key above this one."""
    h, i, t = key
    if t < _MOST:
        return h, i, t + 1
    return (h, i + 1, _LEAST) if i < _MOST else (h + 1, _LEAST, _LEAST)


@dataclass
class _Open:
    """A boundary being looked for: keys lo <= x <= hi hold it, `below` bytes lie
    under lo."""

    target: float
    lo: Key
    hi: Key
    below: int
    done: Key | None = None  # keys under this belong below the boundary


@dataclass
class Splitters:
    keys: list[Key] = field(default_factory=list)
    tied: set[int] = field(default_factory=set)  # hashes of rows that share the key at a boundary


def find_splitters(keys: DataFrame, parts: int, tolerance: float, probes: int = PROBES) -> Splitters:
    """parts - 1 keys of keys(h, i, t, size), ascending: those at which the bytes
    below come within `tolerance` bytes of equal parts, or as near as keys allow."""
    key = F.struct(*KEY)
    row = keys.agg(F.sum("size").alias("total"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    if row.total is None:
        return Splitters([(_LEAST,) * 3] * (parts - 1))
    low, high = tuple(row.low), tuple(row.high)
    open_ = [_Open(row.total * k / parts, low, high, 0) for k in range(1, parts)]
    out = Splitters()
    while pending := [o for o in open_ if o.done is None]:
        of_range: dict[tuple[Key, Key, int], list[_Open]] = {}
        for o in pending:
            of_range.setdefault((o.lo, o.hi, o.below), []).append(o)
        ranges = sorted(of_range)
        found = _probe(keys, [(lo, hi) for lo, hi, _ in ranges], probes)
        for n, r in enumerate(ranges):
            for o in of_range[r]:
                _narrow(o, found.get(n, []), r[2], tolerance, out.tied)
    out.keys = [o.done for o in open_]
    return out


def _narrow(o: _Open, bins: list[tuple[Key, Key, int, int]], below: int, tolerance: float, tied: set[int]) -> None:
    """bins: (first key, last key, bytes, rows) of what lies in the range, in order."""
    at = below
    for first, last, size, n in bins:
        if at + size < o.target - tolerance:
            at += size
            continue
        if abs(at - o.target) <= tolerance:
            o.done = first
        elif abs(at + size - o.target) <= tolerance:
            o.done = _after(last)
        elif first == last:  # one key: the nearer side
            o.done = first if o.target - at <= at + size - o.target else _after(last)
            if n > 1:
                tied.add(first[0])
        else:
            o.lo, o.hi, o.below = first, last, at
        return
    o.done = _after(bins[-1][1] if bins else o.lo)


def _level(lo: Key, hi: Key) -> int:
    """The part of the key in which a range's ends differ first."""
    return next((k for k in range(2) if lo[k] != hi[k]), 2)


def _share(which: Column, ranges: list[tuple[Key, Key]]) -> Column:
    """Where in its range a key lies, 0 to 1, in the part in which the range's
    ends differ. It only places candidates and cells; all counts are exact."""
    level = [_level(lo, hi) for lo, hi in ranges]
    low = [lo[k] for (lo, _), k in zip(ranges, level, strict=True)]
    width = [hi[k] - lo[k] for (lo, hi), k in zip(ranges, level, strict=True)]
    at, a, w = (F.get(_literal(x, kind), which) for x, kind in ((level, "int"), (low, "bigint"), ([float(x) for x in width], "double")))
    value = F.when(at == 0, F.col("h")).when(at == 1, F.col("i")).otherwise(F.col("t"))
    # The difference of wide ranges would not fit; that of narrow ones must be exact.
    ahead = F.when(w < float(2**62), F.try_subtract(value, a).cast("double")).otherwise(value.cast("double") - a.cast("double"))
    return F.coalesce(ahead, F.lit(0.0)) / F.greatest(w, F.lit(1.0))


def _step(share: Column, steps: Column) -> Column:
    return F.least(F.greatest((share * steps).cast("int"), F.lit(0)), steps - 1)


def _probe(keys: DataFrame, ranges: list[tuple[Key, Key]], probes: int) -> dict[int, list]:
    """Exact bytes and rows between evenly spaced candidates within each range
    (both ends included): one aggregation, ranges x probes sums at most."""
    which = F.col("which")
    placed = keys.select(*KEY, "size", (cell_of([lo for lo, _ in ranges]) - 1).alias("which")).where("which >= 0")
    ends = [F.get(_literal([hi[k] for _, hi in ranges], "bigint"), which) for k in range(3)]
    inside = placed.where(F.struct(*KEY) <= F.struct(*[e.alias(k) for e, k in zip(ends, KEY, strict=True)]))
    each = inside.select("which", _step(_share(which, ranges), F.lit(probes)).alias("bin"), "size", F.struct(*KEY).alias("key"))
    sums = each.groupBy("which", "bin").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    out: dict[int, list] = {}
    for r in sorted(sums.collect(), key=lambda r: (r.which, tuple(r["first"]))):
        out.setdefault(r.which, []).append((tuple(r["first"]), tuple(r["last"]), r["size"], r["n"]))
    return out


def _literal(values, kind: str) -> Column:
    return F.from_json(F.lit(str(list(values))), f"array<{kind}>")


def cell_of(splitters: list[Key]) -> Column:
    """How many splitters are at or below the key: a binary search in a literal."""
    if not splitters:
        return F.lit(0)
    parts = [_literal([s[k] for s in splitters], "bigint") for k in range(3)]
    steps = [1 << k for k in range(len(splitters).bit_length())][::-1]

    def further(got: Column, step: Column) -> Column:
        at = got + step - 1
        h, i, t = (F.get(p, at) for p in parts)
        above = (F.col("h") > h) | ((F.col("h") == h) & ((F.col("i") > i) | ((F.col("i") == i) & (F.col("t") >= t))))
        return F.when((at < len(splitters)) & above, got + step).otherwise(got)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """All columns of df and: size (bytes of the text plus 8), shard, and slot,
    gapless from 0 within a shard, in the order of the sort."""
    text, ident = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    no_tie = F.lit(0).cast("long").alias("t")
    docs = df.select(F.xxhash64(text).alias("h"), F.coalesce(ident, F.lit(_LEAST)).alias("i"), no_tie, size_of(text).alias("size"), row.alias("row"))
    with scratch(df.sparkSession):
        keys = written(docs.drop("row"), "keys")
        total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        cells = max(1, min(CELLS_PROBED // shards, -(-total // (shards * cell_bytes))))

        def search(keys: DataFrame) -> tuple[list[Key], list[Key], set[int]]:
            main = find_splitters(keys, shards, tolerance * total / shards)
            more = find_splitters(keys, shards * cells, total / shards / cells / 2) if cells > 1 else Splitters()
            return main.keys, sorted({*main.keys, *more.keys}), main.tied | more.tied

        main, all_, tied = search(keys)
        if tied:
            hot = F.col("h").isin(sorted(tied))
            numbered = written(docs.where(hot).withColumn("t", F.monotonically_increasing_id()), "tied", keep=True)
            docs = docs.where(~hot).unionByName(numbered)
            keys = written(docs.drop("row"), "keys")
            main, all_, _ = search(keys)

        # Cells in steps of their key range, so many that each has about cell_bytes.
        key = F.struct(*KEY)
        found = {r.cell: r for r in keys.select(*KEY, "size", cell_of(all_).alias("cell")).groupBy("cell").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.sum("size").alias("size")).collect()}  # CELLS_PROBED + shards rows at most
        ranges = [(tuple(found[c].low), tuple(found[c].high)) if c in found else ((0, 0, 0),) * 2 for c in range(len(all_) + 1)]
        steps = F.get(_literal([-(-found[c].size // cell_bytes) if c in found else 1 for c in range(len(ranges))], "int"), F.col("cell"))
        shard = F.get(_literal([sum(s <= c for s in main) for c in [(_LEAST,) * 3, *all_]], "int"), F.col("cell"))
        placed = lambda rows: rows.withColumn("cell", cell_of(all_)).withColumn("step", _step(_share(F.col("cell"), ranges), steps))

        counts = placed(keys).groupBy("cell", "step").agg(F.count(F.lit(1)).alias("n")).withColumn("shard", shard)
        earlier = Window.partitionBy("shard").orderBy("cell", "step").rowsBetween(Window.unboundedPreceding, -1)
        ahead = written(counts.select("cell", "step", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead")), "ahead", keep=True)

    dealt = placed(docs).repartition(partitions_for(df, 128 << 20), "cell", "step")
    dealt = dealt.withColumn("place", F.row_number().over(Window.partitionBy("cell", "step").orderBy(*KEY)) - 1)
    slot = (F.col("place") + F.col("ahead")).cast("long")
    rest = [F.col(f"row.`{c}`") for c in df.columns if c not in ("size", "shard", "slot")]
    return dealt.join(ahead, ["cell", "step"]).select(*rest, "size", F.col("shard").cast("int").alias("shard"), slot.alias("slot"))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Writes the documents as shard=0, shard=1, ... under a path, several files
    in slot order for each shard."""
    out = shard_documents(df, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """What tells the sharding without the texts."""
    out = shard_documents(df, id_col, text_col, shards)
    crc = F.crc32(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"))
    return out.select(F.col(f"`{id_col}`"), "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
