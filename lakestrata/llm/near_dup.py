"""Near-duplicate groups: MinHash, banding, verification, components.

1. One pass over the texts gives each document the size and a 128-bit hash of
   its shingle set, a signature of universal hash minima and a key per band.
2. Equal sets form classes; only the least document of a class goes on.
3. Documents that share a band key are candidates. Within a bucket the least
   document is the centre; a document's best centres (most shared buckets) are
   compared first, by signature and then on the full sets.
4. The links so far give components. Buckets that hold more than one component
   are searched in full, in blocks of bounded rows and bytes: all pairs across
   components that no earlier band's bucket compares, whose sizes and signatures
   allow a link and that no link has joined meanwhile are compared on the full
   sets. No list of pairs is ever made.
5. All links together give the final components.

The signature has 40 bands of 6 rows: a pair at similarity 0.8 shares no band
with probability (1 - 0.8 ** 6) ** 40 < 6e-6, at 0.85 under 1e-8.

Defined results: a text without words has an empty set and is linked with
nothing; a text with fewer words than a shingle has its whole sequence as the
one shingle; rows that share a document id count as one document; rows with a
null id are kept and linked with nothing; only id and text are read, so
clashing column names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .components import connected_components
from .shared import scratch, written

BANDS, ROWS = 40, 6
CENTRES = 3
FEW = 8  # candidates that are compared one by one
#: Rows, and bytes of their sets, in a block of the exact search.
BLOCK = 1024
BLOCK_BYTES = 8 << 20
#: Estimates this far under the limit are no links: 4.6 standard deviations of
#: a signature of BANDS * ROWS minima at similarity 0.8 (2e-6 of such pairs).
MARGIN = 0.12

_rng = np.random.Generator(np.random.PCG64(8191))
_MULTIPLY = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit shingle hashes of each text, sorted, one after the
    other, and where each text begins (with one more entry for the end)."""
    words, first = T.word_hashes(texts, T.PLAIN_FOLDED)
    n = np.diff(first)
    windows = T.window_hashes(words, size)
    owner = np.repeat(np.arange(len(texts)), n)
    inside = owner[: len(windows)] == owner[size - 1 :] if len(windows) else np.zeros(0, bool)
    values, owners = [windows[inside]], [owner[: len(windows)][inside]]
    for i in np.flatnonzero((n > 0) & (n < size)):  # the whole sequence is the one shingle
        values.append(T.window_hashes(words[first[i] : first[i + 1]], int(n[i]), 0xA0761D6478BD642F + 2 * int(n[i])))
        owners.append(np.array([i]))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Universal hash minima, one row for each text with a set; empty sets have
    no meaningful row."""
    n = len(first) - 1
    out = np.zeros((n, BANDS * ROWS), dtype=np.uint32)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    starts = first[full]
    with np.errstate(over="ignore"):
        for i in range(BANDS * ROWS):
            out[full, i] = np.minimum.reduceat(value * _MULTIPLY[i] + _ADD[i], starts) >> np.uint64(32)
    return out


def features(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, n_shingles, set hash (h1, h2), band keys and a 16-bit signature."""

    def run(texts: list[str | None]) -> dict[str, list]:
        value, first = shingle_sets(texts, size)
        counts = np.diff(first)
        sums = []
        with np.errstate(over="ignore"):
            for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(T.mix(value ^ np.uint64(salt)))))
                sums.append(T.mix(total[first[1:]] - total[first[:-1]] + counts.astype(np.uint64)).view(np.int64))
            minima = signatures(value, first)
            keys = np.zeros((len(texts), BANDS), dtype=np.uint64)
            for j in range(ROWS):
                keys = T.mix(keys + minima[:, j::ROWS] + np.uint64(1))
            keys = T.mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        short = (minima & 0xFFFF).astype("<u2")
        return {"n_shingles": counts, "h1": sums[0], "h2": sums[1], "bands": [k if c else [] for k, c in zip(keys, counts, strict=True)], "sig": [s.tobytes() if c else None for s, c in zip(short, counts, strict=True)]}

    return T.map_texts(df, id_col, text_col, "id", "n_shingles long, h1 long, h2 long, bands array<long>, sig binary", run)


def full_sets(df: DataFrame, id_col: str, text_col: str, size: int, ids: DataFrame) -> DataFrame:
    """(id, items) for the documents listed in ids(id): sorted 64-bit hashes.
    The list grows with the table, so it is never broadcast, at no size."""

    def run(texts: list[str | None]) -> dict[str, list]:
        value, first = shingle_sets(texts, size)
        return {"items": [value[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]}

    wanted = T.two_columns(df, id_col, text_col).join(ids.select(F.col("id").alias("_id")).hint("merge"), "_id", "left_semi")
    return T.map_texts(wanted, "_id", "_text", "id", "items binary", run)


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _by_signature(pairs: DataFrame, feature: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures agree often enough to be links."""
    side = feature.select("id", "sig", "n_shingles")
    a = side.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a"))
    b = side.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    joined = pairs.join(a, "a").join(b, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "sig_a", "sig_b")
    out, need = T.arrow_schema("a long, b long"), percent / 100 - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BANDS * ROWS) for c in ("sig_a", "sig_b"))
            near = pa.array((x == y).mean(axis=1) >= need)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], schema=out)
        T.tidy()

    return joined.mapInArrow(run, "a long, b long").distinct()


def _by_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that are links on their full sets."""
    a = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    b = sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    out = T.arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([_similar(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), percent) for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], schema=out)
        T.tidy()

    return pairs.join(a, "a").join(b, "b").select("a", "b", "items_a", "items_b").mapInArrow(run, "a long, b long")


def links_within(ids: np.ndarray, comps: np.ndarray, items: list[np.ndarray], percent: int, left: np.ndarray | None = None, seen: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that join different components of one block, at most one fewer
    than there are components: every pair across components is compared unless
    a link found before has joined the two, or their sizes rule a link out.
    `left` marks the rows of the first of two blocks; then only pairs across
    the blocks count. seen(i, others) tells which others are compared with i
    elsewhere."""
    sizes = np.array([len(x) for x in items])
    unique, code = np.unique(np.concatenate(items), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    mark = np.zeros(len(unique), dtype=bool)
    label = comps.copy()  # the component of each row, as joined so far
    order = np.argsort(sizes, kind="stable")
    ranked = sizes[order]
    names, count = np.unique(comps, return_counts=True)
    largest = names[np.argmax(count)]
    found = []
    for i in np.flatnonzero(comps != largest if left is None else left):  # the other side's pairs are the same
        n = sizes[i]
        near = order[np.searchsorted(ranked, -(-percent * n // 100)) : np.searchsorted(ranked, 100 * n // percent, "right")]
        near = near[(label[near] != label[i]) & (~left[near] if left is not None else comps[near] != comps[i])]
        if seen is not None and len(near):
            near = near[~seen(i, near)]
        if len(near) <= FEW:
            good = [j for j in near if _similar(items[i], items[j], percent)]
        else:  # one pass over the sets of the block
            mine = code[starts[i] : starts[i] + n]
            mark[mine] = True
            shared = np.add.reduceat(mark[code].astype(np.int32), starts)[near]
            mark[mine] = False
            good = near[100 * shared >= percent * (sizes[near] + n - shared)]
        for j in good:
            a, b = label[i], label[j]
            if a != b:
                label[label == max(a, b)] = min(a, b)
                found.append((int(ids[i]), int(ids[j])))
    return found


def _earlier(bands: np.ndarray, sigs: np.ndarray, band: int, percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which pairs of a block need no look at their sets: they meet in a bucket
    of an earlier band as well, or their signatures are far from a link."""
    need = percent / 100 - MARGIN

    def seen(i: int, others: np.ndarray) -> np.ndarray:
        met = (bands[others, :band] == bands[i, :band]).any(axis=1)
        met[~met] = (sigs[others[~met]] == sigs[i]).mean(axis=1) < need
        return met

    return seen


def _rest(buckets: DataFrame, comp: DataFrame, feature: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across the components that meet in a bucket. buckets: (band, key, id,
    n_shingles)."""
    sized = comp.select(F.col("node").alias("id"), "component")
    placed = written(buckets.join(sized, "id", "left").select("band", "key", "id", F.coalesce("component", "id").alias("component"), "n_shingles"), "placed")
    members = [F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("x2")]
    sizes = placed.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"), *members).groupBy("band", "key")
    all_ = [F.sum("n").alias("n_all"), F.sum("w").alias("w_all"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2")]
    mixed = sizes.agg(F.max_by(F.struct("component", "n", "w"), F.struct("n", "component")).alias("main"), *all_).where("n_all > main.n")
    # Of buckets with the same documents the one of the earliest band is searched.
    mixed = mixed.groupBy("x1", "x2", "n_all").agg(F.min(F.struct("band", "key", "main", "w_all")).alias("b")).select(F.col("b.key").alias("key"), "b.main", "n_all", "b.w_all")
    rows = written(placed.drop("n_shingles").join(written(mixed, "mixed"), "key"), "rows")
    # The main component against the rest, and the rest against itself; both
    # cut into blocks of bounded rows and bytes, so that no group has more than
    # two blocks.
    is_main = F.col("component") == F.col("main.component")
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w * 8 / BLOCK_BYTES), F.lit(1)).cast("int")
    n_rest = F.col("n_all") - F.col("main.n")
    a_blocks, b_blocks = blocks(F.col("main.n"), F.col("main.w")), blocks(n_rest, F.col("w_all") - F.col("main.w"))
    mine = F.pmod(F.xxhash64("id"), F.when(is_main, a_blocks).otherwise(b_blocks).cast("long")).cast("int")
    dealt = rows.select("band", "key", "id", "component", is_main.alias("is_main"), mine.alias("mine"), a_blocks.alias("na"), b_blocks.alias("nb"), (n_rest > 1).alias("rest"))
    group = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    of_main = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: group(0, F.col("mine"), x))
    to_main = F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda x: group(0, x, F.col("mine")))
    among = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: group(1, F.least("mine", x), F.greatest("mine", x)))
    groups = F.when(F.col("is_main"), of_main).when(F.col("rest"), F.concat(to_main, among)).otherwise(to_main)
    dealt = dealt.select("band", "key", "id", "component", "is_main", "mine", F.explode(groups).alias("g")).select("band", "key", "id", "component", "is_main", "mine", "g.*")
    out = T.arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        ids, comps = table.column("id").to_numpy(), table.column("component").to_numpy()
        kind, i, j, band = (table.column(c)[0].as_py() for c in ("kind", "i", "j", "band"))
        items = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("items")]
        bands = table.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
        sigs = np.frombuffer(b"".join(x.as_buffer() for x in table.column("sig")), "<u2").reshape(-1, BANDS * ROWS)
        if kind == 0:
            left = ~table.column("is_main").to_numpy(zero_copy_only=False)
        else:
            left = None if i == j else table.column("mine").to_numpy() == i
        found = links_within(ids, comps, items, percent, left, _earlier(bands, sigs, band, percent)) if left is None or (left.any() and not left.all()) else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], schema=out)

    wanted = written(rows.select("id").distinct(), "wanted")
    held = feature.select("id", "bands", "sig").join(sets.join(wanted, "id", "left_semi"), "id").dropDuplicates(["id"])
    return dealt.join(held, "id").groupBy("key", "kind", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _groups(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """id, n_shingles, component (null for rows without a set or id) for every
    row of docs(_id long, _text); rows with one id count as one document."""
    with scratch(docs.sparkSession):
        feature = written(features(docs, "_id", "_text", size), "features", keep=True)

        whole = feature.where("n_shingles > 0 and id is not null")
        classes = written(whole.groupBy("h1", "h2").agg(F.min("id").alias("id")), "classes")
        heads = whole.select("id", "h1", "h2", "n_shingles", "bands", "sig").join(classes, ["id", "h1", "h2"], "left_semi")
        keyed = written(heads.select("id", "n_shingles", F.posexplode("bands").alias("band", "key")), "keyed")
        shared = written(keyed.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last").select("key", "centre"), "shared")
        buckets = written(keyed.join(shared, "key"), "buckets")

        by_best = Window.partitionBy("a").orderBy(F.desc("n"), "b")
        stars = buckets.where("id <> centre").groupBy(F.col("id").alias("a"), F.col("centre").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        stars = stars.withColumn("place", F.row_number().over(by_best)).where(f"place <= {CENTRES}").select("a", "b")
        pairs = written(_by_signature(written(stars, "stars"), feature, percent), "pairs")

        sets = written(full_sets(docs, "_id", "_text", size, buckets.select("id").distinct()), "sets")
        links = written(_by_sets(pairs, sets, percent), "links")
        comp = written(connected_components(links), "components")
        more = written(_rest(buckets, comp, heads, sets, percent), "more")
        if more.limit(1).count():
            comp = written(connected_components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "components")

        named = classes.join(comp, classes.id == comp.node, "left").select("h1", "h2", F.coalesce("component", "id").alias("component"))
        named = written(named, "named", keep=True)
    joined = feature.select("id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component"))
    return joined.select("id", "n_shingles", component.alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id (least id that can be reached over links)
    and kept (the document is that id). Links: 100 * shared >= percent * union
    of the sets of `size`-word shingles."""
    docs = T.two_columns(df, id_col, text_col).withColumn("_id", F.col("_id").cast("long"))
    out = _groups(docs, size, percent)
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, that of the least id (null ids last), with all its
    columns. Every row is judged by itself, whatever its id: of repeated rows
    and of copies without an id one stays, of rows that share an id all with
    texts of their own. Rows without words all stay.

    The rows are numbered once, in a written table, so that the numbers hold
    when a lost task runs again."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = written(df.select(row.alias("_row"), F.monotonically_increasing_id().alias("_n")), "numbered")
    docs = rows.select(F.col("_n").alias("_id"), F.col(f"_row.`{text_col}`").cast("string").alias("_text"))
    groups = _groups(docs, size, percent).where("component is not null").select(F.col("id").alias("_n"), "component")
    ids = rows.select("_n", F.col(f"_row.`{id_col}`").alias("_id"))
    members = groups.join(ids, "_n")  # by row numbers: a large group is spread
    least = members.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_n")).alias("least")).select(F.col("least._n").alias("_n"))
    gone = written(members.select("_n").join(least, "_n", "left_anti"), "gone")
    return rows.join(gone, "_n", "left_anti").select("_row.*")
