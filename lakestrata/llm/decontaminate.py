"""Benchmark decontamination as a prefix-filtered containment join.

DataFrame functions only. A benchmark item becomes windows of `width`
consecutive words (one window if it has fewer). A window occurs in a document
if all its words stand there in order, so all its shingles do: at containment 1
the necessary prefix of a window, its shingles ordered by rarity, is the rarest
one alone.

1. One scan of the documents counts the benchmark's shingles over the whole
   corpus. The shingles are a stated query set, broadcast in blocks of bounded
   size. The counts order the shingles of every window; a window of which one
   shingle stands nowhere is out, of the others the rarest is the prefix.
2. A second scan joins the documents with the prefixes alone: it keeps the
   places of prefix shingles, each with the few words around it, and a header
   for each document.
3. The window's place follows from the shingle's; it must lie in the document
   (position and length bound), and its words must equal the words there.
4. Occurrences of a document are merged to hit words and items.

Defined results: null texts and texts without words have n_words = 0 and no
hits; items without words have no window; repeated rows are judged each by
itself; only id and text are read, so clashing column names do no harm; empty
tables give empty results or documents without hits.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch, written

WIDTH = 13
SHINGLE = 5
#: Broadcast tables: rows of 8-byte shingle keys, and bytes of windows.
KEYS_AT_ONCE = 1_000_000
WINDOW_BYTES = 32 << 20
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_HEADER = 0  # the key of a document's header


def words(text: Column) -> Column:
    """Letter words of a text, A-Z in lower case; null gives an empty list."""
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.coalesce(folded, F.lit("")), _SEPARATORS), "")


def _key(w: Column, at: Column, size: int) -> Column:
    """A hash of `size` words of w from `at` on (from 0); odd, so never _HEADER,
    and written once in the plan: a second mention would be computed again."""
    return F.xxhash64(F.lit(size), *[F.get(w, at + i) for i in range(size)]).bitwiseOR(F.lit(1).cast("long"))


def windows(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Distinct windows: words, length, a 128-bit name (w1, w2) and the item ids
    (as strings) that hold them."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col).cast("string")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    each = items.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s") + 1, width).alias("words"))
    found = each.groupBy("words").agg(F.collect_set("item").alias("items"))
    return found.select("*", F.size("words").alias("length"), F.xxhash64("words").alias("w1"), F.xxhash64(F.lit(1), "words").alias("w2"))


def _shingles(found: DataFrame, shingle: int, sizes: list[int]) -> DataFrame:
    """(window, key, offset) for the first place of every shingle in a window."""
    parts = []
    for size in sizes:
        of_size = found.where(F.least("length", F.lit(shingle)) == size)
        at = of_size.select("w1", "w2", "words", F.explode(F.sequence(F.lit(0), F.col("length") - size)).alias("offset"))
        parts.append(at.select("w1", "w2", _key(F.col("words"), F.col("offset"), size).alias("key"), "offset"))
    return reduce(DataFrame.union, parts).groupBy("w1", "w2", "key").agg(F.min("offset").alias("offset"))


def _blocks(keys: DataFrame, n: int) -> list[DataFrame]:
    """Keys in blocks that may be broadcast; n: how many there are at most."""
    blocks = -(-max(n, 1) // KEYS_AT_ONCE)
    return [keys.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b) for b in range(blocks)]


def _counts(docs: DataFrame, keys: DataFrame, sizes: list[int]) -> DataFrame:
    """How often each of the keys stands in the documents; keys that never do
    have no row. Counted before any shuffle."""
    split = docs.select(words(F.col("_text")).alias("w"))
    each = split.select("w", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
    made = [F.when(F.col("pos") + size <= F.col("n"), _key(F.col("w"), F.col("pos"), size)) for size in sizes]
    each = each.select(made[0].alias("key")) if len(made) == 1 else each.select(F.explode(F.array(*made)).alias("key"))
    return each.join(F.broadcast(keys), "key").groupBy("key").agg(F.count(F.lit(1)).alias("seen"))


def _places(docs: DataFrame, keys: DataFrame, width: int, sizes: list[int], headers: bool) -> DataFrame:
    """Places in documents that hold one of the keys; a header for each document."""
    w, at, n = F.col("w"), F.col("pos"), F.col("n")
    split = docs.select("k1", "k2", "_id", words(F.col("_text")).alias("w")).withColumn("n", F.size("w"))
    if headers:  # one more place, behind the last word
        split = split.withColumn("w", F.array_append("w", F.lit("")))
    made = [F.when(at + size <= n, _key(w, at, size)) for size in sizes]
    if headers:
        made[0] = F.when(at == n, F.lit(_HEADER).cast("long")).otherwise(made[0])
    each = split.select("k1", "k2", "_id", "n", "w", F.posexplode("w").alias("pos", "word")).drop("word")
    each = each.withColumn("key", made[0]) if len(made) == 1 else each.select("*", F.explode(F.array(*made)).alias("key"))
    first = F.greatest(at - (width - 1), F.lit(0))
    context = F.when(at < n, F.slice(w, first + 1, 2 * width)).alias("context")
    return each.join(F.broadcast(keys), "key").select("k1", "k2", "_id", "n", "pos", "key", first.alias("first"), context)


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """id, n_words, n_hit (words in occurring windows), n_items, items (sorted
    strings) and the key (k1, k2) of every row."""
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    docs = docs.select("*", F.xxhash64("_id", "_text").alias("k1"), F.xxhash64(F.lit(1), "_text", "_id").alias("k2"))

    with scratch(df.sparkSession):
        found = written(windows(benchmark, item_col, item_text_col, width), "windows", keep=True)
        stated = found.agg(F.sum(F.greatest(F.col("length") - shingle + 1, F.lit(1))).alias("keys"), F.collect_set(F.least("length", F.lit(shingle))).alias("sizes")).first()
        sizes = sorted(stated.sizes, reverse=True) or [shingle]
        shingles = written(_shingles(found, shingle, sizes), "shingles")
        counts = written(reduce(DataFrame.union, [_counts(docs, b, sizes) for b in _blocks(shingles.select("key").distinct(), int(stated["keys"] or 0))]), "counts")

        rarest = F.min_by(F.struct("key", "offset"), F.struct("seen", "key")).alias("p")
        ranked = shingles.join(counts, "key", "left").groupBy("w1", "w2").agg(rarest, F.count(F.lit(1)).alias("all"), F.count("seen").alias("met")).where("met = all")
        prefixes = ranked.join(found, ["w1", "w2"]).select("w1", "w2", "words", "length", "p.key", "p.offset")
        prefixes = written(prefixes, "prefixes", keep=True)
        size = prefixes.agg(F.countDistinct("key").alias("keys"), F.sum(F.aggregate("words", F.lit(64), lambda n, x: n + 16 + F.octet_length(x))).alias("bytes")).first()

        header = df.sparkSession.range(1).select(F.lit(_HEADER).cast("long").alias("key"))
        blocks = _blocks(prefixes.select("key").distinct(), size["keys"])
        scans = [_places(docs, block.union(header) if b == 0 else block, width, sizes, b == 0) for b, block in enumerate(blocks)]
        places = written(reduce(DataFrame.union, scans), "places", keep=True)
    prefixes = F.broadcast(prefixes) if (size["bytes"] or 0) <= WINDOW_BYTES else prefixes

    start = F.col("pos") - F.col("offset")
    met = places.where(F.col("key") != _HEADER).join(prefixes, "key").withColumn("start", start)
    met = met.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n")))
    met = met.where(F.slice("context", F.col("start") - F.col("first") + 1, F.col("length")) == F.col("words"))
    hit = met.select("k1", "k2", "start", (F.col("start") + F.col("length")).alias("end"), "w1", "w2")
    hit = hit.join(found.select("w1", "w2", "items"), ["w1", "w2"])
    by_start = Window.partitionBy("k1", "k2").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    hit = hit.withColumn("reached", F.coalesce(F.max("end").over(by_start), F.lit(0)))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))
    hits = hit.groupBy("k1", "k2").agg(F.sum(fresh).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    headers = places.where(F.col("key") == _HEADER).select("k1", "k2", "_id", F.col("n").cast("long").alias("n_words"))
    out = headers.join(hits, ["k1", "k2"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("k1", "k2", F.col("_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"))


def is_contaminated() -> Column:
    """At least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Column | None = None, **options) -> DataFrame:
    """The rows of df without contaminated ones, with all their columns.
    Contaminated is a row in which any window of any item occurs, however long
    the row is, unless `rule` (on the columns of contamination) says otherwise."""
    bad = contamination(df, benchmark, id_col, text_col, **options).where(F.col("n_hit") > 0 if rule is None else rule).select("k1", "k2").distinct()
    text = F.col(f"`{text_col}`").cast("string")
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("k1"), F.xxhash64(F.lit(1), text, F.col(f"`{id_col}`")).alias("k2"))
    return keyed.join(bad, ["k1", "k2"], "left_anti").select("_row.*")
