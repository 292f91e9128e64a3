"""A small archive in three versions, chosen for what changes in it.

    index   text, compressed: lines come in the middle, then it is cut at a page's end
    thumbs  noise, stored as it is: grows, then changes across a page boundary
    old     goes
    keep    stays, then one word changes
    silent  empty, then full
    take    comes, exactly two pages, then changes in the middle
    extra   comes last
"""

import random

SPEC = "ordinal long, path string, entry long, data binary, page_size int, codec string, level int"
PAGE = 4096
PACK_ID = 4101
INDEX, THUMBS, OLD, KEEP, SILENT, TAKE, EXTRA = range(9001, 9008)
PATHS = {INDEX: "catalog/index.tsv", THUMBS: "catalog/thumbs.raw", OLD: "notes/old.txt", KEEP: "notes/keep.txt", SILENT: "audio/silent.pcm", TAKE: "audio/take.pcm", EXTRA: "extra.bin"}
STORED = {INDEX: ("lz4", 3), THUMBS: ("none", 0), OLD: ("lz4", 1), KEEP: ("none", 0), SILENT: ("none", 0), TAKE: ("lz4", 9), EXTRA: ("none", 0)}

_rng = random.Random(20260)


def listing(first, n):
    """Lines of a table: regular enough to compress, no two alike."""
    return "".join(f"{i}\tshelf {i % 17}\t{(i * i) % 9973} mm\tbox of {('glass', 'paper', 'brass')[i % 3]}\n" for i in range(first, first + n)).encode()


_index = listing(0, 270)
_more = _index[:4000] + listing(5000, 14) + _index[4000:]
_thumbs = _rng.randbytes(3 * PAGE - 700)
_grown = _thumbs + _rng.randbytes(PAGE // 2)
_across = _grown[: PAGE - 25] + _rng.randbytes(60) + _grown[PAGE + 35 :]
_keep = b"The keeper notes that nothing was moved in spring. " * 30
_take = bytes(min(255, abs((i % 400) - 200)) for i in range(2 * PAGE))

VERSIONS = {
    1: {INDEX: _index, THUMBS: _thumbs, OLD: listing(800, 25), KEEP: _keep, SILENT: b""},
    2: {INDEX: _more, THUMBS: _grown, KEEP: _keep, SILENT: bytes(3000) + _rng.randbytes(2500), TAKE: _take},
}
VERSIONS[3] = VERSIONS[2] | {INDEX: _more[: 2 * PAGE], THUMBS: _across, KEEP: _keep.replace(b"spring", b"autumn", 1), TAKE: _take[:PAGE] + _rng.randbytes(500) + _take[PAGE + 500 :], EXTRA: _rng.randbytes(5 * PAGE)}
assert 2 * PAGE < len(_index) < len(_more) < 3 * PAGE


def files_of(version):
    return [(f"/{PATHS[e]}", e, data, *STORED[e]) for e, data in VERSIONS[version].items()]


def inputs(spark, files, page_size=PAGE, strategy=None):
    rows = [(i, p, e, bytearray(d), page_size, c, n) for i, (p, e, d, c, n) in enumerate(files)]
    df = spark.createDataFrame(rows, SPEC)
    if strategy:
        from pyspark.sql import functions as F

        df = df.withColumn("strategy", F.lit(strategy))
    return df
