"""Operators that bring documents together, against brute force."""

import collections
import hashlib
import zlib

import numpy as np

import lakestrata.llm.near_dup as near_dup
from lakestrata.llm import decontaminate, shard, substring, token_store
from lakestrata.llm.components import connected_components
from lakestrata.llm.queries import tokenizer

from . import cases


def test_token_store(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")[0])
    path = token_store.write_store(cases.documents(spark), *tokenizer("byte_bpe_50k.json"), end_id=2)
    got = [tuple(r) for r in token_store.read_store(spark, path).orderBy("start").collect()]
    want, everything = [], []
    for doc_id, text, *_ in sorted(cases.rows(), key=lambda r: (r[0], r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, len(everything), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        everything += ids
    assert got == want
    for at in (0, 1, len(everything) // 2, len(everything) - 1):
        assert token_store.token_at(spark, path, at) == everything[at]
    empty = token_store.write_store(cases.documents(spark, []), *tokenizer("byte_bpe_50k.json"), end_id=2)
    assert token_store.read_store(spark, empty).count() == 0
    nulls = token_store.write_store(cases.documents(spark, [(None, "a", *cases.rows()[0][2:])]), *tokenizer("byte_bpe_50k.json"), end_id=2)
    assert [r.doc_id for r in token_store.read_store(spark, nulls).collect()] == [None]


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([0, 255, 256, 65535, 65536, 2**32 - 1], np.uint32), rng.integers(0, 70_000, 5000).astype(np.uint32)):
        data = token_store.pack([1, None], np.array([0, len(ids)]), ids)
        reader = token_store.Reader(Bytes(data))
        reader.verify()
        assert reader.tokens().tolist() == ids.tolist()
        assert [reader.token(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()
        broken = token_store.Reader(Bytes(data[:-5] + bytes([data[-5] ^ 1]) + data[-4:]))
        try:
            broken.verify()
        except ValueError:
            continue
        raise AssertionError("damage went unseen")


def _benchmark(spark):
    base = cases.texts()
    w = base[16].split()
    items = [(1, " ".join(w[:20])), (2, base[17][:60]), (3, "one two"), (4, None), (5, "..."), (6, " ".join(w[:20])), (7, "no such words stand anywhere in this table of small documents at all")]
    return items, spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, w string")


def test_decontamination(spark):
    items, bench = _benchmark(spark)
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cases.letters(t)
        for k in range(max(len(w) - 12, 1 if w else 0)):
            windows[tuple(w[k : k + 13])].add(str(i))
    want = []
    for doc_id, text, *_ in cases.rows():
        w, hit, found = cases.letters(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    found |= windows[tuple(w[k : k + size])]
                    hit |= {*range(k, k + size)}
        want.append((doc_id, len(w), len(hit), sorted(found)))
    got = decontaminate.contamination(cases.documents(spark), bench).select("doc_id", "n_words", "n_hit", "items")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    kept = decontaminate.remove_contaminated(cases.documents(spark), bench)
    assert kept.columns == cases.documents(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, n, h, _ in want if not h)
    assert decontaminate.contamination(cases.documents(spark, []), bench).count() == 0
    assert decontaminate.contamination(cases.documents(spark), bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    _, bench = _benchmark(spark)
    whole = sorted(map(tuple, decontaminate.contamination(cases.documents(spark), bench).drop("k1", "k2").collect()))
    monkeypatch.setattr(decontaminate, "KEYS_AT_ONCE", 5)
    monkeypatch.setattr(decontaminate, "WINDOW_BYTES", 1)
    assert sorted(map(tuple, decontaminate.contamination(cases.documents(spark), bench).drop("k1", "k2").collect())) == whole


def _check_shards(rows, shards, tolerance):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    sizes = [sum(r.size for r in by[s]) for s in range(shards)]
    largest = max((r.size for r in rows), default=0)
    assert max(sizes) - min(sizes) <= 2 * (largest + tolerance * sum(sizes) / shards) + 1
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))


def test_sharding(spark):
    docs = cases.documents(spark)
    rows = shard.shard_digest(docs, shards=5).collect()
    assert len(rows) == docs.count()
    text = {r[0]: r[1] for r in cases.rows()}
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
    _check_shards(rows, 5, shard.TOLERANCE)
    hot = spark.createDataFrame([(i, "hot" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    rows = shard.shard_digest(hot, shards=24).collect()
    _check_shards(rows, 24, shard.TOLERANCE)
    assert shard.shard_digest(docs.limit(0)).count() == 0
    shard.write_shards(docs, f"{spark.conf.get('spark.checkpoint.dir')}/shards", shards=5)
    back = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/shards")
    assert back.count() == docs.count() and back.select("shard").distinct().count() <= 5
    nulls = spark.createDataFrame([(None, None)] * 3 + [(2, "x")], "doc_id long, text string")
    assert sorted(r.slot for r in shard.shard_digest(nulls, shards=1).collect()) == [0, 1, 2, 3]


def _components(rows, size, percent):
    sets, n = [], []
    for _, text, *_ in rows:
        w = cases.plain(text, True)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(rows[i][0]), root(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted((r[0], len(s), root(r[0])) for r, s in zip(rows, sets, strict=True))


def test_near_duplicates(spark):
    for size in (2, 5):
        got = near_dup.near_duplicates(cases.documents(spark), size=size).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == _components(cases.rows(), size, 80)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dup.keep_one_of_each(cases.documents(spark), size=2)
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in _components(cases.rows(), 2, 80)}
    assert near_dup.near_duplicates(cases.documents(spark, [])).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dup.near_duplicates(nulls).collect()) == [(0, 0, True), (0, 0, True), (1, 1, True)]


def test_near_duplicate_chains(spark, monkeypatch):
    """A chain of texts, each like the next but not like the others, in blocks of two."""
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    words = [f"w{i}" for i in range(200)]
    chain = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(30)]
    got = near_dup.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), size=2).collect()
    assert {r.component_id for r in got} == {0}


def test_links_within_blocks():
    rng = np.random.default_rng(5)
    items = [np.unique(rng.choice(40, 30)).astype(np.uint64) for _ in range(60)]
    ids, comps = np.arange(60), np.arange(60)
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(60):
        for j in range(i):
            if near_dup._similar(items[i], items[j], 80):
                parent[root(i)] = root(j)
    want = len({root(i) for i in range(60)})
    assert len(near_dup.links_within(ids, comps, items, 80)) == 60 - want


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(50)] + [(2000, 2001 + i) for i in range(50)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in list(parent))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    odd = spark.createDataFrame([(1, None, "x"), (None, 2, "x"), (3, 3, "x"), (5, 4, "x"), (4, 5, "x"), (4, 5, "x")], "a long, b long, node string")
    assert sorted(map(tuple, connected_components(odd).collect())) == [(4, 4), (5, 4)]


def test_near_duplicate_stage_judges_rows_one_by_one(spark):
    """Rows that share an id but not a text, repeated rows, rows without an id."""
    a, b = cases.prose(__import__("random").Random(1), 40), " ".join(f"u{i}" for i in range(40))
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (7, b + " more", 3), (7, b + " more", 4), (None, "n " * 3 + a[::-1], 5), (None, "n " * 3 + a[::-1], 6), (None, None, 7), (8, "", 8), (8, "", 9)]
    kept = near_dup.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _n int"), size=5)
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert kept.columns == ["doc_id", "text", "_n"]
    assert got == sorted([(1, a), (5, b), (0, "n " * 3 + a[::-1]), (0, ""), (8, ""), (8, "")])


def test_null_ids_everywhere(spark):
    from lakestrata.llm import bpe, license_scan, quality, secret_scan

    rows = [(None, t, "en", "s", 1, *cases.rows()[0][5:]) for t in (None, "", "one two", "one two", "token=abcdefgh MIT License")]
    docs = cases.documents(spark, rows)
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert sorted(r.n_hit for r in decontaminate.contamination(docs, bench).collect()) == [0, 0, 0, 2, 2]
    for out in (bpe.digests(docs, *tokenizer("byte_bpe_50k.json")), license_scan.scan_licenses(docs), secret_scan.scan_secrets(docs, *tokenizer("byte_bpe_50k.tiktoken")), quality.rule_ledger(docs), substring.find_repeats(docs)):
        assert [r.doc_id for r in out.collect()] == [None] * 5


def test_substring(spark):
    seen = collections.Counter()
    lists = [cases.plain(r[1]) for r in cases.rows()]
    for w in lists:
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = []
    for (doc_id, *_), w in zip(cases.rows(), lists, strict=True):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring.find_repeats(cases.documents(spark), with_text=True).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(want)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert all(sum(x.end - x.start for x in r.repeats) == r.n_removed for r in got)
    assert substring.find_repeats(cases.documents(spark, [])).count() == 0


def test_sharding_of_equal_rows_and_clashing_names(spark):
    """Many rows equal in id and text are still cut into shards of near equal bytes."""
    rows = [(None, "one text of them all", 1, 2, "c", 4)] * 3000 + [(i, f"text {i}", 1, 2, "c", 4) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int, i int, cell string, before int")
    out = shard.shard_documents(docs, shards=24)
    assert out.columns == [*docs.columns, "size", "shard", "slot"]
    got = out.collect()
    assert len(got) == 3300 and {(r.h, r.i, r.cell, r.before) for r in got} == {(1, 2, "c", 4)}
    _check_shards(got, 24, shard.TOLERANCE)
    taken = spark.createDataFrame([(1, "a", 7, 8, 9, "r", "t")], "doc_id long, text string, size int, shard int, slot int, row string, t string")
    [r] = shard.shard_documents(taken).collect()
    assert tuple(r)[:5] == (1, "a", "r", "t", 9) and 0 <= r.shard < 24 and r.slot == 0


def test_sharding_in_many_steps(spark):
    """Cells cut into steps of the key's range: the same law, gapless slots in order."""
    rng = np.random.default_rng(3)
    rows = [(int(i), "hot" if i % 3 == 0 else "x" * int(rng.integers(0, 60))) for i in range(4000)] + [(5, "tie")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard.shard_documents(docs, shards=4, cell_bytes=200).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows)
    _check_shards(got, 4, shard.TOLERANCE)
    place = {t: n for n, t in enumerate(dict.fromkeys(r.text for r in sorted(got, key=lambda r: (r.shard, r.slot))))}
    in_order = [place[r.text] for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert in_order == sorted(in_order)  # equal texts stand together


def test_splitters_of_narrow_ranges(spark):
    """Keys next to each other at the far end of the range do not stop the search."""
    far = 2**63 - 50
    rows = [(far + k, -(2**63) + k, k, 10) for k in range(40)] * 2
    keys = spark.createDataFrame(rows, "h long, i long, t long, size long")
    assert [sum(r[:3] < k for r in rows) for k in shard.find_splitters(keys, 4, 0.0).keys] == [20, 40, 60]
    one = spark.createDataFrame([(1, 1, 1, 10)] * 8, "h long, i long, t long, size long")
    assert shard.find_splitters(one, 4, 0.0).tied == {1}
