"""The corpus pipeline against a brute-force version of its stages."""

import hashlib
import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from lakestrata.llm import quality, secret_scan
from lakestrata.llm.queries import tokenizer

from . import cases

ITEMS = [(1, cases.prose(random.Random(3), 25)), (2, cases.prose(random.Random(4), 9)), (3, None), (4, "...")]


def _rows():
    rng = random.Random(11)
    rows = [list(r) for r in cases.rows()]
    for i in range(12):
        long = cases.prose(rng, 1500, [f"w{rng.randrange(10**6)}" for _ in range(700)])
        w = ITEMS[i % 2][1].split()
        begin = rng.randrange(max(1, len(w) - 13 + 1))
        rows.append([1000 + i, f"{long[:4000]} {' '.join(w[begin : begin + 13])}. {long[4000:]}", "en", "s", 1, *rows[0][5:]])  # a window in a long text
    other = cases.prose(rng, 60, [f"v{i}" for i in range(400)])
    rows += [[20, other, "en", "s", 1, *rows[0][5:]], [None, other + " end", "en", "s", 1, *rows[0][5:]], [None, cases.prose(rng, 50), "en", "s", 1, *rows[0][5:]]]
    rows += [rows[-1], rows[-1]]  # repeated rows without an id
    return [tuple(r) for r in rows]


def _brute(rows):
    kept = []
    for r in rows:
        m = {k: int(v[0]) for k, v in quality.measure([r[1]]).items()}
        fails = {n for n in quality.V2.rule_names if eval(quality.RULES[n], {}, m)}
        if not fails:
            kept.append(r)
    sets = []
    for r in kept:
        w = cases.plain(r[1], True)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    group = list(range(len(kept)))
    for i, j in itertools.combinations(range(len(kept)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    best = {}
    for i, g in enumerate(group):
        key = (kept[i][0] is None, kept[i][0] or 0)
        if g not in best or key < best[g][0]:
            best[g] = (key, kept[i])
    kept = [r for _, r in best.values()]
    windows = set()
    for _, text in ITEMS:
        w = cases.letters(text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(len(w) - 12, 1 if w else 0))}
    sizes = {len(w) for w in windows}
    clean = [r for r in kept if not any(tuple(w[i : i + n]) in windows for w in [cases.letters(r[1])] for n in sizes for i in range(len(w) - n + 1))]
    assert len(clean) < len(kept) - 8
    enc = secret_scan.encoding(*tokenizer("byte_bpe_50k.tiktoken"))
    from tokenizers import Tokenizer

    library, out = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")[0]), []
    for r in clean:
        ids = library.encode(secret_scan.mask(r[1], secret_scan.find(r[1], enc)[1]), add_special_tokens=False).ids
        out.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    return out


def _run(spark, folder, rows):
    spark.createDataFrame(rows, cases.SCHEMA).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_run_against_brute_force(spark, tmp_path):
    rows = _rows()
    key = lambda r: (r[0] is None, r)
    got = sorted((tuple(r)[:3] for r in _run(spark, tmp_path, rows).select("doc_id", "n_tokens", "ids_sha256").collect()), key=key)
    assert got == sorted(_brute(rows), key=key)


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "s", 0, *cases.rows()[0][5:])] * 3])
def test_nothing_left(spark, tmp_path, rows):
    out = _run(spark, tmp_path, rows)
    assert out.count() == 0 and out.columns[:2] == ["doc_id", "n_tokens"]


def test_stages_keep_the_columns_and_leave_nothing_behind(spark, tmp_path):
    import os

    docs = spark.createDataFrame(_rows(), cases.SCHEMA)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    shared = spark.conf.get("spark.checkpoint.dir") + "/lakestrata"
    before = set(os.listdir(shared))
    _run(spark, tmp_path / "new", _rows()).count()
    assert len(set(os.listdir(shared)) - before) == 1  # the result
