"""Every registered query of the subpackage over whole tables, against its SQL twin
or the library that its contract names."""

import glob
import hashlib
import os
import zlib

import numpy as np
import pytest

from lakestrata.llm.queries import ORACLE_SQL, QUERIES, tokenizer

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_all_are_registered():
    assert set(ORACLE_SQL) <= set(QUERIES) and len([q for q in QUERIES if q.startswith("op")]) == 10


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = sorted(map(str, ([r[c] for c in sorted(df.columns)] for r in df.collect())))
    r = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(map(str, ([x[names.index(c)] for c in sorted(names)] for x in r.fetchall())))


def test_tokens_against_the_library(spark, db):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")[0])
    ids = {d: library.encode(t or "", add_special_tokens=False).ids for d, t in db.execute("SELECT doc_id, text FROM documents").fetchall()}
    raw = lambda x: np.array(x, "<u4").tobytes()
    stored, start = {r.doc_id: r for r in QUERIES["op1_token_store"](spark, SF).collect()}, 0
    for d in sorted(ids):
        assert tuple(stored[d])[:4] == (d, start, len(ids[d]) + 1, zlib.crc32(raw([*ids[d], 2])))
        start += len(ids[d]) + 1
    coded = {r.doc_id: r for r in QUERIES["op7_bpe_codec"](spark, SF).collect()}
    assert set(coded) == set(stored) == set(ids)
    for d, x in ids.items():
        text = library.decode(x, skip_special_tokens=False)
        assert tuple(coded[d])[:4] == (d, len(x), hashlib.sha256(raw(x)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_pages_hold_their_article(spark, db):
    """Brute force for the given pages: the text of the article element, block by block."""
    import html
    import re

    got = {r.page_id: r for r in QUERIES["op4_html_extract"](spark, SF).collect()}
    pages = db.execute("SELECT page_id, url, html FROM pages").fetchall()
    assert len(got) == len(pages)
    for page_id, url, page in pages:
        article = re.search(r"(?s)<article>(.*?)</article>", page or "")
        if not article:
            continue
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:h1|p|div|ul|li|article)\b[^>]*>", article[1])]
        want = "\n".join(b for b in blocks if b)
        r = got[page_id]
        assert (r.url, r.text, r.n_chars) == (url, want, len(want)), page_id
