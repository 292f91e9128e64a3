"""Removal of repeated passages by seed and extend.

Seeds are winnowed anchors: of the word n-grams within any passage of the
threshold length the one with the least hash is picked, so two equal passages
always share the anchor they pick and its place in them.

1. Anchors that occur once end the search for their passages. The others are
   joined with their occurrences, on the anchor's hash.
2. An occurrence is extended both ways at once: its span is everything covered
   by passages that pick this anchor, and the span's hash stands for it. Spans
   found twice are repeats as a whole.
3. Where spans of one anchor differ, the match ends within the span. One
   occurrence for each distinct span is extended word by word: the passages of
   threshold length around the anchor are compared by hash.
4. Repeats of a document are merged to maximal ones, and their words removed.

No list of pairs is made: occurrences meet as counts per anchor, per span and
per passage. Passages are judged on the input, not on what is left. Hashes are
compared two at a time (anchor and span, anchor and passage), 128 bits.

Defined results: null and empty texts have no words and lose none; rows with
equal id and text count as separate occurrences and get equal results; null ids
are allowed; only id and text are read, so clashing column names do no harm; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .shared import scratch, written

LENGTH = 35  # words of a passage
GRAM = 10  # words of an anchor
_SPAN_BASE = np.uint64(0xBF58476D1CE4E5B9)
_SPAN_INVERSE = np.uint64(pow(0xBF58476D1CE4E5B9, -1, 2**64))


def winnow(texts: list[str | None], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, dict]:
    """For every picked anchor: its hash, the first and last passage start that
    picks it (words of its text), and the hash of the span these cover."""
    words, first = T.word_hashes(texts, T.PLAIN)
    none = np.zeros(0, np.int64)
    if len(words) < length:
        return none, {"ahash": none, "shash": none, "lo": none, "hi": none}
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    grams = T.window_hashes(words, gram)
    start = np.flatnonzero(owner[: len(words) - length + 1] == owner[length - 1 :])
    if not len(start):
        return none, {"ahash": none, "shash": none, "lo": none, "hi": none}
    pick = np.lib.stride_tricks.sliding_window_view(grams, length - gram + 1)[start].argmin(axis=1) + start
    new = np.ones(len(start), dtype=bool)
    new[1:] = (pick[1:] != pick[:-1]) | (np.diff(start) != 1)
    at = np.flatnonzero(new)
    lo, hi, anchor = start[at], start[np.concatenate((at[1:], [len(start)])) - 1], pick[at]
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * T.powers(_SPAN_BASE, len(words)), out=total[1:])
        span = (total[hi + length] - total[lo]) * T.powers(_SPAN_INVERSE, len(words) + 1)[lo]
        span = T.mix(span + (anchor - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ((hi - lo).astype(np.uint64) << np.uint64(20)))
    row = owner[lo]
    return row, {"ahash": grams[anchor].view(np.int64), "shash": span.view(np.int64), "lo": lo - first[row], "hi": hi - first[row]}


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows under a 128-bit key of id and text: null ids and repeated ids do no harm."""
    return T.two_columns(df, id_col, text_col).select("_id", "_text", F.xxhash64("_id", "_text").alias("k1"), F.xxhash64(F.lit(1), "_text", "_id").alias("k2"))


def cover(n: int, ranges: np.ndarray, length: int) -> np.ndarray:
    """Which of n words lie in a passage; ranges: rows of first and last start."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, ranges[:, 0], 1)
    np.add.at(step, ranges[:, 1] + length, -1)
    return np.cumsum(step[:-1]) > 0


def _unpack(packed) -> np.ndarray:
    x = np.asarray(packed, dtype=np.int64).reshape(-1)
    return np.stack((x >> 31, x & 0x7FFFFFFF), axis=1)


#: What is told of a finished text, and how it is made.
RESULT = "n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:long,end:long>>, kept_text string"


def _result(text: str | None, ranges: np.ndarray, length: int, with_text: bool) -> tuple:
    words = (text or "").encode("utf-8", "surrogatepass").split()  # \x20 and \x09-\x0D
    gone = cover(len(words), ranges, length)
    kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g]) if gone.any() else b" ".join(words)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
    spans = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
    return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans, kept.decode("utf-8", "surrogatepass") if with_text else None


def find_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256, the maximal repeats (in words) and, if
    asked for, the kept words (joined by one space) of every row: stretches covered by passages of `length` words whose words
    stand in the same order anywhere else in the table."""
    docs = _keyed(df, id_col, text_col)
    id_type = docs.schema["_id"].dataType.simpleString()
    anchors = T.flat_map_texts(docs, ["k1", "k2"], "ahash long, shash long, lo int, hi int", lambda texts: winnow(texts, length, gram))

    with scratch(df.sparkSession):
        often = written(anchors.select("ahash").groupBy("ahash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ahash"), "anchors")
        met = written(anchors.join(often, "ahash"), "occurrences")
        one = F.min(F.struct("k1", "k2", "lo", "hi")).alias("one")
        spans = written(met.groupBy("ahash", "shash").agg(F.count(F.lit(1)).alias("n"), one), "spans")
        uneven = written(spans.where("n = 1").select("ahash").distinct(), "uneven")
        packed = F.col("lo").cast("long") * F.lit(1 << 31) + F.col("hi")
        known = met.join(spans.where("n > 1").select("ahash", "shash"), ["ahash", "shash"], "left_semi").groupBy("k1", "k2").agg(F.collect_set(packed).alias("known"))
        open_ = spans.join(uneven, "ahash").select("one.*", "ahash", (F.col("n") == 1).alias("odd")).groupBy("k1", "k2").agg(F.collect_list(F.struct("ahash", packed.alias("range"), "odd")).alias("open"))
        found = written(known.join(open_, ["k1", "k2"], "full"), "found")

        # One join with the texts. Texts whose repeats are all known are finished
        # there; the others go on with the passages that are still open.
        joined = docs.join(found, ["k1", "k2"], "left").select("k1", "k2", "_id", "_text", "known", F.col("open.ahash").alias("ahash"), F.col("open.range").alias("range"), F.col("open.odd").alias("odd"))
        ddl = f"k1 long, k2 long, _id {id_type}, {RESULT}, _text string, known array<long>, passages array<struct<ahash:long,whash:long,start:int,odd:boolean>>"
        out = T.arrow_schema(ddl)

        def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    rows: list[tuple] = []
                    for text, known, ahash, ranges, odd in zip(*(part.column(c).to_pylist() for c in ("_text", "known", "ahash", "range", "odd")), strict=True):
                        if not ranges or not any(odd):
                            passages = _passages(text, ahash, ranges, odd, length) if ranges else None
                            rows.append((*_result(text, _unpack(known or []), length, with_text), None, None, passages))
                        else:
                            rows.append((None, None, None, None, None, text, known or [], _passages(text, ahash, ranges, odd, length)))
                    made = list(zip(*rows, strict=True)) if rows else [()] * (len(out) - 3)
                    yield pa.RecordBatch.from_arrays([part.column(c).cast(out.field(c).type) for c in ("k1", "k2", "_id")] + [pa.array(list(v), f.type) for v, f in zip(made, list(out)[3:], strict=True)], schema=out)

        looked = written(joined.mapInArrow(first_look, ddl), "looked", keep=True)
    passages = looked.where("passages is not null").select("k1", "k2", F.inline("passages"))
    twice = written(passages.groupBy("ahash", "whash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ahash", "whash"), "twice")
    odd = passages.where("odd").join(twice, ["ahash", "whash"], "left_semi").groupBy("k1", "k2").agg(F.collect_set(F.col("start").cast("long") * F.lit(1 << 31) + F.col("start")).alias("late"))
    waiting = looked.where("n_words is null").select("k1", "k2", "_id", "_text", "known").join(odd, ["k1", "k2"], "left")
    last_ddl = f"_id {id_type}, {RESULT}"
    last_out = T.arrow_schema(last_ddl)

    def last_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_result(text, _unpack([*known, *(late or [])]), length, with_text) for text, known, late in zip(*(batch.column(c).to_pylist() for c in ("_text", "known", "late")), strict=True)]
            made = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(last_out[0].type)] + [pa.array(list(v), f.type) for v, f in zip(made, list(last_out)[1:], strict=True)], schema=last_out)

    done = looked.where("n_words is not null").select("_id", "n_words", "n_removed", "kept_sha256", "repeats", "kept_text")
    out = done.union(waiting.mapInArrow(last_look, last_ddl)).withColumnRenamed("_id", id_col)
    return out if with_text else out.drop("kept_text")


def _passages(text: str | None, ahash: list[int], ranges: list[int], odd: list[bool], length: int) -> list[dict]:
    """The hashes of all passages of the ranges."""
    hashes = T.window_hashes(T.word_hashes([text], T.PLAIN)[0], length).view(np.int64)
    return [{"ahash": a, "whash": int(hashes[s]), "start": int(s), "odd": o} for a, (lo, hi), o in zip(ahash, _unpack(ranges), odd, strict=True) for s in range(lo, hi + 1)]
