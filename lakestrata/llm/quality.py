"""Quality rules as a bitmask ledger.

`rule_ledger` measures each text once and stores, for each document, the
measurements and one bit for every rule that it fails. Policies are versioned
sets of rules, applied to the ledger with bitwise AND and no second look at
the texts; `ablations` tells what each rule of a policy does by itself, by
bitwise aggregation over the masks. Word sizes are in code points.

Defined results: a null or empty text has no words and zero measurements; any
column besides id and text is ignored, whatever its name; repeated rows are
judged each by itself; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

WINDOW = 5
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_alpha_words long, max_word_chars long, n_shouted long, n_stuttered long, n_ascii_words long, ascii_chars long"
)


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """All measurements of a list of texts; windows and words are of whole texts."""
    h, first = T.word_hashes(texts, T.PLAIN)
    count = len(texts)
    doc_of = np.repeat(np.arange(count), np.diff(first))
    out = {"n_words": np.diff(first)}

    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    per_doc = {k: np.zeros(count, np.int64) for k in ("word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_alpha_words", "max_word_chars", "n_shouted", "n_ascii_words", "ascii_chars")}
    for i, x in enumerate(raw):
        if not x:
            continue
        b = np.frombuffer(x.translate(T.PLAIN), dtype=np.uint8)
        begins = (b & 0xC0) != 0x80  # first bytes of code points
        per_doc["n_symbols"][i] = int(np.count_nonzero(_SYMBOLS[b]))
        lines = [line for line in x.split(b"\n") if line and not line.isspace()]
        per_doc["n_lines"][i] = len(lines)
        per_doc["n_dup_lines"][i] = len(lines) - len(set(lines))
        per_doc["n_shouted"][i] = int(np.count_nonzero((b >= 0x41) & (b <= 0x5A)))
        letters = (b >= 0x80) | ((b | 0x20) >= 0x61) & ((b | 0x20) <= 0x7A)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (b != 0x20).view(np.int8), [0]))))
        if not len(edges):
            continue
        start, end = edges[::2], edges[1::2]
        before = np.concatenate(([0], np.cumsum(begins)))
        sizes = before[end] - before[start]  # code points of each word
        plain = ~np.logical_or.reduceat(b >= 0x80, start)
        per_doc["word_chars"][i] = int(sizes.sum())
        per_doc["max_word_chars"][i] = int(sizes.max())
        per_doc["n_alpha_words"][i] = int(np.count_nonzero(np.logical_or.reduceat(letters, start)))
        per_doc["n_ascii_words"][i] = int(np.count_nonzero(plain))
        per_doc["ascii_chars"][i] = int(sizes[plain].sum())
    out |= per_doc

    again = np.flatnonzero((h[1:] == h[:-1]) & (doc_of[1:] == doc_of[:-1])) + 1
    out["n_stuttered"] = np.bincount(doc_of[again], minlength=count)  # words equal to the one before

    repeat = np.zeros(count, np.int64)
    w = T.window_hashes(h, WINDOW)
    if len(w):
        inside = doc_of[: len(w)] == doc_of[WINDOW - 1 :]
        at = np.flatnonzero(inside)
        with np.errstate(over="ignore"):
            key = T.mix(w[at] + doc_of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = T.covered(at[twice], WINDOW, len(h))
        repeat = np.bincount(doc_of[hit], minlength=count)
    return out | {"n_repeat_words": repeat}


#: All rules in bit order: name and the SQL condition on the measurements under
#: which a document fails. Rules never see texts; all comparisons are on whole
#: numbers. New rules go to the end, so that stored masks keep their meaning.
RULES = {
    "too_few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols_per_word": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "n_lines >= 5 and 10 * n_dup_lines > 5 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "words_without_letters": "10 * n_alpha_words < 5 * n_words",
    "endless_word": "max_word_chars > 4096",
    "shouting": "10 * n_shouted > 5 * word_chars",
    "stuttering": "10 * n_stuttered > 3 * n_words",
    "long_ascii_words": "ascii_chars > 20 * n_ascii_words",
    "one_endless_word": "max_word_chars > 4096 and 2 * max_word_chars > word_chars",
    "under_fifty_words": "n_words < 50",
    "some_repeated_windows": "100 * n_repeat_words > 10 * n_words",
    "some_duplicate_lines": "n_lines >= 3 and 10 * n_dup_lines > 2 * n_lines",
    "some_symbols": "10 * n_symbols > n_words",
}
_BIT = {name: i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rule_names: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << _BIT[n] for n in self.rule_names)


BASE = Policy("base", ("too_few_words", "repeated_windows"))
_SHAPE = ("symbols_per_word", "duplicate_lines", "short_words", "words_without_letters", "shouting", "stuttering")
V1 = Policy("v1", (*BASE.rule_names, *_SHAPE, "long_words", "endless_word"))
#: As v1, but fair to scripts without spaces and to long texts with one long address or data word.
V2 = Policy("v2", (*BASE.rule_names, *_SHAPE, "long_ascii_words", "one_endless_word"))
#: For small corpora of high quality: v2 and narrower limits.
STRICT = Policy("strict", (*V2.rule_names, "under_fifty_words", "some_repeated_windows", "some_duplicate_lines", "some_symbols"))
POLICIES = {p.version: p for p in (BASE, V1, V2, STRICT)}


def with_mask(measured: DataFrame) -> DataFrame:
    """Adds fail_mask: bit i is set when rule i fails."""
    bits = [F.when(F.expr(fails), F.lit(1 << _BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")) for name, fails in RULES.items()]
    return measured.withColumn("fail_mask", reduce(lambda a, b: a.bitwiseOR(b), bits))


def rule_ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: str | None = None) -> DataFrame:
    """doc_id, the measurements and fail_mask; a map over the rows, no shuffle."""
    return with_mask(T.map_texts(df, id_col, text_col, id_col, MEASURES, measure, keep_text))


def fails(policy: Policy) -> Column:
    return F.col("fail_mask").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(ledger: DataFrame, policy: Policy = V2) -> DataFrame:
    """Adds kept and the policy version; reads only fail_mask."""
    return ledger.withColumn("kept", ~fails(policy)).withColumn("policy", F.lit(policy.version))


def ablations(ledger: DataFrame, policy: Policy = V2) -> DataFrame:
    """One row for each rule of the policy: how many documents fail it, how
    many fail nothing else (and so would come back without it), and how many
    the policy keeps. Distinct masks are counted first, so that at most
    2 ** rules rows leave the scan whatever its size."""
    masks = ledger.groupBy(F.col("fail_mask").bitwiseAND(F.lit(policy.mask).cast("long")).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    sums = []
    for name in policy.rule_names:
        bit = F.lit(1 << _BIT[name]).cast("long")
        sums.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.coalesce(F.sum(F.when(F.col("m").bitwiseAND(bit) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
                F.coalesce(F.sum(F.when(F.col("m") == bit, F.col("n"))), F.lit(0)).alias("n_only"),
                F.coalesce(F.sum(F.when(F.col("m") == 0, F.col("n"))), F.lit(0)).alias("n_kept"),
            )
        )
    return masks.agg(F.array(*sums).alias("r")).select(F.inline("r")).withColumn("policy", F.lit(policy.version))


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: Policy = V2) -> DataFrame:
    """The rows of df that the policy keeps, with all their columns."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_t"))
    return apply_policy(rule_ledger(rows, "_row", "_t"), policy).where("kept").select("_row.*")
