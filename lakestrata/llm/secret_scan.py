"""Secrets in texts: fixed patterns and a token-efficiency test.

The patterns give the base kinds. The test looks at unbroken runs of key
characters: prose and names take few tokens for their length under a public
byte-pair vocabulary, random strings take many. A run counts as `random` when
its characters per token stay under a limit, with digits or without, unless it
is a known digest, an identifier, a number, a date, or a name: words and short
numbers with all parts between + / _ = - under 12 characters. A run that passes
as a whole is searched for parts between / _ = - and maximal stretches of tokens
that do not pass, so text in front of a secret does not hide it. Runs, parts and
stretches under 20 characters are not tested.

Spans are in code points, the end excluded. Defined results: null and empty
texts have no spans; repeated rows are scanned each by itself; only id and text
are read, so clashing column names do no harm; an empty table gives an empty
result. A text is scanned whole, whatever its length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame

from . import text as T

#: Fixed values of the scan contract.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6

#: No assignment without one of these, in some case.
_ASSIGN_GATE = re.compile(r"[Ww][Oo]?[Rr]?[Dd][\"' :=]|[Rr][Ee][Tt][\"' :=]|[Kk][Ee][Nn][\"' :=]|[Kk][Ee][Yy][\"' :=]")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})")
_UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
_NUMBER = re.compile(r"[0-9+/_=-]+|[0-9]{4}[0-9TZ+_-]+")  # numbers, dates and times
_NAME_PART = re.compile(r"(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,4})+")
RATIO = 2.2
LEAST = 20  # characters of a run, and of a part or stretch of one
LONGEST = 64  # characters by which a stretch may grow to the end of its part
_JOINTS = "/_=-"
_PART = re.compile(r"[^/_=-]+")
#: Identifiers and numbers within a run; no stretch goes over them.
_UNIT = re.compile(rf"(?<![0-9A-Za-z])(?:{_UUID.pattern}|{_DIGEST.pattern}|[0-9][0-9TZ+/_=-]{{6,}}[0-9Z])(?![0-9A-Za-z])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """A tiktoken encoding from a rank file, loaded once for each worker."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def known(run: str) -> bool:
    """Digests, UUIDs, numbers and names built from words are no secrets."""
    core = run.strip("+/_=-")
    if not core or _DIGEST.fullmatch(core) or _UUID.fullmatch(core) or _NUMBER.fullmatch(core):
        return True
    parts = re.split(r"[+/_=-]+", core)
    return max(map(len, parts)) < 12 and all(map(_NAME_PART.fullmatch, parts))  # by parts: no backtracking over the whole


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed kinds, leftmost and non-overlapping per kind."""
    out = []
    if _ASSIGN_GATE.search(text):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def _stretches(sizes: list[int], ratio: float) -> list[tuple[int, int]]:
    """The disjoint maximal stretches of tokens with the most tokens above
    characters / ratio (maximal scoring subsequences, in linear time)."""
    out: list[tuple[int, int, float, float, int]] = []  # start, end, sums before and after, the last one that starts lower
    total = 0.0
    for i, n in enumerate(sizes):
        before, total = total, total + ratio - n
        if n >= ratio:
            continue
        start, j = i, len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= before:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                break
            start, _, before, _, link = out[j]
            del out[j:]
            j = link
        out.append((start, i + 1, before, total, j))
    return [(a, b) for a, b, *_ in out]


def _within(run: str, enc, ratio: float) -> list[tuple[int, int]]:
    """Random parts and stretches of a run that passes as a whole, merged."""
    low = lambda a, b: b - a >= LEAST and not known(run[a:b]) and b - a < ratio * len(enc.encode_ordinary(run[a:b]))
    parts = [(m.start(), m.end()) for m in _PART.finditer(run)]
    starts, ends = [p[0] for p in parts], [p[1] for p in parts]
    found = [p for p in parts if low(*p)]
    begin = 0
    for end, after in [*(m.span() for m in _UNIT.finditer(run)), (len(run), len(run))]:
        sizes = [len(enc.decode_single_token_bytes(t)) for t in enc.encode_ordinary(run[begin:end])]
        places = [begin, *(begin + n for n in accumulate(sizes))]
        for i, j in _stretches(sizes, ratio):
            a, b = places[i], places[j]
            bare = run[a:b].strip(_JOINTS)
            if len(bare) >= LEAST:
                a = run.index(bare, a)
                b = a + len(bare)
            if not low(a, b):
                continue
            # Whole parts, as far as the ratio allows: the ends of a secret may be long tokens.
            first, last = parts[bisect_right(ends, a)][0], parts[bisect_left(starts, b) - 1][1]
            a = first if max(begin, a - LONGEST) <= first and low(first, b) else a
            found.append((a, last if last <= min(end, b + LONGEST) and low(a, last) else b))
        begin = after
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def random_spans(text: str, enc, ratio: float = RATIO) -> list[tuple[int, str, int]]:
    """Runs with fewer characters per token than the ratio; of other runs, the
    parts and stretches of which that holds."""
    out = []
    for m in RUN.finditer(text):
        if known(m[0]):
            continue
        if len(m[0]) < ratio * len(enc.encode_ordinary(m[0])):
            out.append((m.start(), "random", m.end()))
        else:
            out += [(m.start() + a, "random", m.start() + b) for a, b in _within(m[0], enc, ratio)]
    return out


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def find(text: str | None, enc, ratio: float = RATIO) -> tuple[list, list]:
    """Base spans, and all spans: a random run within a base span adds nothing."""
    if not text:
        return [], []
    base = base_spans(text)
    more, reached, i = [], -1, 0
    for s in random_spans(text, enc, ratio):
        while i < len(base) and base[i][0] <= s[0]:
            reached = max(reached, base[i][2])
            i += 1
        if s[2] > reached:
            more.append(s)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


COLUMNS = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def scan_secrets(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """One row for each input row, a map without a shuffle. `vocabulary` is the
    path of a tiktoken rank file that every worker can read, `pattern` its
    splitting pattern."""

    def scan(texts: list[str | None]) -> dict[str, list]:
        enc = encoding(vocabulary, pattern)
        out: dict[str, list] = {c.split()[0]: [] for c in COLUMNS.split(", ")}
        for text in texts:
            base, spans = find(text, enc, ratio)
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(s[1] == kind for s in spans))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(spans))
        return out

    return T.map_texts(df, id_col, text_col, id_col, COLUMNS, scan)


def mask(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each maximal stretch of spans replaced by [SECRET]."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a > at or not out:
            out += [text[at:a], "[SECRET]"]
            at = b
        else:
            at = max(at, b)
    return "".join(out) + text[at:]


def redact(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """All rows and columns of the input, the secrets in the text masked. A
    column n_chars of the input follows the new text."""
    from pyspark.sql import functions as F

    def clean(texts: list[str | None]) -> dict[str, list]:
        enc = encoding(vocabulary, pattern)
        return {"_clean": [t if t is None else mask(t, find(t, enc, ratio)[1]) for t in texts]}

    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    made = T.map_texts(df.select(row.alias("_row"), F.col(f"`{text_col}`").alias("_t")), "_row", "_t", "_row", "_clean string", clean)
    new = {text_col: F.col("_clean"), "n_chars": F.length("_clean").cast(df.schema["n_chars"].dataType) if "n_chars" in df.columns else None}
    return made.select(*[(new[c] if new.get(c) is not None else F.col(f"_row.`{c}`")).alias(c) for c in df.columns])
