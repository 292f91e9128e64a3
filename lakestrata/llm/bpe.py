"""Byte-pair encoding through a tokenization automaton, and decoding.

A token sequence is what the merges produce if and only if a certain automaton
over tokens accepts it. It starts as one state that loops on every byte. Each
merge u v -> w, in order, adds a gadget: all arcs labelled u are led to a copy
of their target that lacks the arc v, and every state with an arc u gets an
arc w to where v led. All arcs with one label share their target at any time,
so there is one live state per token and one new state per merge; a state is
stored as the copy of another state, minus one arc, since one merge. The full
transition table has a field for every pair of tokens (2.5 thousand million for
50,000), so its fields are filled from these links when first needed, as in a
lazy deterministic automaton, and a bounded number of them is kept.

Encoding a word runs this deterministic automaton along the word: arcs are
tried longest first from the current state, and a dead end is left behind for
good, so each place is entered at most once. The accepted path is unique, so it
is the encoding. Decoding emits the label of every arc, the token's bytes.

Defined results: null and empty texts have no tokens; repeated rows are encoded
each by itself; only id and text are read, so clashing column names do no harm;
an empty table gives an empty result. Special token strings in a text are taken
as the special tokens, as the tokenizers library does.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Entries of the largest memo, in each of two generations; with those beside it
#: at most about 100 MB. It lives until another operator runs in the worker.
MEMO_LIMIT = 200_000
#: Bytes of the texts that are encoded together.
PIECE = 8 << 20
#: Transitions kept, about 20 MB.
ARCS_KEPT = 200_000


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves,
    the others for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Automaton:
    """The tokenization automaton of a list of merges."""

    def __init__(self, spelling: list[bytes], merges: list[tuple[int, int, int]]):
        n = len(spelling)
        self.spelling = spelling
        self.label_of = {s: i for i, s in enumerate(spelling) if s}
        self.sizes = [len(s) for s in spelling]
        self.reach: dict[bytes, int] = {}  # first three bytes -> the length of the longest token that begins so
        for s in spelling:
            if len(s) > self.reach.get(s[:3], 2):
                self.reach[s[:3]] = len(s)
        self.born = [-1] * n  # the merge that made a token; -1 for bytes
        self.parts = [(i, i) for i in range(n)]
        self.removed_at: dict[int, int] = {}  # (state's token, arc) -> the merge that took the arc away
        self.arcs: dict[int, bool] = {}  # the transition table, filled on demand
        for k, (u, v, w) in enumerate(merges):
            if self._has_arc(u, v, k):
                self.removed_at[u << 32 | v] = k
                if self.born[w] < 0:
                    self.born[w], self.parts[w] = k, (u, v)
        self.shorter = [self._prefix(s) for s in spelling]

    def _prefix(self, s: bytes) -> int:
        """The longest token that is a proper prefix, or -1."""
        return next((self.label_of[s[:i]] for i in range(len(s) - 1, 0, -1) if s[:i] in self.label_of), -1)

    def _has_arc(self, state: int, arc: int, now: int) -> bool:
        """Does the state behind token `state` have this arc before merge `now`?

        Follows the gadgets back: the state of a younger token is the state of
        its right part as it was when the token was made, and an arc to a
        younger token exists where its left part had one just after the merge.
        """
        while True:
            gone = self.removed_at.get(state << 32 | arc)
            if gone is not None and gone < now:
                return False
            a, b = self.born[state], self.born[arc]
            if a < 0 and b < 0:
                return True
            if a > b:
                state, now = self.parts[state][1], a
            else:
                arc, now = self.parts[arc][0], b + 1

    def _look_up(self, state: int, arc: int) -> bool:
        """Fills one field of the finished automaton's transition table."""
        if len(self.arcs) >= ARCS_KEPT:
            self.arcs.clear()
        found = self.arcs[state << 32 | arc] = self._has_arc(state, arc, 1 << 31)
        return found

    def walk(self, word: bytes) -> list[int]:
        """The labels along the accepted path that spells the word."""
        label = self.label_of.get
        whole = label(word)
        if whole is not None and self._made_of_itself(whole):
            return [whole]
        sizes, arcs, shorter, reach = self.sizes, self.arcs, self.shorter, self.reach
        path: list[int] = []
        dead: set[int] = set()
        at, last, token, n = 0, -1, None, len(word)
        while True:
            if token is None:  # the longest token from here
                end = min(at + reach.get(word[at : at + 3], 2), n)
                token = label(word[at:end])
                while token is None:
                    end -= 1
                    if end == at:
                        raise ValueError(f"no token spells byte {word[at]}")
                    token = label(word[at:end])
            while token >= 0:
                end = at + sizes[token]
                if end not in dead:
                    if last < 0:
                        break
                    good = arcs.get(last << 32 | token)
                    if good or good is None and self._look_up(last, token):
                        break
                token = shorter[token]
            if token < 0:  # nothing leads on from here
                dead.add(at)
                token = path.pop()
                last = path[-1] if path else -1
                at -= sizes[token]
                token = shorter[token]
                continue
            path.append(token)
            if end == n:
                return path
            at, last, token = end, token, None

    def _made_of_itself(self, token: int) -> bool:
        """Every token that the merges can reach is its own encoding; a token
        that only the vocabulary lists is not."""
        return self.born[token] >= 0 or len(self.spelling[token]) == 1


class Codec:
    """A byte-level BPE tokenizer file: splitting, automaton, special tokens."""

    def __init__(self, path: str, pattern: str, memo: int = MEMO_LIMIT):
        import regex

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = {c: b for b, c in byte_letters().items()}
        vocab = data["model"]["vocab"]
        specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        spelling = [b""] * (max([*vocab.values(), *specials.values()]) + 1)
        for token, i in vocab.items():
            spelling[i] = bytes(letters[c] for c in token) if token not in specials else b""
        merges = []
        for m in data["model"]["merges"]:
            u, v = m if isinstance(m, list) else m.split(" ")
            merges.append((vocab[u], vocab[v], vocab[u + v]))
        self.automaton = Automaton(spelling, merges)
        self.emit = list(spelling)
        for token, i in specials.items():
            self.emit[i] = token.encode()
        self.specials = specials
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self._chunks = Chunks(regex.compile(pattern).findall, lambda w: array("I", self.automaton.walk(w.encode("utf-8", "surrogatepass"))).tobytes(), memo)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self._special is None or not any(s in text for s in self.specials):
            return encode_chunks(text, self._chunks)
        parts = self._special.split(text)
        return b"".join(np.array([self.specials[p]], "<u4").tobytes() if p in self.specials else encode_chunks(p, self._chunks) for p in parts if p)

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        return encode_many(texts, self._chunks, self.encode, lambda t: any(s in t for s in self.specials))

    def forget(self) -> None:
        """Gives the memory of all memos back."""
        self._chunks.forget()

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, bytes that are no UTF-8 replaced."""
        return b"".join(map(self.emit.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class Memo(dict):
    """Results by key in two generations: when the young one is full it becomes
    the old one, and what is asked for again moves back. So the frequent
    entries stay and memory has a bound."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        made = self.old.get(key)
        if made is None:
            made = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = made
        return made


class Chunks:
    """Encodings of chunks, `bare` or with the `spaced` that stands before them."""

    def __init__(self, pieces, word, limit: int = MEMO_LIMIT):
        self.pieces, self.word, self.limit = pieces, word, limit
        self.forget()

    def forget(self) -> None:
        self.piece = Memo(self.word, self.limit // 4)
        self.bare = Memo(lambda chunk: self._make("", chunk), self.limit // 4)
        self.spaced = Memo(lambda chunk: self._make(" ", chunk), self.limit)

    def _make(self, lead: str, chunk: str) -> bytes:
        if chunk.isalpha() and max(chunk) < "\u0250":  # Latin letters are one piece
            return self.word(lead + chunk)
        body = chunk[:-1]
        if chunk[-1:] in _MARKS and body.isalpha() and max(body) < "\u0250":
            return (self.spaced if lead else self.bare)[body] + self.piece[chunk[-1]]
        return b"".join([self.piece[p] for p in self.pieces(lead + chunk)])


_MARKS = (".", ",", ";", ":", "!", "?")

#: White space after a space or a line feed: there the pattern looks further.
_LOOSE_SPACE, _LOOSE_FEED = re.compile(r" \s"), re.compile(r"\n\s")
_BOUNDARY = re.compile(r" (?!\s|\Z)")


def encode_chunks(text: str, chunks: Chunks) -> bytes:
    """Encodes a text chunk by chunk. The splitting pattern has a boundary
    before every space that a visible character follows, and on both sides of a
    line feed that one follows; so pieces of a chunk are pieces of the text."""
    if not text:
        return b""
    bare, spaced = chunks.bare, chunks.spaced
    if _LOOSE_SPACE.search(text) or _LOOSE_FEED.search(text):
        first, *rest = _BOUNDARY.split(text)
        return bare[first] + b"".join([spaced[c] for c in rest])
    feed, out = bare["\n"], []
    for line in text.split("\n"):
        first, *rest = line.split(" ")
        out.append(bare[first])
        out += [spaced[c] for c in rest]
        out.append(feed)
    out.pop()
    return b"".join(out)


#: Stands before a chunk that no space stands before; texts that hold it are
#: encoded by themselves.
_BARE = "\x01"


def encode_many(texts: list[str | None], chunks: Chunks, alone: Callable[[str], bytes], odd: Callable[[str], bool]) -> list[bytes]:
    """Encodes texts together: their chunks are numbered, each different one is
    looked up once, and the encodings are joined by number. Texts with loose white
    space, or for which odd() holds, go through alone()."""
    out: list[bytes] = [b""] * len(texts)
    plain = []
    for i, t in enumerate(texts):
        if not t:
            continue
        if _BARE in t or odd(t) or _LOOSE_SPACE.search(t) or _LOOSE_FEED.search(t):
            out[i] = alone(t)
        else:
            plain.append(i)
    if not plain:
        return out
    marked = pa.array([_BARE + texts[i] for i in plain], pa.large_string())
    parts = pc.split_pattern(pc.replace_substring(marked, "\n", f" \n {_BARE}"), " ")
    numbered = parts.values.dictionary_encode()
    bare, spaced = chunks.bare, chunks.spaced
    made = [spaced[c] if c[:1] not in ("\n", _BARE) else bare[c] if c == "\n" else bare[c[1:]] for c in numbered.dictionary.to_pylist()]
    number = numbered.indices.to_numpy()
    edges = parts.offsets.to_numpy()
    for i, a, b in zip(plain, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        out[i] = b"".join([made[k] for k in number[a:b].tolist()])
    return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, memo: int = MEMO_LIMIT) -> Codec:
    """Compiled once for each worker."""
    return Codec(path, pattern, memo)


def encode(df: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_text: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit), a map
    without a shuffle. `tokenizer` is the path of a byte-level BPE file of the
    tokenizers library that every worker can read, `pattern` its splitting
    pattern."""

    def run(texts: list[str | None]) -> dict[str, list]:
        c = codec(tokenizer, pattern)
        ids = c.encode_many(texts)
        return {"n_tokens": [len(x) // 4 for x in ids], "ids": ids}

    return T.map_texts(df, id_col, text_col, id_col, "n_tokens long, ids binary", run, keep_text, lambda: codec(tokenizer, pattern).forget(), PIECE)


def decode(df: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of a column of ids."""
    ddl = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary, text string"
    out = T.arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [x or b"" for x in part.column("_ids").to_pylist()]
                made = ([len(x) // 4 for x in ids], ids, [c.decode(x) for x in ids])
                yield pa.RecordBatch.from_arrays([part.column("_id").cast(out[0].type), *(pa.array(x, f.type) for x, f in zip(made, list(out)[1:], strict=True))], schema=out)

    return df.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")).mapInArrow(run, ddl)


def digests(df: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, memo: int = MEMO_LIMIT, piece: int = PIECE, keep: bool = True) -> DataFrame:
    """n_tokens and SHA-256 of the ids and of the text decoded from them, and
    the ids if asked for. Both directions run in one pass over the batch. memo
    (entries), piece (bytes encoded together) and keep (the memo, for a worker's
    next task) trade memory for time."""

    def run(texts: list[str | None]) -> dict[str, list]:
        c = codec(tokenizer, pattern, memo)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for ids in c.encode_many(texts):
            out["n_tokens"].append(len(ids) // 4)
            out["ids"].append(ids if with_ids else None)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
        return out

    return T.map_texts(df, id_col, text_col, id_col, "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else ""), run, forget=lambda: codec(tokenizer, pattern, memo).forget(), piece=piece, keep=keep)
