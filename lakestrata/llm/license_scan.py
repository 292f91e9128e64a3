"""License detection by ordered signature rules.

A rule is a hand-written regular expression over the normalised text (letter
words, lower case, one space between); license_rules.py lists them in order of
priority. A keyword prefilter decides what runs: every rule has one literal that
all its matches hold (taken from the parsed expression), one Aho-Corasick pass
finds all literals, and a rule looks only at the neighbourhood of its own.
Detections compete in order of priority: one whose interval lies in that of a
kept detection, or overlaps it, goes.

Next to the rules stand the base phrases: plain word sequences with a label,
counted wherever they occur.

The work is linear in the text, however often a phrase repeats. Defined results:
null and empty texts have no words, no places, empty label lists and score 0;
repeated rows are scanned each by itself; only id and text are read, so clashing
column names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C
from re import _parser

from pyspark.sql import DataFrame

from . import text as T
from .license_rules import RULES

#: Fixed values of the scan contract: phrase and label.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: What a detection of a form is worth as evidence.
FORMS = {"id": 1.0, "text": 0.95, "notice": 0.95, "link": 0.9, "name": 0.7, "short": 0.6, "reserved": 0.3}


@dataclass(frozen=True)
class Signature:
    label: str
    form: str
    weight: float
    pattern: re.Pattern
    keyword: str
    reach: int  # characters of the longest match


def _width(tokens: Iterable) -> int:
    """The characters of the longest match; rules have no unbounded repeats."""
    total = 0
    for op, arg in tokens:
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            _, most, inner = arg
            total += int(most) * _width(inner)
        elif op is C.SUBPATTERN:
            total += _width(arg[3])
        elif op is C.BRANCH:
            total += max(map(_width, arg[1]))
        else:
            total += 1
    return total


def keyword_of(expression: str) -> str:
    """The longest literal that every match holds."""
    best = run = ""
    for op, arg in _parser.parse(expression):
        if op is C.LITERAL:
            run += chr(arg)
            best = max(best, run, key=lambda x: len(x.strip()))
        else:
            run = ""
    return best.strip()


@lru_cache(maxsize=1)
def signatures() -> tuple[Signature, ...]:
    """All rules in order of priority."""
    made = []
    for line in RULES.strip().splitlines():
        label, form, expression = line.split(" ", 2)
        made.append(Signature(label, form, FORMS[form], re.compile(rf"(?<= )(?:{expression})(?= )"), keyword_of(expression), _width(_parser.parse(expression))))
    return tuple(made)


@lru_cache(maxsize=1)
def _automaton():
    """Finds the keywords of all rules at once."""
    import ahocorasick

    of_keyword: dict[str, list[int]] = {}
    for i, s in enumerate(signatures()):
        of_keyword.setdefault(s.keyword, []).append(i)
    a = ahocorasick.Automaton()
    for keyword, rules in of_keyword.items():
        a.add_word(keyword, tuple(rules))
    a.make_automaton()
    return a


@dataclass(frozen=True)
class Detection:
    start: int  # in the normalised text
    end: int
    rule: int
    signature: Signature


def resolve(found: list[Detection], length: int) -> list[Detection]:
    """Priority first, then place: a detection goes if a kept one contains it or
    overlaps it. Places taken are marked, so this is linear in what was found."""
    taken, kept = bytearray(length), []
    for d in sorted(found, key=lambda d: (d.rule, d.start)):
        if taken.find(1, d.start, d.end) < 0:
            taken[d.start : d.end] = b"\1" * (d.end - d.start)
            kept.append(d)
    return sorted(kept, key=lambda d: d.start)


def _matches(normal: str, rule: int, ends: list[int]) -> Iterable[Detection]:
    """Matches around the places (ends) of the rule's keyword."""
    s = signatures()[rule]
    begin, stop = max(0, ends[0] - s.reach), ends[0] + s.reach + 2
    for at in [*ends[1:], None]:
        if at is not None and at - s.reach <= stop:
            stop = at + s.reach + 2
            continue
        for m in s.pattern.finditer(normal, begin, min(stop, len(normal))):
            yield Detection(m.start(), m.end(), rule, s)
        if at is not None:
            begin, stop = at - s.reach, at + s.reach + 2


def detect(normal: str) -> list[Detection]:
    """Resolved detections in a normalised text with a space at both ends."""
    due: dict[int, list[int]] = {}
    for at, rules in _automaton().iter(normal):
        for i in rules:
            due.setdefault(i, []).append(at + 1)
    if not due:
        return []
    return resolve([d for i, ends in due.items() for d in _matches(normal, i, ends)], len(normal))


def normalise(text: str | None) -> tuple[str, int]:
    """Letter words in lower case (A-Z only) with single spaces, and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(T.LETTERS_FOLDED).split()
    return " " + b" ".join(words).decode("utf-8", "surrogatepass") + " ", len(words)


def _word_numbers(normal: str, places: list[int]) -> list[int]:
    """The number of the word that begins at each of the ascending places."""
    out, at, n = [], 0, -1
    for p in places:
        n += normal.count(" ", at, p)
        at = p
        out.append(n)
    return out


def base_places(normal: str) -> tuple[list[int], set[str]]:
    """Where the base phrases begin (words from 0) and their labels."""
    places, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        at = normal.find(f" {phrase} ")
        while at >= 0:
            places.append(at + 1)
            labels.add(label)
            at = normal.find(f" {phrase} ", at + 1)
    return _word_numbers(normal, sorted(places)), labels


def scan(texts: list[str | None]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections", "detections")}
    for text in texts:
        normal, n = normalise(text)
        places, labels = base_places(normal)
        found = detect(normal)
        doubt = 1.0
        for d in found:
            doubt *= 1.0 - d.signature.weight * 0.9
        out["n_words"].append(n)
        out["n_base"].append(len(places))
        out["first_word"].append(places[0] if places else None)
        out["last_word"].append(places[-1] if places else None)
        out["base_labels"].append(",".join(sorted(labels)))
        out["labels"].append(",".join(sorted(labels | {d.signature.label for d in found})))
        out["score"].append(round(1.0 - doubt, 6) if found else (0.5 if places else 0.0))
        out["n_detections"].append(len(found))
        first = _word_numbers(normal, [d.start for d in found])
        out["detections"].append([{"label": d.signature.label, "form": d.signature.form, "first_word": w, "text": normal[d.start : d.end]} for d, w in zip(found, first, strict=True)])
    return out


COLUMNS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long, "
    "detections array<struct<label:string,form:string,first_word:long,text:string>>"
)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row, a map without a shuffle: base places and
    labels, the resolved detections, all labels and a score in 0 to 1."""
    return T.map_texts(df, id_col, text_col, id_col, COLUMNS, scan)
