"""Selection of content regions: brute force, ablations, work linear in a page."""

import math
import random
import time

import pytest

from lakestrata.llm import html_extract as H

PROSE = "A paragraph of ordinary running text that says one thing after another, at some length."
LINKS = "".join(f"<li><a href=/{i}>Some other page number {i}</a></li>" for i in range(6))
INLINE = "<p><a href=/x>Only a link to the full report</a></p>"


def page(scope, before="", after=""):
    body = f"<h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p>{INLINE}<p>{PROSE}</p><p>Short.</p><div><ul>{LINKS}</ul></div><p>{PROSE}</p><p>{PROSE}</p>"
    return f"<html><body>{before}<{scope}>{body}</{scope}>{after}</body></html>"


WANT = ["Title", PROSE, PROSE, "Only a link to the full report", PROSE, "Short.", PROSE, PROSE]


@pytest.mark.parametrize("scope", ["article", "main", "div"])
def test_links_between_paragraphs_stay_and_lists_of_links_go(scope):
    assert H.main_text(page(scope)).split("\n") == WANT


@pytest.mark.parametrize("scope", ["article", "div"])
def test_without_the_threshold_or_the_gaussian_it_goes_wrong(scope, monkeypatch):
    monkeypatch.setattr(H, "threshold", lambda values: (-math.inf, True))
    assert "Some other page number 3" in H.main_text(page(scope))
    monkeypatch.undo()
    monkeypatch.setattr(H, "smoothed", lambda values: values)
    assert "Only a link" not in H.main_text(page(scope))


def test_prose_outside_an_article_counts_by_the_mass_of_it():
    long = "".join(f"<p>{i} {PROSE}</p>" for i in range(20))
    assert PROSE in H.main_text(f"<body><article><p>Loading.</p></article><div>{long}</div></body>")
    note = "<div><p>This unnamed box beside the article holds a sentence of some length too.</p></div>"
    assert H.main_text(page("article", note, note)).split("\n") == WANT
    assert H.main_text(f"<body>{note}<article><p>A short article of one line.</p></article></body>") == "A short article of one line."


def _brute(lines):
    """The rules as told in the module, written out plainly."""
    ratio = [min(max(len(x.text) - x.link_chars, 0) / x.tags, 80) for x in lines]
    inside = sum(r for r, x in zip(ratio, lines, strict=True) if x.scope)
    scoped = (inside > 0 and inside >= sum(ratio) / 4) or all(x.scope for x in lines)
    segment, at = [], 0
    for i, x in enumerate(lines):
        at += scoped and i > 0 and x.scope != lines[i - 1].scope
        segment.append(at)
    value = [r / 8 if scoped and not x.scope else r for r, x in zip(ratio, lines, strict=True)]
    smooth = []
    for i in range(len(lines)):
        near = [j for j in range(len(lines)) if abs(i - j) <= 3 and segment[i] == segment[j]]
        weights = [math.exp(-((i - j) ** 2) / 2) for j in near]
        smooth.append(sum(w * value[j] for w, j in zip(weights, near, strict=True)) / sum(weights))
    low, high = min(smooth), max(smooth)
    two = high >= 4 * low + 1
    border = low
    if two:
        for _ in range(50):
            mid = (low + high) / 2
            a, b = [v for v in smooth if v < mid], [v for v in smooth if v >= mid]
            low, high = (sum(a) / len(a) if a else low), (sum(b) / len(b) if b else high)
        border = low + (high - low) / 4
    linked = [2 * x.link_chars > len(x.text) for x in lines]
    good = [s >= border - 1e-9 and not k for s, k in zip(smooth, linked, strict=True)]

    def run_of(i):
        a = b = i
        same = lambda j: linked[j] and lines[j].scope == lines[i].scope
        while a > 0 and same(a - 1):
            a -= 1
        while b + 1 < len(lines) and same(b + 1):
            b += 1
        return range(a, b + 1)

    gone = [k and sum(smooth[j] for j in run_of(i)) < border * len(run_of(i)) - 1e-9 for i, k in enumerate(linked)]
    if scoped:
        chosen = {x.scope for x, g in zip(lines, good, strict=True) if g and x.scope}
        if not chosen:
            chosen = {max((x.scope for x in lines if x.scope), key=lambda s: sum(len(x.text) for x in lines if x.scope == s))}
        return [x for i, x in enumerate(lines) if (x.scope in chosen and not gone[i]) or (not x.scope and good[i] and two)]
    marked = [i for i, g in enumerate(good) if g]
    if not marked:
        return []
    first = marked[0]
    while first and lines[first - 1].heading:
        first -= 1
    return [x for i, x in enumerate(lines) if first <= i <= marked[-1] and not gone[i]]


def test_content_against_brute_force():
    rng = random.Random(12)
    for _ in range(3000):
        lines, scope = [], None
        for _ in range(rng.randrange(1, 16)):
            if rng.random() < 0.3:
                scope = rng.choice([None, None, 1, 2])
            n = rng.choice([3, 10, 40, 200])
            lines.append(H.Line("x" * n, rng.randrange(1, 5), rng.choice([0, 0, n // 3, n]), rng.random() < 0.1, scope))
        assert H.content(lines) == _brute(lines)


@pytest.mark.parametrize("unit", ["<b>", "<div>", "<article>", "<li><a href=x>l", "</b>", "<p>text", "<div class=sidebar>", "&amp;", "<!-- ", "<br>", "<a ", "<![CDATA[", "</"])
def test_work_grows_as_the_page(unit):
    def took(n):
        began = time.process_time()
        H.main_text(f"<body><article><p>{PROSE}</p>" + unit * n)
        return time.process_time() - began

    took(2000)
    assert took(40_000) < 40 * took(2000) + 1
