"""Main text of HTML pages.

The standard library's parser streams events; they are gathered into lines, one
for each block of text, with the tags and link text in it. What can be no article
text by element, role or name (scripts, menus, forms, footers and the like) makes
no lines. The other lines are judged by their text-to-tag ratio: characters that
are no link text for each tag, at most those of a line of prose. Structure is a
prior on it: where `article` or `main` holds a fair part of the page's prose,
lines outside count an eighth. The ratios are smoothed with a Gaussian within
each scope, and a threshold that clusters them into two classes tells content.

* A scope is content if one of its lines is in the upper class; its plain lines
  stay, short ones too. A run of lines that are mostly links stays only if its
  smoothed ratios reach the threshold on average: a link between paragraphs is
  raised by them, a list of links sinks.
* Outside scopes the content region reaches from the first to the last line in
  the upper class, with headings before it; runs of links as above.

Text is decoded, white space within a block is one space, blocks are joined by a
line feed in page order; nothing else is dropped or cut.

Defined results: a null or empty page, or one without content, has the text ''
and 0 characters; repeated rows are treated each by itself; other columns than
id, url and html are ignored; an empty table gives an empty result. Pages of any
length are parsed whole.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_SKIP = frozenset("head nav footer aside form script style noscript template button select textarea iframe svg canvas object audio video dialog menu map".split())
_SKIP_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status note".split())
#: Words in a class or id that name what is no article text.
_SKIP_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner bottom breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer disqus dropdown "
    "footer footnav gdpr hidden login masthead menu menubar meta modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup print-only promo promotion "
    "recommended related reply replies respond search share sharing sidebar sidebars signin signup skip social sponsor sponsored sponsors subscribe subscription taboola tagcloud teaser toolbar topbar tracking widget widgets".split()
)
_CONTENT_NAME = frozenset("article post entry content body text story main".split())
_READER_NAME = frozenset("comment comments commentlist disqus reply replies respond".split())
_HEADER_NAME = frozenset(["header"])
_CLOSED_BY_BLOCK = frozenset(["p"])
_SCOPE = frozenset(["article", "main"])
_SIGMA = 1.0
_OUTSIDE = 0.125  # prior of a line outside the scopes
_FAIR = 0.25  # share of the prose that a scope must hold to be one
#: A line of prose; ratios above it count as it, however long a paragraph is.
_PROSE = 80
_KERNEL = [math.exp(-(d * d) / (2 * _SIGMA * _SIGMA)) for d in range(-3, 4)]


_STATE_FIRST = frozenset("no not non without with has have".split())
_STATE_LAST = frozenset("enabled disabled on off open closed active allowed".split())


def _names(attrs: dict[str, str | None]) -> list[list[str]]:
    """The words of each class and of the id, in lower case."""
    raw = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
    raw = re.sub(r"([a-z])([A-Z])", r"\1-\2", raw).lower()
    return [words for token in raw.split() if (words := [w for w in re.split(r"[^a-z]+", token) if w])]


def _is_named(words: list[str], names: frozenset[str]) -> bool:
    """A name as the whole, the beginning or the end; `no-sidebar` and
    `share-enabled` tell the state of something else."""
    if len(words) > 1 and (words[0] in _STATE_FIRST or words[-1] in _STATE_LAST):
        return False
    return words[0] in names or words[-1] in names or "-".join(words) in names


def _is_content(words: list[str]) -> bool:
    return words[-1] in _CONTENT_NAME and words[0] not in _SKIP_NAME and words[0] not in _STATE_FIRST


def _barred(tag: str, attrs: dict[str, str | None]) -> bool:
    """Skipped by element, role or style, whatever its name."""
    if tag in _SKIP or (attrs.get("role") or "").lower() in _SKIP_ROLE:
        return True
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I))


def _skipped_by_name(tag: str, attrs: dict[str, str | None], in_scope: bool) -> bool:
    if tag == "header":
        return not in_scope
    if tag in ("html", "body", "main") or not ("class" in attrs or "id" in attrs):
        return False
    names = _names(attrs)
    if any(map(_is_content, names)):
        return False
    if any(_is_named(words, _SKIP_NAME) for words in names):
        return True
    return not in_scope and any(_is_named(words, _HEADER_NAME) for words in names)


@dataclass
class Line:
    """One block of text, with its tags and the characters within links."""

    text: str
    tags: int
    link_chars: int
    heading: bool
    scope: int | None  # of the article or main around it

    @property
    def linked(self) -> bool:
        """Mostly link text."""
        return 2 * self.link_chars > len(self.text)

    @property
    def ratio(self) -> float:
        return min(max(len(self.text) - self.link_chars, 0) / self.tags, _PROSE)


@dataclass
class _Element:
    tag: str
    skipped: bool
    named: bool  # skipped by name only
    scope: int | None
    number: int
    prose: int  # of the page before it, where it is skipped by its class or id


@dataclass
class Lines(HTMLParser):
    """Parser events gathered into lines. Elements with a number in `spared` are
    not skipped for their names."""

    lines: list[Line] = field(default_factory=list)
    spared: frozenset[int] = frozenset()

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Element] = []
        self.open: dict[str, int] = {}  # tags that are open, by name
        self.within: list[int] = []  # scopes that are open
        self.skipping = self.hard = self.headings = self.scopes = 0
        self.parts: list[str] = []
        self.tags = self.link_chars = 0
        self.number = self.barred = self.prose = 0
        self.held: dict[int, int] = {}  # paragraph text in elements skipped by class or id
        self.readers: set[int] = set()  # those named as readers' comments

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, max(self.tags, 1), self.link_chars, self.headings > 0, self.within[-1] if self.within else None))
        self.parts, self.tags, self.link_chars = [], 0, 0

    def _push(self, e: _Element) -> None:
        self.stack.append(e)
        self.open[e.tag] = self.open.get(e.tag, 0) + 1
        self.headings += e.tag in _HEADING
        self.skipping += e.skipped
        self.hard += e.skipped and not e.named
        self.barred += e.skipped and e.prose < 0
        if e.scope is not None:
            self.within.append(e.scope)

    def _pop(self) -> None:
        e = self.stack.pop()
        self.open[e.tag] -= 1
        self.headings -= e.tag in _HEADING
        self.skipping -= e.skipped
        self.hard -= e.skipped and not e.named
        self.barred -= e.skipped and e.prose < 0
        if e.scope is not None:
            self.within.pop()
        if e.skipped and e.prose >= 0:
            self.held[e.number] = self.prose - e.prose

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK:
            if not self.skipping:
                self._flush()
            if self.stack and self.stack[-1].tag in _CLOSED_BY_BLOCK:
                self._pop()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += not self.skipping
        self.number += 1
        if tag in _VOID:
            return
        if tag in _SCOPE and self.skipping and not self.scopes and not self.hard:
            while self.skipping:  # a named part before it that was never closed
                self._pop()
        values = dict(attrs)
        barred = _barred(tag, values)
        skipped = barred or (_skipped_by_name(tag, values, bool(self.within)) and self.number not in self.spared)
        scope = None
        if tag in _SCOPE and not skipped and not self.skipping:
            self.scopes += 1
            scope = self.within[-1] if self.within else self.scopes
        if skipped and not barred and any(_is_named(words, _READER_NAME) for words in _names(values)):
            self.readers.add(self.number)
        self._push(_Element(tag, skipped, skipped and tag not in _SKIP, scope, self.number, -1 if barred else self.prose))

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK and not self.skipping:
            self._flush()
        self.tags += not self.skipping
        if self.open.get(tag):
            while self.stack[-1].tag != tag:
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        links = self.open.get("a", 0)
        if self.open.get("p") and not self.barred and not links:
            self.prose += len(data)
        if not self.skipping:
            self.parts.append(data)
            if links:
                self.link_chars += len(data)

    def end(self) -> list[Line]:
        self.close()
        if not self.skipping:
            self._flush()
        while self.stack:
            self._pop()
        return self.lines

    def wrappers(self) -> frozenset[int]:
        """Elements skipped by class or id that hold most of the paragraph text;
        comments of readers are often more than the article, so all of it there."""
        return frozenset(n for n, held in self.held.items() if held and (held == self.prose if n in self.readers else 2 * held > self.prose))


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian smoothing; the kernel is cut and rescaled at the ends."""
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for d, k in enumerate(_KERNEL, -3):
            if 0 <= i + d < len(ratios):
                total += k * ratios[i + d]
                weight += k
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> tuple[float, bool]:
    """The border between the two clusters of the values (two means, started
    at the ends), and whether there are two; values that do not differ much are
    one cluster, all of it content."""
    low, high = min(values), max(values)
    if high < 4 * low + 1:
        return low, False
    for _ in range(50):
        border = (low + high) / 2
        under, over = [v for v in values if v < border], [v for v in values if v >= border]
        new = (sum(under) / len(under) if under else low, sum(over) / len(over) if over else high)
        if new == (low, high):
            break
        low, high = new
    # Content varies more than boilerplate: the border is nearer to the latter.
    return low + (high - low) / 4, True


def scores(lines: list[Line]) -> tuple[list[float], bool]:
    """The smoothed ratio of every line, and whether scopes were taken as such."""
    inside = sum(x.ratio for x in lines if x.scope is not None)
    scoped = inside > 0 and inside >= _FAIR * sum(x.ratio for x in lines) or all(x.scope is not None for x in lines)
    out: list[float] = []
    for scope, run in groupby(lines, key=lambda x: x.scope if scoped else None):
        out += smoothed([x.ratio * (_OUTSIDE if scoped and scope is None else 1.0) for x in run])
    return out, scoped


def _of_links(lines: list[Line], smooth: list[float], border: float) -> set[int]:
    """Lines in runs that are mostly links and stay under the border on average."""
    out: set[int] = set()
    for (linked, _), run in groupby(range(len(lines)), key=lambda i: (lines[i].linked, lines[i].scope)):
        places = list(run)
        if linked and sum(smooth[i] for i in places) < border * len(places):
            out.update(places)
    return out


def content(lines: list[Line]) -> list[Line]:
    """The lines of the content regions."""
    if not lines:
        return []
    smooth, scoped = scores(lines)
    border, two = threshold(smooth)
    gone = _of_links(lines, smooth, border)
    good = [s >= border and not x.linked for s, x in zip(smooth, lines, strict=True)]
    if scoped:
        scopes = {x.scope for x, g in zip(lines, good, strict=True) if g and x.scope is not None}
        if not scopes:  # nothing but short lines: the largest of them
            sizes: dict[int, int] = {}
            for x in lines:
                if x.scope is not None:
                    sizes[x.scope] = sizes.get(x.scope, 0) + len(x.text)
            scopes = {max(sizes, key=sizes.__getitem__)}
        return [x for i, x in enumerate(lines) if (i not in gone if x.scope in scopes else x.scope is None and good[i] and two)]
    marked = [i for i, g in enumerate(good) if g]
    while marked and _LEGAL.match(lines[marked[-1]].text):
        marked.pop()
    if not marked:
        return []
    first, last = marked[0], marked[-1]
    while first > 0 and lines[first - 1].heading:
        first -= 1
    return [x for i, x in enumerate(lines[first : last + 1], first) if i not in gone]


#: How the last line of a page without further marks may begin.
_LEGAL = re.compile(r"(?i)(?:©|\(c\)|copyright\b|all rights reserved)")
_OPENING = re.compile(r"<[/!?a-zA-Z]")


def _closable(html: str) -> str:
    """The page without marks that nothing closes any more, which the parser
    would look for again and again: the opening of a comment or of character
    data behind the last closing mark, and a tag that the page's end cuts off."""
    for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>")):
        at = html.rfind(closing) + 1
        if html.find(opening, at) >= 0:
            html = html[:at] + html[at:].replace(opening, "")
    at = html.rfind(">") + 1
    cut = _OPENING.search(html, at)
    return html[: cut.start()] if cut else html


def main_text(html: str | None) -> str:
    if not html:
        return ""
    html = _closable(html)
    parser = Lines()
    parser.feed(html)
    lines = parser.end()
    if spared := parser.wrappers():
        parser = Lines(spared=spared)
        parser.feed(html)
        lines = parser.end()
    return "\n".join(line.text for line in content(lines))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every page, without a shuffle."""

    def run(pages: list[str | None]) -> dict[str, list]:
        texts = [main_text(p) for p in pages]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    rows = df.select(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url")).alias("_row"), F.col(html_col).alias("_html"))
    made = T.map_texts(rows, "_row", "_html", "_row", "text string, n_chars long", run)
    return made.select(F.col("_row.id").alias(id_col), F.col("_row.url").alias(url_col), "text", "n_chars")
