"""Main text of web pages by line-block distribution.

Markup is stripped to lines: every tag of a block element ends a line, so that what lies between two
of them is one line, an empty one if there is no text. A line's length is that of its text outside
links; what lies deep in other containers is so parted from its neighbours by more empty lines than
one paragraph is from the next. Lengths are summed over sliding windows of ``WINDOW`` lines. Where
the sum leaves zero a run of lines begins, and where it falls back to zero, a dive point, it ends. A
run is main text if its windows surge: if some window holds ``SURGE`` characters or more.

What names elements and classes bear breaks ties, where lengths alone don't tell:

* a run that surges inside a container that names itself a menu, footer, notice, advert, comments and
  the like is left out, unless all that surges does so, or unless it holds most of the page's text;
* a run that doesn't surge is main text inside an article or main element, or as a heading before, or
  a run with words between, runs that do; if nothing surges anywhere, the article's runs are taken, else the run with the highest window
  outside such containers;
* in a page with an article that surges, runs outside of it that no name speaks for are left out.

Documents are never parsed by regular grammar alone: comments, CDATA, raw text elements, quotes in
attributes, unclosed and stray tags are handled as HTML parsers do, and a truncated page gives what
it holds.

Defined results: a null or empty page, or one without text, gives an empty text; repeated rows are
extracted one by one; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.llm import _common as c

#: Lines to a window, and the characters from which on a window's sum is a surge: more than a line of a footer or an advert
#: has, less than two sentences have.
WINDOW, SURGE = 2, 130

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea title select noframes noembed xmp head".split())
_ASIDE = frozenset("nav header footer aside form menu dialog button".split())
_ARTICLE = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Fixed words that tell a container without content, as whole words of class, id and role.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies "
    "copyright disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
    "promotion related respond search share sharing sidebar skip social sponsor sponsored subscribe subscription syndication toolbar widget alert alertdialog dialog form".split()
)
_PAGE_LEVEL = frozenset("body html article main".split())  # never dropped for their class
_ABOUT = frozenset("has no with without".split())  # beside a mark: of a container that is told whether it has such a part
_CONTENT = re.compile(r"<(?:article|main)(?=[\s/>])", re.I)

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>\"']|$)", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")
_SOME = re.compile(r"\w\w")


_HIDDEN = 2


def _is_aside(name: str, attributes: str, in_article: bool) -> int:
    """Whether a container holds no content; _HIDDEN if no reader sees it."""
    if name in _ASIDE:
        return not (name == "header" and in_article)  # an article's own header holds its heading
    if name in _PAGE_LEVEL or not attributes:
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        value, key = next((v for v in values if v), "").lower(), key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return _HIDDEN
        if key in ("class", "id", "role"):
            words = set(_WORD.findall(value))
            if not _MARKS.isdisjoint(words - {"header"} if in_article else words) and _ABOUT.isdisjoint(words):
                return True
    return False


def _holds_content(page: str, name: str, at: int) -> bool:
    """Whether an article or main element starts inside the element `name` whose start tag ends at `at`."""
    content = _CONTENT.search(page, at)
    if content is None:
        return False
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])", re.I).finditer(page, at, content.start()):
        depth += -1 if m[1] else 1
        if not depth:
            return False
    return True


@dataclass
class Line:
    """A line: its text, its characters outside links, what names say of it (1: an article, -1: boilerplate), whether it is a heading."""

    text: str = ""
    length: int = 0
    named: int = 0
    heading: bool = False


class _Lines:
    """Lines of a page as its tags come."""

    def __init__(self) -> None:
        self.out: list[Line] = []
        self.parts: list[str] = []
        self.article = self.aside = self.hidden = self.heading = 0
        self.anchor = False
        self.linked = 0
        self.total = 0  # characters outside links, in boilerplate too

    def text(self, raw: str) -> None:
        if self.hidden:
            return
        if self.anchor:
            self.linked += len(raw.strip())
        else:
            self.total += len(raw.strip())
        self.parts.append(raw)

    def end(self) -> None:
        """A tag that ends the line, even an empty one."""
        line = _SPACES.sub(" ", html.unescape("".join(self.parts))).strip() if self.parts else ""
        linked, self.parts, self.linked = self.linked, [], 0
        if not line:
            self.out.append(Line())
            return
        named = -1 if self.aside else int(self.article > 0)
        menu = named < 1 and 2 * linked > len(line)  # a line of links
        self.out.append(Line(line, 0 if menu else len(line), named, self.heading > 0))


def lines(page: str, kept: frozenset[int] = frozenset()) -> list[Line]:
    """The lines of a page.

    A visible container with most of the text of a page without article and main is no boilerplate, whatever its name: its start
    is in `kept` of a second pass."""
    into, stack, at, size = _Lines(), [], 0, len(page)
    articles, held = False, []

    def close(upto: int) -> None:
        while len(stack) > upto:
            name, aside, article, start, before = stack.pop()
            if name in _BLOCKS or aside:
                into.end()
            if name == "a":
                into.anchor = False
            if name in _HEADINGS:
                into.heading -= 1
            if aside:
                if aside == _HIDDEN:
                    into.hidden -= 1
                else:
                    held.append((start, into.total - before))
                    into.aside -= 1
            if article:
                into.article -= 1

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            into.text(page[at:])
            break
        into.text(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            into.text(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], "")
        if not name:
            continue
        name = name.lower()
        if slash:
            where = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if where >= 0 and (name in _BLOCKS or not any(x[0] in _BLOCKS for x in stack[where + 1 :])):
                close(where)
            elif name in _BLOCKS:
                into.end()
            continue
        if name in _RAW:
            if not attributes.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                if name == "head":  # its end tag may be left out
                    stop = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(page, at)
                    at = stop.end() if stop else at
                else:
                    at = stop.end() if stop else size
            into.text(" ")
            continue
        if name == "br":
            into.text(" ")
        if name == "a":
            into.anchor = True
        if name in _BLOCKS:
            if (p := next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), -1)) >= 0 and not any(x[0] in _BLOCKS for x in stack[p + 1 :]):
                close(p)
            if name == "li" and stack and stack[-1][0] == "li":
                close(len(stack) - 1)
            into.end()
        if name in _VOID or attributes.endswith("/") and name not in _BLOCKS:
            continue
        aside = 0 if at in kept else int(_is_aside(name, attributes, into.article > 0))
        if aside and (name == "form" or name not in _ASIDE) and not into.article and not into.aside and _holds_content(page, name, at):
            aside = 0  # a wrapper whose class speaks of a part of it, or a form around the page
        article = name in _ARTICLE and not into.aside and not into.hidden
        if aside:
            if name not in _BLOCKS:
                into.end()
            if aside == _HIDDEN:
                into.hidden += 1
            else:
                into.aside += 1
        if article:
            into.article += 1
            articles = True
        if name in _HEADINGS:
            into.heading += 1
        stack.append((name, aside, article, at, into.total))
    close(0)
    into.end()
    most = frozenset(start for start, n in held if 2 * n > into.total)
    if most and not articles and not kept:
        return lines(page, most)
    return into.out


def surges(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(first, behind the last) of the lines between each surge point and the next dive point."""
    out, start, total = [], None, 0
    for i, n in enumerate([*lengths, *([0] * window)]):
        total += n - (lengths[i - window] if 0 <= i - window < len(lengths) else 0)
        if start is None and total:
            start = i
        elif start is not None and not total:
            out.append((start, i - window + 1))
            start = None
    return out


@dataclass
class Run:
    """Lines [start, stop) between a surge point and the next dive point, all named alike."""

    start: int
    stop: int
    named: int
    peak: int
    size: int


def runs(found: list[Line], window: int = WINDOW) -> list[Run]:
    """The runs of a page's line-block distribution, cut where names change; peak is the largest window's sum."""
    out = []
    for a, b in surges([x.length for x in found], window):
        some = [i for i in range(a, b) if found[i].length]
        cuts = [some[0], *(j for i, j in zip(some, some[1:]) if found[i].named != found[j].named), b]
        for x, y in zip(cuts, cuts[1:]):
            lengths = [line.length if line.named == found[x].named else 0 for line in found[x:y]]
            peak = max(sum(lengths[i : i + window]) for i in range(len(lengths)))
            out.append(Run(x, y, found[x].named, peak, sum(lengths)))
    return out


def choose(found: list[Line], every: list[Run], surge: int = SURGE) -> list[Run]:
    """The runs that are main text."""
    wordy = [r for r in every if any(_SOME.search(x.text) for x in found[r.start : r.stop])]
    high = [r for r in every if r.peak >= surge]
    core = [r for r in high if r.named >= 0] or high
    if any(r.named > 0 for r in core):
        return [r for r in every if r.named > 0]
    told = any(x.named < 0 for x in found)  # names have said what is no main text, so what no name speaks for is
    if not core:
        inside = [r for r in every if r.named > 0]
        plain = [r for r in wordy if r.named == 0] or [r for r in every if r.named == 0] or wordy or every
        return inside or (plain if told or len(every) == 1 else [max(plain, key=lambda r: (r.peak, r.size))] if plain else [])
    first, last = core[0].start, core[-1].start

    def stays(r: Run) -> bool:
        heads = r.start < first and any(x.heading for x in found[r.start : r.stop])
        return r.named > 0 or r.named == 0 and r in wordy and (told or heads or first < r.start < last)

    return [r for r in every if r in core or stays(r)]


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of one whole page; blocks joined by two \\n."""
    found = lines(page)
    chosen = choose(found, runs(found, window), surge)
    # a line of links within a run is part of it
    return "\n\n".join(x.text for r in chosen for x in found[r.start : r.stop] if x.text and x.named == r.named)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in c.slices(whole):
            found = [main_text(t) for t in c.texts(b, "html")]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"]
            )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row; a pass without a shuffle."""
    c.ship(pages.sparkSession)
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(_extract, schema)
