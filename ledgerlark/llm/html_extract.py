"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element, and each line gets a
length. What the markup says only weighs on these lengths: a line in
boilerplate (menus, page headers, footers, sidebars, notices, adverts, forms,
comments) has length zero and silence after it; a line of a marked article
(``article``, ``main``, an article body) has ``ARTICLE`` characters more than
its text, and lines outside have none where a page marks one; link text counts
for nothing elsewhere. The lengths are summed over sliding windows of lines:
text runs from each surge (a window sum reaches the threshold after silence) to
the dive after it (the sum falls to zero), and the lines between are the text.
On a page without a marked article, containers whose lines surged have their
other lines weigh as an article's, so that a short paragraph after an advert
surges again; a page on which nothing surges is a short text and kept whole but
for its silence.

Scanning is linear in the page's length, whatever the page holds.

Defined results: NULL, empty or text-free pages give an empty text; several
articles are all kept, in page order; broken or unclosed markup is read as far
as it goes (a tag or comment that never ends takes the rest of the page, as in
a browser); repeated rows are extracted one by one; only the page's own cell is
read, so other columns may have any name.
"""

from __future__ import annotations

import html as htmllib
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
SURGE = 86
#: Characters that a line of a marked article counts beyond its own: enough for a line by itself to surge.
ARTICLE = 100

#: Element names of HTML by their part in a page.
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "button", "title")
BOILER = {"nav", "footer", "aside", "form", "head", "dialog", "menu"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
          "label", "mark", "meter", "output", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "wbr", "input", "picture", "source"}
CONTAINERS = {"div", "section", "article", "main", "body", "html", "center", "details", "td"}
HOLDERS = BOILER | CONTAINERS | {"header", "ul", "ol", "dl", "table", "figure", "span", "blockquote", "p"}
#: Words that name boilerplate in class, id and role.
NAMES = set("""ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner
sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs topbar toolbar footer colophon cookie cookies
consent gdpr notice notices alert newsletter subscribe subscription signup login share sharing social related recommended recommendations
comment comments commentlist disqus replies respond widget widgets popup modal overlay pagination pager search searchform contentinfo
complementary disclaimer copyright paywall""".split())
#: Words that name a page's header outside of an article.
HEADER_NAMES = {"header", "masthead"}
#: Words that say nothing by themselves; a name of these and the ones above is boilerplate too.
FILLERS = set("""site page global main top bottom left right block box bar container wrapper wrap area section list item items inner outer
unit slot links link buttons button icons form field posts post articles stories story policy message text content""".split())
COMMENT_NAMES = {"comment", "comments", "commentlist", "disqus", "replies", "respond"}
MAIN_NAMES = set("articlebody article-body article-content post-content post-body entry-content story-body main-content".split())

TAG_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
TAG_SIGNS = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]*))?")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Line(NamedTuple):
    """A block's text, its length without link text, and where it stands."""

    text: str
    own: int
    silent: bool
    article: bool
    container: int


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, element name or "", closing, attributes) of every piece of markup, in one pass.

    Comments, declarations and raw elements with their content have no name.
    """
    at, n = 0, len(page)
    ends = {"next": TAG_SIGNS}
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if page.startswith(("<!", "<?"), start):
            mark = "]]>" if page.startswith("<![CDATA[", start) else ">"
            end = page.find(mark, start)
            at = n if end < 0 else end + len(mark)
            yield start, at, "", False, ""
            continue
        named = TAG_NAME.match(page, start + 1)
        if not named:
            at = start + 1
            continue
        end = _tag_end(page, named.end(), ends)
        at = n if end < 0 else end + 1
        name, closing = named[1].lower(), page[start + 1] == "/"
        attrs = page[named.end():n if end < 0 else end]
        if not closing and name in RAW_END and not (name in ("svg", "math") and attrs.endswith("/")):
            found = RAW_END[name].search(page, at)
            end = page.find(">", found.end()) if found else -1
            at = n if end < 0 else end + 1
            name = ""
        yield start, at, name, closing, attrs


def _tag_end(page: str, at: int, ends: dict[str, re.Pattern]) -> int:
    """Position of the sign that ends a tag, outside of quoted values; -1 if none."""
    while found := ends["next"].search(page, at):
        mark, q = found[0], found.start()
        if mark == ">":
            return q
        if page[at:q].rstrip()[-1:] != "=":  # a stray quote begins no value
            at = q + 1
            continue
        close = page.find(mark, q + 1)
        if close < 0:  # a value that never ends: the next sign ends the tag, and no such quote follows
            ends["next"] = re.compile("[" + ends["next"].pattern.strip("[]").replace(mark, "") + "]")
            return page.find(">", q)
        at = close + 1
    return -1


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), (m[2] or "").strip("\"'").lower())
    return out


def _named(attrs: dict[str, str], names: set[str]) -> bool:
    """Whether a class, id or role consists of boilerplate words: all parts of a
    name say so, "related-work" or "notice-period" do not."""
    for key in ("class", "id", "role"):
        for word in attrs.get(key, "").split():
            parts = [p for p in re.split(r"[-_]+", word) if p]
            if any(p in names for p in parts) and all(p in names or p in FILLERS for p in parts):
                return True
    return False


def _silent(name: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element holds boilerplate; a header in an article is the article's."""
    if name in BOILER or name == "header" and not inside:
        return True
    if name in ("article", "main", "body", "html"):
        names = COMMENT_NAMES
    else:
        names = NAMES if inside else NAMES | HEADER_NAMES
    return _named(attrs, names) or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")


def _marked(name: str, attrs: dict[str, str]) -> bool:
    return name in ("article", "main") or attrs.get("role") == "main" or "articlebody" in attrs.get("itemprop", "") \
        or bool(MAIN_NAMES & set(attrs.get("class", "").split() + attrs.get("id", "").split()))


def lines_of(page: str) -> list[Line]:
    """Every block in page order."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool, int]] = []  # element, silent, article, container
    opened: dict[str, int] = {}
    buffer: list[str] = []
    linked, in_link, containers = 0, False, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(htmllib.unescape("".join(buffer)).split())
        if text:
            _, silent, article, container = stack[-1] if stack else ("", False, False, 0)
            out.append(Line(text, max(0, len(text) - linked), silent, article, container))
        buffer.clear()
        linked = 0

    def close(name: str) -> None:
        """Leave elements up to the innermost one of the name."""
        while True:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == name:
                return

    at = 0
    for start, end, name, closing, attr_text in tokens(page):
        if start > at:
            piece = page[at:start]
            buffer.append(piece)
            linked += len(piece.strip()) if in_link else 0
        at = end
        if not name:
            continue
        if name == "a":
            in_link = not closing
        if name in ("br", "img"):
            buffer.append(" ")
        if name not in INLINE:
            flush()
        if name not in HOLDERS:
            continue
        if closing:
            if opened.get(name):
                if name == "span" and stack[-1][1]:
                    flush()
                close(name)
            continue
        if name != "span":  # open paragraphs end at the next block
            while stack and stack[-1][0] in ("p", "span"):
                close(stack[-1][0])
        _, silent, article, container = stack[-1] if stack else ("", False, False, 0)
        attrs = _attributes(attr_text) if attr_text.strip(" /") else {}
        own = _silent(name, attrs, article)
        if own and name == "span":
            flush()
        if not attr_text.rstrip().endswith("/"):
            if name in CONTAINERS:
                containers += 1
                container = containers
            stack.append((name, silent or own, article or _marked(name, attrs) and not own and not silent, container))
            opened[name] = opened.get(name, 0) + 1
    buffer.append(page[at:])
    flush()
    return out


def runs(lengths: list[int], threshold: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """[surge, dive) pairs: the window sums of line lengths rise over the
    threshold after silence, and end where a window holds no text."""
    n = len(lengths)
    total = [0]
    for x in lengths:
        total.append(total[-1] + x)
    found, i = [], 0
    while i < n:
        i = bisect_left(total, total[i] + 1) - 1  # silence up to the next line with text
        if i >= n:
            break
        if total[min(n, i + window)] - total[i] < threshold:
            i += 1
            continue
        j = i
        while j < n and total[min(n, j + window)] > total[j]:
            j += 1
        found.append((i, j))
        i = max(j, i + 1)
    return found


def _weighted(lines: list[Line], surged: set[int]) -> tuple[list[int], list[int]]:
    """Lengths, and the line that each belongs to (-1: the silence after boilerplate)."""
    article = any(x.article and not x.silent for x in lines)
    lengths, owner = [], []
    for i, x in enumerate(lines):
        silent = x.silent or article and not x.article
        if not silent and owner and lengths[-1] == 0:  # a whole window of silence, however short the boilerplate
            lengths += [0] * (WINDOW - 1)
            owner += [-1] * (WINDOW - 1)
        weighs = article or x.container in surged
        lengths.append(0 if silent else x.own + ARTICLE if weighs else x.own)
        owner.append(i)
    return lengths, owner


def extract(page: str | None) -> str:
    """Main text: lines between surges and dives, joined by one line feed."""
    lines = lines_of(page) if page else []
    lengths, owner = _weighted(lines, set())
    kept = runs(lengths, SURGE)
    if not any(x.article and not x.silent for x in lines):
        surged = {lines[owner[k]].container for a, b in kept for k in range(a, b) if lengths[k]}
        lengths, owner = _weighted(lines, surged)
        kept = runs(lengths, SURGE if kept else 1)
    return "\n".join(lines[owner[k]].text for a, b in kept for k in range(a, b) if owner[k] >= 0)


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, the main text and its length in code points."""
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [extract(x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*keep, "text", "n_chars"])

    return pages.select(*keep, html).mapInArrow(run, f"{schema}, text string, n_chars bigint")
