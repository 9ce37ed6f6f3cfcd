"""Text of web pages, by the standard library's parser."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

CHROME = {"nav", "header", "footer", "aside", "script", "style", "noscript", "form", "iframe", "svg", "template"}
#: Class or id words that mark an element as chrome.
CHROME_NAME = re.compile(r"(?:^|[\s_-])(?:nav|navbar|menu|breadcrumbs?|sidebar|footer|cookies?|banner|ads?|advert|promo|social|share)(?:$|[\s_-])", re.IGNORECASE)
#: Elements that hold a page's text and are never chrome by their name.
WHOLE = {"html", "body", "main", "article"}
CONTAINERS = {"main", "article", "section", "div", "body"}
CELLS = {"td", "th"}
BLOCKS = {"p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "br", "dl", "dd"}
VOID = {"br", "img", "meta", "link", "hr", "input", "source", "area", "base", "col", "embed", "wbr"}
#: Stand for the white space of code until the rest has been tidied.
_KEPT = str.maketrans({" ": "\ue000", "\t": "\ue001"})
_BACK = str.maketrans({"\ue000": " ", "\ue001": "\t"})


@dataclass
class _Frame:
    """An open element that gathers what is in it: its text or, of a table, its rows of cells."""

    tag: str
    parts: list[str] = field(default_factory=list)
    grid: list[list[str]] = field(default_factory=list)

    def text(self) -> str:
        if self.tag == "table":
            return f"\n{grid_text(self.grid)}\n"
        if self.tag == "math":
            return f" {' '.join(p.strip() for p in self.parts if p.strip())} "
        text = "".join(self.parts)
        if self.tag == "pre":
            code = text.strip("\n").rstrip()
            return "\n```\n" + "\n".join(line.translate(_KEPT) or "\ue000" for line in code.split("\n")) + "\n```\n" if code else ""
        return text


class _Page(HTMLParser):
    """Gathers the text of each container in the order of the page, without chrome."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title: list[str] = []
        self.open: list[tuple[str, bool, bool]] = []  # tag, whether it is chrome, whether it has a frame
        self.hidden = 0
        self.frames = [_Frame("")]
        self.found: list[str] = []

    def inside(self, tag: str) -> bool:
        return any(f.tag == tag for f in self.frames)

    def put(self, text: str) -> None:
        frame = self.frames[-1]
        if frame.tag != "table":
            frame.parts.append(text)
        elif text.strip():  # between the cells
            frame.grid.append([text])

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br":
                self.put("\n")
            return
        name = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
        chrome = tag in CHROME or tag not in WHOLE and bool(CHROME_NAME.search(name))
        framed = tag in CONTAINERS or tag in ("table", "pre", "math") or tag in CELLS and self.inside("table")
        if (tag in BLOCKS and tag != "dd" or tag == "dt") and self.frames[-1].tag != "table":
            self.put("\n")
        if tag == "tr" and self.frames[-1].tag == "table":
            self.frames[-1].grid.append([])
        self.open.append((tag, chrome, framed))
        self.hidden += chrome
        if framed:
            self.frames.append(_Frame(tag))

    def close(self):
        super().close()
        while self.open:
            self.shut(*self.open.pop())

    def shut(self, tag: str, chrome: bool, framed: bool) -> None:
        if framed:
            frame = self.frames.pop()
            text = frame.text()
            if tag in CELLS and self.frames[-1].tag == "table":
                grid = self.frames[-1].grid
                if not grid:
                    grid.append([])
                grid[-1].append(text)
            else:
                self.put(text)
            if tag in CONTAINERS and not self.hidden:
                self.found.append(text)
        self.hidden -= chrome
        if tag == "dt":
            self.put(": ")
        elif tag in BLOCKS and self.frames[-1].tag != "table":
            self.put("\n")

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.open):
            while True:
                last = self.open.pop()
                self.shut(*last)
                if last[0] == tag:
                    break

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "title":
            self.title.append(data)
        elif not self.hidden:
            self.put(data)


def _lines(text: str) -> list[str]:
    """Lines with single spaces, without blank ones."""
    return [line for line in (" ".join(x.split()) for x in text.split("\n")) if line]


def grid_text(grid: list[list[str]]) -> str:
    """A table as text. Data, of two rows and columns or more, becomes a pipe table, in which a cell's lines stand on one;
    anything less is layout, whose cells keep their lines, code and lists among them."""
    cells = [[_lines(c) for c in row] for row in grid if row]
    columns = max((len(row) for row in cells), default=0)
    if len(cells) > 1 and columns > 1:
        ruled = [[" / ".join(c).replace("|", "\\|") for c in row] + [""] * (columns - len(row)) for row in cells]
        ruled.insert(1, ["---"] * columns)
        return "\n".join(f"| {' | '.join(row)} |" for row in ruled)
    return "\n".join(line for row in cells for cell in row for line in cell)


def page_text(html: str | None) -> tuple[str, str]:
    """Title and text of the smallest container that holds nearly all of the page's prose."""
    if not html:
        return "", ""
    page = _Page()
    page.feed(html)
    page.close()
    texts = ["\n".join(_lines(t)) for t in [*page.found, page.frames[0].text()]]
    longest = max(map(len, texts))
    best = min((t for t in texts if len(t) >= 0.95 * longest), key=len)
    return " ".join("".join(page.title).split()), "\n".join(line.rstrip() for line in best.translate(_BACK).split("\n"))


def meta_content(html: str, name: str) -> Column:
    """Content of a <meta> by name, in either order and with either quote; empty if there is none."""
    value = r"""(?:"([^"]*)"|'([^']*)')"""
    called = rf"""name\s*=\s*["']{name}["']"""
    found = []
    for pattern in (rf"(?is)<meta\s[^>]*?{called}[^>]*?content\s*=\s*{value}", rf"(?is)<meta\s[^>]*?content\s*=\s*{value}[^>]*?{called}"):
        found += [F.regexp_extract(html, pattern, i) for i in (1, 2)]
    return F.coalesce(*[F.when(f != "", f) for f in found], F.lit(""))
