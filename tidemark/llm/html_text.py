"""Layout-aware text of HTML pages.

A tokenizer and a tree builder with implied tags turn a page into elements; visibility
rules drop what a reader would not see; the rest is laid out as text, with blank lines
around spaced blocks, markers and indents for lists, and table cells in aligned columns.

Semantics
* A null page is the empty page and gives the empty text. Whole pages are read. Rows repeat
  as they are; other columns are ignored or, in ``extract``, left untouched.
* Not visible: ``head`` and raw data elements, ``hidden`` attributes, inline or simple
  embedded style rules with ``display:none`` or ``visibility:hidden|collapse``, closed
  ``details`` except their summary, closed ``dialog``. The strongest value counts:
  important, inline, id, class, tag, then the last one. Visible text inside an element of
  hidden visibility stays. Rules with other than simple selectors are ignored.
* Rules in ``@media`` count if it is ``all`` or ``screen`` without a condition; those in
  other at-rules, except ``@layer``, don't.
* Text of ``svg`` and ``math`` is visible, except what is not drawn (``FOREIGN_UNSEEN``).
* Elements nested deeper than ``MAX_DEPTH`` become siblings at that depth; their text stays.
* A column is padded to its widest cell, up to ``MAX_PAD`` characters; longer cells are
  written whole and unpadded. Beyond ``MAX_LINE`` characters cells are only separated. A cell's
  text is always written, whatever its spans say; spans that are no numbers count as 1.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DEPTH = 200
MAX_PAD = 60
#: Cells that would begin beyond this many characters follow the one before without alignment.
MAX_LINE = 2000
#: Cells that reach down over other rows do so in this many first columns.
MAX_COLUMNS = 1000
GAP = "  "

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript template textarea title".split())
SHOWN_RAW = frozenset("xmp textarea".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes datalist object audio video canvas rp param".split())
FOREIGN_UNSEEN = frozenset("desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li listing main menu nav ol optgroup option p plaintext pre search section select summary table ul xmp caption textarea".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure fieldset hr listing xmp".split())
CLOSES_P = BLOCK - frozenset("html body dd dt li optgroup option caption legend summary textarea select".split()) | {"li", "dd", "dt", "summary", "legend"}
#: A start tag ends these, looking up the open elements no further than the given fences.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
P_FENCE = frozenset("table td th caption button object template html body".split())
END_FENCE = frozenset("table td th caption html".split())

_TOKEN = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)|([!?/]))")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_TAG_END = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*+>""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_CSS = re.compile(r"[{};]")
_SHOW = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([a-z-]+)([^;]*)", re.I)
#: Media queries that hold on a screen, whatever its size.
_SCREEN = frozenset(("", "all", "screen", "only all", "only screen"))
_NUMBER = re.compile(r"[ \t\n\r\f]*\+?([0-9]+)")
_SIMPLE = re.compile(r"([A-Za-z][\w-]*)?(?:([.#])([\w-]+))?")
_PRE = re.compile(r"white-space\s*:\s*(?:pre|break-spaces)", re.I)


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        value = m.group(2) or m.group(3) or m.group(4) or ""
        out.setdefault(m.group(1).lower(), unescape(value) if "&" in value else value)
    return out


class _Builder:
    def __init__(self) -> None:
        self.root = Element("html", {})
        self.open = [self.root]
        self.css: list[str] = []

    def text(self, data: str) -> None:
        if data:
            self.open[-1].children.append(unescape(data) if "&" in data else data)

    def _pop_to(self, i: int) -> None:
        if i > 0:
            del self.open[i:]

    def _find(self, tags, fence) -> int:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                return i
            if tag in fence:
                return 0
        return 0

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> Element:
        if tag in ("html", "body"):
            if tag == "body":
                self._pop_to(self._find({"head"}, ()))
            self.root.attrs |= attrs if tag == "html" else {}
            if tag == "html" or any(e.tag == "body" for e in self.open):
                return self.root
        if tag in CLOSES_P:
            self._pop_to(self._find({"p"}, P_FENCE))
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._pop_to(len(self.open) - 1)
        if tag in IMPLIED_END:
            tags, fence = IMPLIED_END[tag]
            if tag in ("tr", "thead", "tbody", "tfoot"):
                self._pop_to(self._find({"td", "th", "caption"}, {"table"}))
            while i := self._find(tags, fence):
                self._pop_to(i)
            if tag in ("td", "th") and not self._find({"tr"}, {"table"}) and self._find({"table"}, ()):
                self._push(Element("tr", {}))
        foreign = (closed or tag in FOREIGN_UNSEEN) and self._find({"svg", "math"}, {"foreignobject"})
        if foreign and tag in FOREIGN_UNSEEN:
            attrs = attrs | {"hidden": ""}
        element = Element(tag, attrs)
        if tag in VOID or closed and (foreign or tag in ("svg", "math", "path")):
            self.open[-1].children.append(element)
        else:
            self._push(element)
        return element

    def _push(self, element: Element) -> None:
        self.open[-1].children.append(element)
        if len(self.open) < MAX_DEPTH:
            self.open.append(element)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {}, True)
        elif tag == "p" and not self._find({"p"}, P_FENCE):
            self.open[-1].children.append(Element("p", {}))
        elif tag not in ("html", "body"):
            fence = END_FENCE - {tag} if tag not in ("tr", "thead", "tbody", "tfoot", "table") else ({"table"} if tag != "table" else ())
            self._pop_to(self._find({tag}, fence))


def parse(html: str) -> tuple[Element, list[str]]:
    """The page's element tree and the text of its style elements."""
    build, at, n = _Builder(), 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            build.text(html[at:])
            break
        build.text(html[at : m.start()])
        if m.group(1):
            end = html.find("-->", m.start() + 4)
            if html.startswith(("<!-->", "<!--->"), m.start()):
                end = html.find(">", m.start()) - 2
            at = n if end < 0 else end + 3
        elif m.group(4):
            end = html.find(">", m.end())
            at = n if end < 0 else end + 1
        else:
            tag, tail = m.group(3).lower(), _TAG_END.match(html, m.end())
            if tail is None:  # a quote that never ends: the tag goes to the next >
                end = html.find(">", m.end())
                end = n if end < 0 else end + 1
            else:
                end = tail.end()
            inside, at = html[m.end() : end - 1], end
            if m.group(2):
                build.end(tag)
                continue
            element = build.start(tag, _attributes(inside) if inside.strip(" /\n\t") else {}, inside.endswith("/"))
            if tag in RAW and (build.open[-1] is element or len(build.open) >= MAX_DEPTH):
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                stop = close.start() if close else n
                if tag == "style":
                    build.css.append(html[at:stop])
                elif tag in SHOWN_RAW:
                    element.children.append(unescape(html[at:stop]) if tag == "textarea" else html[at:stop])
                after = html.find(">", stop) if close else -1
                at = n if after < 0 else after + 1
                if build.open[-1] is element:
                    build.open.pop()
            elif tag == "plaintext":
                element.children.append(html[at:])
                at = n
    return build.root, build.css


def _values(style: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of display and visibility."""
    return [(m.group(1).lower(), m.group(2).lower(), "!" in m.group(3)) for m in _SHOW.finditer(style)]


def _without_comments(css: str) -> str:
    """An open comment runs to the end."""
    parts, at = [], 0
    while (start := css.find("/*", at)) >= 0:
        parts.append(css[at:start])
        stop = css.find("*/", start + 2)
        if stop < 0:
            return "".join(parts)
        at = stop + 2
    return "".join(parts) + css[at:]


def _on_screen(head: str) -> bool:
    """Whether the block of an at-rule applies to every screen."""
    head = head.lower()
    if head.startswith("@media"):
        return any(" ".join(q.split()) in _SCREEN for q in head[6:].split(","))
    return re.match(r"@layer\b", head) is not None


def _span(value: str | None, most: int) -> int:
    """A colspan or rowspan as the standard reads it: leading digits, cut at ``most``; 1 where there is none, 0 stays."""
    found = _NUMBER.match(value or "")
    if not found:
        return 1
    digits = found[1].lstrip("0")
    return most if len(digits) > 6 else min(int(digits or "0"), most)


def visibility_rules(css: list[str]) -> dict[tuple[str, str, str], list]:
    """Simple selectors (tag, kind, name) to the display and visibility values they give, with their strength."""
    out: dict[tuple[str, str, str], list] = {}
    order = 0
    for text in css:
        text = _without_comments(text).replace("<!--", "").replace("-->", "")
        blocks: list[tuple[str, bool]] = []  # open blocks: what stands before, whether it applies
        at = 0
        for m in _CSS.finditer(text):
            before, at = text[at : m.start()], m.end()
            applies = not blocks or blocks[-1][1]
            if m.group() == "{":
                head = before.strip()
                outer = not blocks or blocks[-1][0].startswith("@")
                blocks.append((head, applies and outer and (not head.startswith("@") or _on_screen(head))))
                continue
            if blocks and applies and not blocks[-1][0].startswith("@"):
                for prop, value, important in _values(before):
                    order += 1
                    for s in blocks[-1][0].split(","):
                        if (x := _SIMPLE.fullmatch(s.strip())) and x.group():
                            key = ((x.group(1) or "").lower(), x.group(2) or "", x.group(3) or "")
                            weight = {"#": 100, ".": 10, "": 0}[key[1]] + bool(key[0])
                            out.setdefault(key, []).append((important, weight, order, prop, value))
            if m.group() == "}" and blocks:
                blocks.pop()
    return out


class _Flow:
    """Lines of a block under layout: collapses space and keeps the largest gap asked for."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.space = False
        self.indent = ""
        self.marker: str | None = None

    def inline(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if text == " " or not text:
            self.space = self.space or (text == " " and bool(self.line))
            return
        if text[0] == " ":
            self.space = self.space or bool(self.line)
        if self.space and self.line:
            self.line.append(" ")
        self.space = text[-1] == " "
        self.line.append(text.strip(" "))

    def literal(self, text: str) -> None:
        if self.space and self.line:
            self.line.append(" ")
        self.space = False
        for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.newline()
            if part:
                self.line.append(part)

    def newline(self) -> None:
        """A forced line break."""
        self._emit("".join(self.line))
        self.line, self.space = [], False

    def _emit(self, line: str) -> None:
        if self.out and self.gap > 1:
            self.out.extend([""] * (self.gap - 1))
        self.gap = 1
        prefix = self.indent
        if self.marker is not None:
            prefix, self.marker = self.marker, None
        self.out.append((prefix + line).rstrip())

    def block(self, gap: int) -> None:
        """A block edge: what follows starts on a new line, after gap - 1 empty lines."""
        if self.line:
            self._emit("".join(self.line))
            self.line = []
        self.space = False
        self.gap = max(self.gap, gap)

    def lines(self, lines: list[str]) -> None:
        for line in lines:
            self._emit(line)

    def result(self) -> list[str]:
        self.block(1)
        return self.out


class _Layout:
    def __init__(self, rules: dict[tuple[str, str, str], list]):
        self.rules = rules

    def style(self, e: Element) -> dict[str, str]:
        """The element's own display and visibility, where given."""
        found = list(self.rules.get((e.tag, "", ""), ())) if self.rules else []
        if a := e.attrs:
            if self.rules:
                for kind, names in ((".", set(a.get("class", "").split())), ("#", [a["id"]] if "id" in a else [])):
                    for name in names:
                        found += self.rules.get(("", kind, name), ())
                        found += self.rules.get((e.tag, kind, name), ())
            if "style" in a:
                found += [(important, 1000, i, prop, value) for i, (prop, value, important) in enumerate(_values(a["style"]))]
        return {prop: value for _, _, _, prop, value in sorted(found)}

    def unseen(self, e: Element) -> bool:
        if e.tag in UNSEEN or e.tag == "input" and e.attrs or e.tag == "dialog" and "open" not in e.attrs:
            return True
        if not e.attrs and not self.rules:
            return False
        style = self.style(e)
        if style.get("display", "none" if "hidden" in e.attrs else "") == "none":
            return True
        return style.get("visibility") in ("hidden", "collapse") and not self.strip(e)

    def strip(self, e: Element) -> bool:
        """Takes out what is hidden with an element of hidden visibility; whether anything stays."""
        e.children = [c for c in e.children if isinstance(c, Element) and (self.style(c).get("visibility") in ("visible", "initial") and not self.unseen(c) or self.strip(c))]
        return bool(e.children)

    def flow(self, children: list, f: _Flow, pre: bool, depth: int) -> None:
        for c in children:
            if isinstance(c, str):
                f.literal(c) if pre else f.inline(c)
            elif not self.unseen(c):
                self.element(c, f, pre, depth)

    def element(self, e: Element, f: _Flow, pre: bool, depth: int) -> None:
        tag = e.tag
        pre = pre or tag in ("pre", "listing", "xmp", "textarea", "plaintext") or bool(e.attrs) and bool(_PRE.search(e.attrs.get("style", "")))
        if tag == "br":
            f.newline()
        elif tag == "table":
            f.block(2)
            f.lines(self.table(e))
            f.block(2)
        elif tag in ("ul", "ol", "menu", "dir"):
            self.items(e, f, pre, depth)
        elif tag == "details" and "open" not in e.attrs:
            f.block(1)
            self.flow([c for c in e.children if isinstance(c, Element) and c.tag == "summary"][:1], f, pre, depth)
            f.block(1)
        elif tag in BLOCK:
            gap = 2 if tag in SPACED and not (depth and tag in ("dl",)) else 1
            f.block(gap)
            before = f.indent
            if tag in ("blockquote", "dd"):
                f.indent += "  "
            children = e.children
            if pre and children and isinstance(children[0], str) and tag in ("pre", "listing", "textarea"):
                children = [children[0].removeprefix("\n"), *children[1:]]
            self.flow(children, f, pre, depth)
            f.block(gap)
            f.indent = before
        elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "text"):  # outside any table, and in svg
            f.inline(" ")
            self.flow(e.children, f, pre, depth)
            f.inline(" ")
        elif tag == "q":
            f.inline('"')
            self.flow(e.children, f, pre, depth)
            f.inline('"')
        else:
            self.flow(e.children, f, pre, depth)

    def items(self, e: Element, f: _Flow, pre: bool, depth: int) -> None:
        gap = 1 if depth else 2
        f.block(gap)
        try:
            number = int(e.attrs.get("start", "1"))
        except ValueError:
            number = 1
        before = f.indent
        for c in e.children:
            if isinstance(c, Element) and c.tag == "li" and not self.unseen(c):
                mark = f"{number}. " if e.tag == "ol" else "- "
                number += 1
                f.block(1)
                f.marker, f.indent = before + mark, before + " " * len(mark)
                self.flow(c.children, f, pre, depth + 1)
                f.block(1)
                if f.marker is not None:  # an item without text keeps its marker
                    f.newline()
                f.indent = before
            elif isinstance(c, str):
                f.inline(c)
            elif not self.unseen(c):
                self.element(c, f, pre, depth + 1)
        f.block(gap)

    def table(self, e: Element) -> list[str]:
        """The table's lines: captions, then rows in aligned columns."""
        head: list[str] = []
        rows: list[list[Element]] = []

        def gather(node: Element) -> None:
            for c in node.children:
                if isinstance(c, str):
                    if c.strip():
                        head.append(_SPACE.sub(" ", c).strip())
                elif self.unseen(c):
                    continue
                elif c.tag == "tr":
                    rows.append([x for x in c.children if isinstance(x, Element) and x.tag in ("td", "th") and not self.unseen(x)])
                    head.extend(_SPACE.sub(" ", x).strip() for x in c.children if isinstance(x, str) and x.strip())
                    for x in c.children:
                        if isinstance(x, Element) and x.tag not in ("td", "th") and not self.unseen(x):
                            head.extend(self.lines([x]))
                elif c.tag in ("tbody", "thead", "tfoot"):
                    gather(c)
                else:
                    head.extend(self.lines([c]))

        gather(e)
        busy: dict[int, int] = {}  # column to rows still covered by a cell above
        placed: list[list[tuple[int, int, list[str]]]] = []
        widths: dict[int, int] = {}
        for row in rows:
            at, cells, covers = 0, [], {}
            for cell in row:
                while busy.get(at, 0) > 0:
                    at += 1
                # The standard's limits. A rowspan of 0 reaches to the end of the table.
                span, deep = _span(cell.attrs.get("colspan"), 1000) or 1, _span(cell.attrs.get("rowspan"), 65_534) or 65_534
                lines = self.lines(cell.children) or [""]
                cells.append((at, span, lines))
                if span == 1:
                    widths[at] = max(widths.get(at, 0), *(len(x) if len(x) <= MAX_PAD else 0 for x in lines))
                if deep > 1:
                    for k in range(at, min(at + span, MAX_COLUMNS)):
                        covers[k] = deep
                at += span
            busy = {k: v for k in {*busy, *covers} if (v := max(busy.get(k, 0), covers.get(k, 0)) - 1) > 0}
            placed.append(cells)
        # Where each column begins; columns that no cell has for itself take no room.
        begins, upto = {}, 0
        for k in sorted(widths):
            begins[k] = upto
            upto += widths[k] + len(GAP)
            if upto > MAX_LINE:
                break
        known = sorted(begins)
        out = list(head)
        for cells in placed:
            for i in range(max((len(lines) for _, _, lines in cells), default=0)):
                parts, size = [], 0
                for at, _, lines in cells:
                    text = lines[i] if i < len(lines) else ""
                    if not text:
                        continue
                    k = bisect.bisect_left(known, at)
                    want = begins[known[k]] if k < len(known) else MAX_LINE + 1
                    gap = want - size if size <= want <= MAX_LINE else len(GAP) if size else 0
                    parts += [" " * gap, text]
                    size += gap + len(text)
                out.append("".join(parts).rstrip())
        return out

    def lines(self, children: list) -> list[str]:
        f = _Flow()
        self.flow(children, f, False, 0)
        return f.result()


def html_to_text(html: str | None) -> str:
    """All visible text of a page, laid out."""
    if not html:
        return ""
    root, css = parse(html)
    lines = _Layout(visibility_rules(css)).lines([root] if root.children else [])
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with their text in ``out_col`` in place of the HTML."""
    kept = pages.drop(out_col) if out_col != html_col else pages
    names = [c for c in kept.columns if c != html_col]
    source = kept.select(*[kept[c] for c in names], kept[html_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([html_to_text(h.as_py()) for h in batch.column(len(names))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], text], [*names, out_col])

    schema = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}`{out_col}` string")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
