"""Operator 2, HTML extraction: a tree builder with implied tags drives a layout renderer that emits all visible text.

Parsing. A tokenizer splits the page into tags, comments and text; the builder keeps the stack of open elements, supplies the ends that HTML
leaves out (head before what can't stand in it, p before a block, li, dt, dd, option, tr, td, table sections, svg and math before blocks) and ignores ends without a start. It emits balanced
open and close events, so pages of any depth need no recursion.

Visibility. Not shown: head, title, script, style, template, noscript and other raw elements, comments, elements with `hidden`, `display:none` or
`visibility:hidden`, inputs of type hidden (inputs and images show their value or alt text when they have one). Of svg its text and foreignObject
elements are shown, of math all but annotations, of object what it holds for those who can't load it.

Layout. Blocks start on lines of their own; paragraphs, headings, lists, tables and quotations stand between empty lines; br breaks
a line; list items have "- " or their number and two more spaces for each level; pre keeps its spaces; table cells are aligned in columns,
each padded to its column's width; cells over several columns or rows keep these free in their other rows, and widen the last of their columns if
they need more than all of them have. Lines of more than LINE_MOST characters in a cell that others follow are broken between words, so that a
table's size is bounded by its rows; a word longer than that runs over its column.

Edge cases. html null or empty: text empty. Broken markup: what looks like no tag is text. Repeated rows: each by itself. Null page_id: passed through.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame

from .common import by_batch

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes audio video canvas datalist annotation annotation-xml".split())
#: Within svg only.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask marker pattern filter lineargradient radialgradient".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table caption tr ul".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir".split())
CLOSES_P = BLOCK - frozenset("body html option optgroup legend caption tr select".split())
SECTIONS = frozenset("thead tbody tfoot".split())
#: Element -> elements that its start ends, and those beyond which it doesn't look.
IMPLIED: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir", "table", "td", "th"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "th"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "th"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"td", "th", "tr", "caption", "colgroup"}), frozenset({"thead", "tbody", "tfoot", "table"})),
    **{s: (frozenset({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})) for s in ("thead", "tbody", "tfoot")},
    "body": (frozenset({"head"}), frozenset({"html"})),
}
#: What may stand in head; the start of anything else ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta title style script noscript noframes template".split())
#: HTML elements that end an open svg or math, and elements of these in which HTML may stand.
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
FOREIGN, HOLDS_HTML = frozenset({"svg", "math"}), frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
MATH_TOKENS = frozenset("mi mo mn ms mtext".split())
SCOPE = frozenset("table td th caption html template button".split())
#: The most that HTML lets a cell span, and a list's numbers.
COLUMNS_MOST, ROWS_MOST, NUMBER_MOST = 1000, 65534, 2**31 - 1
LINE_MOST = 1000

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
_NUMBER = re.compile(r"[\x20\t\n\f\r]*([+-]?[0-9]+)")
_BLANK = re.compile(r"[\x20\t\n\r\f\v]+")


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), entities.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return found


def tokens(page: str):
    """("text", text, "") | ("open", name, attributes' source) | ("close", name, "")."""
    at = 0
    for_raw = None
    while True:
        if for_raw:
            end = re.compile(rf"</{for_raw}\b[^>]*>", re.I).search(page, at)
            yield "text", page[at : end.start() if end else len(page)], for_raw
            yield "close", for_raw, ""
            at, for_raw = (end.end() if end else len(page)), None
        m = _TAG.search(page, at)
        if not m:
            if at < len(page):
                yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if name := (m[2] or "").lower():
            yield ("close" if m[1] else "open"), name, m[3]
            if not m[1] and name in RAW and not m[3].endswith("/"):
                for_raw = name


def events(page: str):
    """Balanced ("open", name, attributes), ("close", name, {}) and ("text", text, {}) events, with the ends that HTML leaves out."""
    stack: list[str] = []
    depth: dict[str, int] = {}

    def pop():
        name = stack.pop()
        depth[name] -= 1
        return "close", name, {}

    def end_within(names: frozenset, beyond: frozenset):
        """Closes up to the outermost of names above the nearest of beyond."""
        upto = None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in beyond:
                break
            if stack[i] in names:
                upto = i
        while upto is not None and len(stack) > upto:
            yield pop()

    for kind, name, rest in tokens(page):
        if kind == "text":
            if stack and stack[-1] == "head" and name.strip(" \t\n\r\f"):
                yield pop()
            yield "text", name if rest in RAW - {"title", "textarea"} else entities.unescape(name) if "&" in name else name, {}
        elif kind == "open":
            if stack and stack[-1] == "head" and name not in IN_HEAD:
                yield pop()
            if name == "head" and any(x != "html" for x in stack):
                continue
            foreign = depth.get("svg") or depth.get("math")
            if foreign and name in ENDS_FOREIGN:
                yield from end_within(FOREIGN, HOLDS_HTML)
            if name in CLOSES_P and depth.get("p"):
                yield from end_within(frozenset({"p"}), SCOPE)
            if name in IMPLIED and any(depth.get(x) for x in IMPLIED[name][0]):
                yield from end_within(*IMPLIED[name])
            found = attributes(rest) if rest.strip() else {}
            yield "open", name, found
            if name in VOID or foreign and _SELF_CLOSED.search(rest):
                yield "close", name, {}
            else:
                stack.append(name)
                depth[name] = depth.get(name, 0) + 1
        elif depth.get(name):
            limit = frozenset() if name in SCOPE or name in SECTIONS or name in ("body", "tr") else frozenset({"table", "td", "th"})
            upto = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] == name:
                    upto = i
                    break
                if stack[i] in limit:
                    break
            while upto is not None and len(stack) > upto:
                yield pop()
        elif name == "p":
            yield "open", "p", {}
            yield "close", "p", {}
    while stack:
        yield pop()


class Flow:
    """Lines of the page or of one table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False
        self.indent: list[str] = []
        self.marker = ""

    def words(self, text: str) -> None:
        lead, trail = text[0] in " \t\n\r\f\v", text[-1] in " \t\n\r\f\v"
        inner = _BLANK.sub(" ", text).strip(" ")
        if inner:
            if self.line and (lead or self.space):
                self.line.append(" ")
            self._begin()
            self.line.append(inner)
            self.space = trail
        else:
            self.space = self.space or lead

    def _begin(self) -> None:
        if self.line:
            return
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.line.append("".join(self.indent)[: -len(self.marker)] + self.marker if self.marker else "".join(self.indent))
        self.marker = ""

    def kept(self, text: str) -> None:
        first, *more = text.split("\n")
        if first:
            self._begin()
            self.line.append(first)
        for x in more:
            self.newline()
            if x:
                self._begin()
                self.line.append(x)

    def end_line(self, gap: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False
        self.gap = self.gap or gap

    def newline(self) -> None:
        if self.line:
            self.end_line()
        elif self.lines:
            self.gap = True

    def block(self, lines: list[str]) -> None:
        self.end_line()
        for x in lines:
            self._begin()
            self.line.append(x)
            self.end_line()

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def number(source: str | None, least: int, most: int, otherwise: int) -> int:
    """An attribute's number, drawn into its range; otherwise where there is none."""
    m = _NUMBER.match(source or "")
    if not m:
        return otherwise
    digits = m[1].lstrip("+-0")
    value = int(digits or 0) if len(digits) < 12 else most + 1
    return max(least, min(most, -value if m[1][0] == "-" else value))


def placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, int, list[str]]]]:
    """Each row's cells (lines, columns, rows spanned; 0 rows: all that follow) as (first column, columns, lines)."""
    taken: dict[int, int] = {}  # column -> rows that a cell from above still fills
    out = []
    for row in rows:
        at, own, down = 0, [], []
        for lines, span, depth in row:
            while at in taken:
                at += 1
            own.append((at, span, lines))
            if depth != 1:
                down += [(c, (depth or ROWS_MOST) - 1) for c in range(at, at + span)]
            at += span
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        taken.update((c, max(n, taken.get(c, 0))) for c, n in down)
        out.append(own)
    return out


def broken(lines: list[str]) -> list[str]:
    """Lines of LINE_MOST characters at most, broken between words."""
    if all(len(x) <= LINE_MOST for x in lines):
        return lines
    out: list[str] = []
    for line in lines:
        while len(line) > LINE_MOST:
            cut = line.rfind(" ", 1, LINE_MOST + 1)
            if cut < 0:
                cut = line.find(" ", LINE_MOST)
            if cut < 0:
                break
            out.append(line[:cut].rstrip())
            line = line[cut + 1 :].lstrip(" ")
        out.append(line)
    return out


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table: cells (their lines, columns and rows spanned) padded to their columns' width; cells of several lines stand side by side."""
    table = [[(at, span, lines if k == len(row) - 1 else broken(lines)) for k, (at, span, lines) in enumerate(row)] for row in placed(rows)]
    n = max((at + span for row in table for at, span, _ in row), default=0)
    widths = [0] * n
    spread = []
    for row in table:
        for k, (at, span, lines) in enumerate(row):
            wide = max(map(len, lines), default=0)
            if k == len(row) - 1 and wide > LINE_MOST:  # nothing follows it in its row
                continue
            wide = min(wide, LINE_MOST)
            if span == 1:
                widths[at] = max(widths[at], wide)
            else:
                spread.append((span, at, wide))
    for span, at, wide in sorted(spread):
        widths[at + span - 1] += max(0, wide - sum(widths[at : at + span]) - 2 * (span - 1))
    starts = [0] * (n + 1)
    for c, wide in enumerate(widths):
        starts[c + 1] = starts[c] + wide + 2
    out = []
    for row in table:
        for k in range(max((len(lines) for *_, lines in row), default=0)):
            line = ""
            for at, _, lines in row:
                if k < len(lines) and lines[k]:
                    line = line + "  " if line and len(line) + 2 > starts[at] else line.ljust(starts[at])
                    line += lines[k]
            out.append(line.rstrip())
    return out


def render(page: str | None) -> dict:
    """text, and the numbers of tables, list items and headings shown."""
    flow, flows, tables, lists = Flow(), [], [], []
    hidden = pre = drawings = labels = 0
    n = {"n_tables": 0, "n_items": 0, "n_headings": 0}
    open_hidden: list[bool] = []
    for kind, name, found in events(page or ""):
        if kind == "text":
            if not hidden and name and (labels or not drawings):
                if tables and not flows_in_cell(tables):
                    if not name.isspace():
                        tables[-1]["caption"].words(name)
                elif pre:
                    flow.kept(name)
                else:
                    flow.words(name)
            continue
        if kind == "open":
            hides = name in UNSEEN or "hidden" in found or bool(found.get("style") and _HIDING.search(found["style"])) or (name == "input" and found.get("type", "").lower() == "hidden")
            hides = hides or bool(drawings) and (name in UNDRAWN or found.get("display") == "none" or found.get("visibility") in ("hidden", "collapse"))
            if name not in VOID:
                open_hidden.append(hides)
            hidden += hides and name not in VOID
            if hidden or hides:
                continue
            if name == "br":
                flow.newline()
            elif name == "img" and found.get("alt"):
                flow.words(f" {found['alt']} ")
            elif name == "input" and found.get("value"):
                flow.words(f" {found['value']} ")
            elif name == "hr":
                flow.end_line(True)
            elif name == "table":
                flow.end_line(True)
                n["n_tables"] += 1
                tables.append({"rows": [], "caption": Flow(), "outer": flow, "cell": False, "span": 1, "down": 1})
            elif name in ("td", "th") and tables and not tables[-1]["cell"]:
                if not tables[-1]["rows"]:
                    tables[-1]["rows"].append([])
                tables[-1] |= {"cell": True, "span": number(found.get("colspan"), 1, COLUMNS_MOST, 1), "down": number(found.get("rowspan"), 0, ROWS_MOST, 1)}
                flows.append(flow)
                flow = Flow()
            elif name == "tr" and tables and not tables[-1]["cell"]:
                tables[-1]["rows"].append([])
            elif name in ("ul", "ol", "menu", "dir"):
                flow.end_line(not lists)
                lists.append([name, number(found.get("start"), -NUMBER_MOST, NUMBER_MOST, 1)])
                if len(lists) > 1:
                    flow.indent.append("  ")
            elif name == "li":
                flow.end_line()
                n["n_items"] += 1
                if lists and lists[-1][0] == "ol":
                    lists[-1][1] = number(found.get("value"), -NUMBER_MOST, NUMBER_MOST, lists[-1][1])
                flow.marker = f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "
                if lists:
                    lists[-1][1] += 1
                flow.indent.append(" " * len(flow.marker))
            elif name in BLOCK:
                n["n_headings"] += len(name) == 2 and name[0] == "h" and name[1].isdigit()
                flow.end_line(name in SPACED)
                if name in ("blockquote", "dd"):
                    flow.indent.append("  ")
            elif name in MATH_TOKENS:
                flow.words(" ")
            elif drawings and name in ("text", "foreignobject"):
                flow.words(" ")
                labels += 1
            pre += name == "pre"
            drawings += name == "svg"
            continue
        if name in VOID:
            continue
        hides = open_hidden.pop()
        if hidden:
            hidden -= hides
            continue
        pre -= name == "pre"
        drawings -= name == "svg"
        if name == "table" and tables:
            made = tables.pop()
            flow = made["outer"]
            flow.block(made["caption"].done())
            flow.block(aligned(made["rows"]))
            flow.end_line(True)
        elif name in ("td", "th") and tables and tables[-1]["cell"]:
            tables[-1]["rows"][-1].append((flow.done(), tables[-1]["span"], tables[-1]["down"]))
            tables[-1]["cell"] = False
            flow = flows.pop()
        elif name in ("ul", "ol", "menu", "dir"):
            if lists:
                lists.pop()
            if lists and flow.indent:
                flow.indent.pop()
            flow.end_line(not lists)
        elif name == "li":
            flow.end_line()
            flow.marker = ""
            if flow.indent:
                flow.indent.pop()
        elif name in BLOCK:
            flow.end_line(name in SPACED)
            if name in ("blockquote", "dd") and flow.indent:
                flow.indent.pop()
        elif name in MATH_TOKENS:
            flow.words(" ")
        elif drawings and name in ("text", "foreignobject"):
            flow.words(" ")
            labels -= 1
    return {"text": "\n".join(flow.done()), **n}


def flows_in_cell(tables: list[dict]) -> bool:
    return tables[-1]["cell"]


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """page_id, text, n_chars, n_tables, n_items, n_headings of every page."""
    id_type = dict(pages.dtypes)[id_col]

    def make():
        def do(columns):
            rows = [render(x) for x in columns["_html"]]
            return {"page_id": columns["_id"], "n_chars": [len(r["text"]) for r in rows]} | {k: [r[k] for r in rows] for k in ("text", "n_tables", "n_items", "n_headings")}

        return do

    return by_batch(pages.select(pages[id_col].alias("_id"), pages[html_col].alias("_html")), make, f"page_id {id_type}, text string, n_chars long, n_tables long, n_items long, n_headings long")


def op2(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return extract(table(spark, sf_dir, "pages"))
